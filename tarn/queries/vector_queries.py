"""Exact vector search, transforms, and caches of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import vectors as V
from tarn.queries import query
from tarn.sources.tables import VECTORS_SQL, table, vectors

DIST = "round(sqrt(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9)"
KNN_SQL = f"""(SELECT q.id AS qid, c.id AS id, {DIST} AS distance, row_number() OVER (PARTITION BY q.id ORDER BY {DIST}, c.id) - 1 AS rank
  FROM {VECTORS_SQL} q CROSS JOIN {VECTORS_SQL} c WHERE q.id % 20 = 0 QUALIFY rank < 10)"""


def asked(spark, sf):
    return vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))


@query("knn_l2", f"SELECT qid, id, rank, distance FROM {KNN_SQL}")
def knn_l2(spark, sf):
    return V.knn(asked(spark, sf), vectors(spark, sf), 10)


@query("knn_l2_blocked", f"SELECT qid, id, rank, distance FROM {KNN_SQL}")
def knn_l2_blocked(spark, sf):
    return V.knn_blocked(asked(spark, sf), vectors(spark, sf), 10)


TIED = DIST.replace(", 9)", ", 1)")


@query("knn_tie_order", f"SELECT q.id AS qid, c.id AS id, row_number() OVER (PARTITION BY q.id ORDER BY {TIED}, c.id // 1024, c.id DESC) - 1 AS rank FROM {VECTORS_SQL} q CROSS JOIN {VECTORS_SQL} c WHERE q.id % 20 = 0 QUALIFY rank < 10")
def knn_tie_order(spark, sf):
    """Distances to one digit, so that ties abound: by chunks of 1,024 ids, inside a chunk the larger id first."""
    return V.knn_blocked(asked(spark, sf), vectors(spark, sf), 10, digits=1, chunk=1024).select("qid", "id", "rank")


@query("knn_backends", f"SELECT b AS backend, qid, id, rank FROM {KNN_SQL} CROSS JOIN (VALUES ('blocked'), ('sql')) AS s(b)")
def knn_backends(spark, sf):
    """Both forms of the search, which agree."""
    runs = [V.knn(asked(spark, sf), vectors(spark, sf), 10, b).select(F.lit(b).alias("backend"), "qid", "id", "rank") for b in ("blocked", "sql")]
    return runs[0].unionAll(runs[1])


@query("cosine_from_l2", f"SELECT qid, id, round(1 - distance * distance / 2, 6) AS cosine FROM {KNN_SQL}")
def cosine_from_l2(spark, sf):
    return V.knn_blocked(asked(spark, sf), vectors(spark, sf), 10).select("qid", "id", F.round(1 - F.col("distance") * F.col("distance") / 2, 6).alias("cosine"))


NORM = "sqrt(list_sum(list_transform(vector, lambda x: x * x)))"


@query("l2_normalize", f"SELECT id, round(list_sum(list_transform(vector, lambda x: x / {NORM} * 3)), 6) AS total, round(vector[1] / {NORM}, 6) AS first FROM {VECTORS_SQL}")
def l2_normalize(spark, sf):
    v = vectors(spark, sf).select("id", V.l2_normalize(F.transform("vector", lambda x: x * 7)).alias("u"))
    return v.select("id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * 3), 6).alias("total"), F.round(F.element_at("u", 1), 6).alias("first"))


@query(
    "matryoshka",
    f"""WITH m AS (SELECT id, vector, list_avg(vector) AS mu FROM {VECTORS_SQL}),
    c AS (SELECT id, list_transform(vector, lambda x: x - mu) AS c FROM m),
    n AS (SELECT id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)) / len(c) + 1e-5))[1:16] AS s FROM c)
    SELECT id, round(s[1] / sqrt(list_sum(list_transform(s, lambda y: y * y))), 6) AS first, round(s[16] / sqrt(list_sum(list_transform(s, lambda y: y * y))), 6) AS last FROM n""",
)
def matryoshka(spark, sf):
    v = vectors(spark, sf).select("id", V.matryoshka(F.col("vector"), 16).alias("u"))
    return v.select("id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"))


@query(
    "maxsim",
    f"""WITH q AS (SELECT id // 20 AS qid, id % 20 AS t, vector FROM {VECTORS_SQL} WHERE id % 5 = 0), d AS (SELECT id // 5 AS doc, vector FROM {VECTORS_SQL}),
    m AS (SELECT qid, doc, t, max(list_sum(list_transform(list_zip(q.vector, d.vector), lambda p: p[1] * p[2]))) AS m FROM q CROSS JOIN d GROUP BY qid, doc, t)
    SELECT qid::BIGINT AS qid, doc::BIGINT AS doc, round(sum(m), 6) AS score FROM m GROUP BY qid, doc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sum(m), 6) DESC, doc) <= 10""",
)
def maxsim(spark, sf):
    """Late interaction: four token vectors a query, five a document, best ten; every fifth vector asks."""
    v = vectors(spark, sf)
    q = v.where("id % 5 = 0").select(F.floor(F.col("id") / 20).alias("qid"), (F.col("id") % 20).alias("t"), F.col("vector").alias("qvec"))
    return V.maxsim(q, v.select(F.floor(F.col("id") / 5).alias("doc"), "vector"), 10).select("qid", "doc", "score")


@query(
    "late_pool",
    f"""WITH t AS (SELECT id // 20 AS doc, id % 20 AS t, vector FROM {VECTORS_SQL}), s AS (SELECT DISTINCT doc, p AS span, (doc + p) % 9 + p AS lo, (doc + p) % 9 + p + 4 + p AS hi FROM t CROSS JOIN range(3) r(p)),
    w AS (SELECT s.*, wl FROM s CROSS JOIN (VALUES (0, 12), (6, 18), (8, 20)) AS w(wl, wh) WHERE wl <= lo AND hi <= wh QUALIFY row_number() OVER (PARTITION BY doc, span ORDER BY least(lo - wl, wh - hi) DESC, wl) = 1),
    x AS (SELECT w.doc, w.span, c, avg(v * (1 + wl / 100.0::DOUBLE)) AS m FROM w JOIN (SELECT doc, t, unnest(vector) AS v, generate_subscripts(vector, 1) AS c FROM t) t ON t.doc = w.doc AND t.t >= lo AND t.t < hi GROUP BY ALL),
    n AS (SELECT doc, span, sqrt(sum(m * m)) AS n, max(m) FILTER (WHERE c = 1) AS first, max(m) FILTER (WHERE c = 2) AS second FROM x GROUP BY ALL)
    SELECT doc::BIGINT AS doc, span::BIGINT AS span, round(first / n, 6) AS first, round(second / n, 6) AS second FROM n""",
)
def late_pool(spark, sf):
    """Spans pooled from the vectors of the window that holds them most centrally; a window's vectors are scaled by where it begins."""
    v = vectors(spark, sf).select(F.floor(F.col("id") / 20).alias("doc"), (F.col("id") % 20).alias("t"), "vector")
    windows = F.array(*(F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in ((0, 12), (6, 18), (8, 20))))
    lo = (F.col("doc") + F.col("span")) % 9 + F.col("span")
    spans = v.select("doc").distinct().select("doc", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("span"))
    spans = spans.select("doc", "span", lo.alias("lo"), (lo + 4 + F.col("span")).alias("hi"), windows.alias("windows"))
    assigned = V.assign_windows(spans, F.col("lo"), F.col("hi"))
    own = v.withColumn("w", F.explode(windows)).where("t >= w.lo AND t < w.hi")
    scaled = own.select("doc", F.col("w.lo").alias("window_lo"), "t", F.transform("vector", lambda x: x * (1 + F.col("w.lo") / 100.0)).alias("vector"))
    at = lambda i: F.round(F.element_at("vector", i), 6)
    return V.pooled(assigned, scaled).select("doc", "span", at(1).alias("first"), at(2).alias("second"))


CACHE = "(SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 3 = 0)"


@query("embed_cache_split", f"SELECT doc_id, sha256(text) IN (SELECT hash FROM {CACHE}) AS cached FROM documents")
def embed_cache_split(spark, sf):
    """Which chunks have a vector under their content hash and which are to be encoded."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    cache = d.where("doc_id % 3 = 0").select("hash").distinct().withColumn("there", F.lit(True))
    return d.join(cache, "hash", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("cached"))


@query("donor_reuse", "SELECT a.doc_id FROM documents a JOIN documents b ON a.doc_id = b.doc_id AND sha256(a.text) = sha256(CASE WHEN b.doc_id % 4 = 0 THEN b.text || '!' ELSE b.text END) WHERE b.doc_id % 2 = 0")
def donor_reuse(spark, sf):
    """A donor's vector is copied for the same id and the same text."""
    d = table(spark, sf, "documents")
    donor = d.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return d.select("doc_id", F.sha2("text", 256).alias("hash")).join(donor, ["doc_id", "hash"]).select("doc_id")


@query("plan_subbatches")
def plan_subbatches(spark, sf):
    """Batches of the documents of each source, longest first, under a token and an attention budget."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("n"))
    return V.subbatches(d, "source", "n", "doc_id", 16, 8192, 1 << 22).select("doc_id", "source", "batch")


@query("nonfinite_rows", "SELECT vec_id, vec_id % 50 = 0 AS bad FROM embeddings")
def nonfinite_rows(spark, sf):
    """Rows whose vector holds NaN or an infinity; here put into every fiftieth."""
    v = vectors(spark, sf).withColumn("vector", F.when(F.col("id") % 50 == 0, F.concat("vector", F.array(F.lit(float("nan"))))).otherwise(F.col("vector")))
    return v.select(F.col("id").alias("vec_id"), V.non_finite(F.col("vector")).alias("bad"))
