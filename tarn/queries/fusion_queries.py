"""Fusion of the lexical and the dense list, and the whole hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import fusion as X
from tarn.operators import rank as R
from tarn.operators import vectors as V
from tarn.queries import query
from tarn.queries.lexical_queries import bm25, bm25_sql
from tarn.queries.vector_queries import DIST
from tarn.sources.tables import VECTORS_SQL, sections, table, vectors

POOL = 30
#: Each benchmark item pairs with the vector of its own id; a document's vector is the one of its id.
DENSE_SQL = f"""(SELECT q.id AS qid, c.id AS doc_id, -{DIST} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {DIST}, c.id) - 1 AS rank
  FROM {VECTORS_SQL} q CROSS JOIN {VECTORS_SQL} c WHERE q.id IN (SELECT item_id FROM benchmark) AND q.id <> c.id QUALIFY rank < {POOL})"""
LEX_SQL = bm25_sql(k=POOL)
BOTH_SQL = f"(WITH lx AS {LEX_SQL}, dx AS {DENSE_SQL} SELECT qid, doc_id, l.rank AS lr, l.score AS ls, d.rank AS dr, d.score AS ds FROM lx l FULL JOIN dx d USING (qid, doc_id))"


def lexical_leg(spark, sf):
    return bm25(spark, sf, POOL)


def dense_leg(spark, sf):
    """The nearest vectors by negated distance, the query's own aside."""
    v = vectors(spark, sf)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    asked = v.join(items, "id").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    near = V.knn_blocked(asked, v, POOL + 1).where("qid <> id")
    return X.ranked(near, "distance", "id", k=POOL).select("qid", F.col("id").alias("doc_id"), "rank", (-F.col("distance")).alias("score"))


def both(spark, sf):
    return X.legs(lexical_leg(spark, sf), dense_leg(spark, sf))


def rrf_sql(a: str, b: str) -> str:
    return f"""SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, lr NULLS LAST, dr) - 1 AS rank, score FROM
    (SELECT *, round(coalesce({a} / (61 + lr), 0.0) + coalesce({b} / (61 + dr), 0.0), 12) AS score FROM {BOTH_SQL})"""


@query("fuse_rrf", rrf_sql("1.0", "1.0"))
def fuse_rrf(spark, sf):
    return X.rrf(both(spark, sf))


@query("fuse_wrrf", rrf_sql("0.6", "1.4"))
def fuse_wrrf(spark, sf):
    return X.rrf(both(spark, sf), 0.3)


@query(
    "fuse_rrf3",
    f"""WITH t AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY doc_id DESC) - 1 AS rank FROM (SELECT qid, doc_id FROM {LEX_SQL}) QUALIFY rank < 10), x AS {BOTH_SQL},
    b AS (SELECT coalesce(x.qid, t.qid) AS qid, coalesce(x.doc_id, t.doc_id) AS doc_id, lr, dr, t.rank AS tr FROM x FULL JOIN t ON x.qid = t.qid AND x.doc_id = t.doc_id)
    SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, lr NULLS LAST, dr NULLS LAST, tr) - 1 AS rank, score FROM
    (SELECT *, round(0.0::DOUBLE + coalesce(1.0 / (61 + lr), 0.0) + coalesce(1.0 / (61 + dr), 0.0) + coalesce(1.0 / (61 + tr), 0.0), 12) AS score FROM b)""",
)
def fuse_rrf3(spark, sf):
    """Three lists, the lexical one first; the third is the lexical pool by descending id."""
    lex = lexical_leg(spark, sf)
    third = X.ranked(lex, F.desc("doc_id"), k=10)
    return X.rrf_many([lex, dense_leg(spark, sf), third])


@query(
    "rrf_merge_sources",
    """WITH s AS (SELECT conv_id AS qid, turn AS key, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS rank FROM conversations),
    k AS (SELECT qid, key % 3 AS key, min(rank) AS rank, role FROM s GROUP BY ALL)
    SELECT qid, key, round(sum(1.0 / (61 + rank)), 9) AS score, arg_min(role, (rank, role)) AS payload FROM k GROUP BY qid, key""",
)
def rrf_merge_sources(spark, sf):
    """Any number of lists merged by key; the first item's payload is kept."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), "turn", "role")
    from pyspark.sql import Window as W

    s = c.withColumn("rank", F.row_number().over(W.partitionBy("qid", "role").orderBy("turn")) - 1)
    k = s.groupBy("qid", (F.col("turn") % 3).alias("key"), "role").agg(F.min("rank").alias("rank"))
    return k.groupBy("qid", "key").agg(F.round(F.sum(1.0 / (F.col("rank") + 61)), 9).alias("score"), F.min_by("role", F.struct("rank", "role")).alias("payload"))


def norm_sql(name: str, expr: str) -> str:
    return f"SELECT qid, doc_id, round({expr}, 6) AS norm FROM (SELECT *, min(score) OVER q AS lo, max(score) OVER q AS hi, avg(score) OVER q AS mu, stddev_pop(score) OVER q AS sd FROM {LEX_SQL} WINDOW q AS (PARTITION BY qid))"


MINMAX = "CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / nullif(hi - lo, 0) END"


@query("norm_minmax", norm_sql("minmax", MINMAX))
def norm_minmax(spark, sf):
    return lexical_leg(spark, sf).select("qid", "doc_id", F.round(X.minmax(F.col("score")), 6).alias("norm"))


@query("norm_zscore", norm_sql("zscore", "CASE WHEN sd = 0 THEN 0.5 ELSE (score - mu) / nullif(sd, 0) END"))
def norm_zscore(spark, sf):
    return lexical_leg(spark, sf).select("qid", "doc_id", F.round(X.zscore(F.col("score")), 6).alias("norm"))


@query("norm_tmin", norm_sql("tmin", "CASE WHEN hi <= 0 THEN 0.0 ELSE greatest(score, 0) / nullif(hi, 0) END"))
def norm_tmin(spark, sf):
    return lexical_leg(spark, sf).select("qid", "doc_id", F.round(X.theoretical_min(F.col("score"), 0.0), 6).alias("norm"))


def convex_sql(alpha: float, leg_min: bool, k: int = POOL) -> str:
    fill = lambda c: f"coalesce({c}, {f'min({c}) OVER (PARTITION BY qid)' if leg_min else '0.0'}, 0.0)"
    return f"""(WITH h AS (SELECT *, max(ls) OVER (PARTITION BY qid) AS hi, max(ds) OVER (PARTITION BY qid) AS dhi FROM {BOTH_SQL}),
    n AS (SELECT *, CASE WHEN lr IS NULL THEN NULL WHEN hi <= 0 THEN 0.0 ELSE greatest(ls, 0) / hi END AS ln,
      CASE WHEN dr IS NULL THEN NULL WHEN dhi <= -2 THEN 0.0 ELSE (greatest(ds, -2) + 2) / (dhi + 2) END AS dn FROM h),
    s AS (SELECT *, round({alpha} * {fill('ln')} + {1 - alpha} * {fill('dn')}, 9) AS score FROM n)
    SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, least(lr, dr), doc_id) - 1 AS rank, score FROM s QUALIFY rank < {k * 2})"""


def convex(spark, sf, alpha: float, missing: str = "zero"):
    return X.convex(both(spark, sf), alpha, X.theoretical_min(F.col("lex"), 0.0), X.theoretical_min(F.col("dense"), -2.0), missing)


@query("fuse_convex", f"SELECT qid, doc_id, rank, score FROM {convex_sql(0.25, False)}")
def fuse_convex(spark, sf):
    return convex(spark, sf, 0.25)


@query("fuse_convex_legmin", f"SELECT qid, doc_id, rank, score FROM {convex_sql(0.5, True)}")
def fuse_convex_legmin(spark, sf):
    return convex(spark, sf, 0.5, "leg_min")


@query(
    "fuse_rescue",
    f"""WITH h AS (SELECT *, max(ls) OVER q AS hi, bool_or(dr IS NOT NULL) OVER q AS has_dense FROM {BOTH_SQL} WINDOW q AS (PARTITION BY qid)),
    c AS (SELECT *, has_dense AND lr < 3 AND CASE WHEN hi <= 0 THEN 0.0 ELSE ls / hi END >= 0.5 AND coalesce(dr, 20) >= 20 AS strong FROM h),
    s AS (SELECT *, coalesce(strong, false) AND row_number() OVER (PARTITION BY qid, coalesce(strong, false) ORDER BY lr NULLS LAST) <= 2 AS saved FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid, saved ORDER BY CASE WHEN saved THEN lr ELSE dr END NULLS LAST, lr NULLS LAST) - 1 AS own FROM s WHERE NOT has_dense OR dr IS NOT NULL OR saved),
    n AS (SELECT *, count(*) FILTER (WHERE saved) OVER (PARTITION BY qid) AS ns, count(*) FILTER (WHERE NOT saved) OVER (PARTITION BY qid) AS nr FROM r)
    SELECT qid, doc_id, (CASE WHEN saved THEN least(5, nr) + own ELSE own + CASE WHEN own >= least(5, nr) THEN ns ELSE 0 END END)::BIGINT AS rank FROM n""",
)
def fuse_rescue(spark, sf):
    return X.rescue(both(spark, sf), X.theoretical_min(F.col("lex"), 0.0)).select("qid", "doc_id", "rank")


@query(
    "fusion_grid",
    " UNION ALL ".join(f"SELECT 'hybrid:convex@{a}' AS system, qid, doc_id, rank FROM {convex_sql(a, False)} WHERE rank < 5" for a in (0.0, 0.5))
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'hybrid:wrrf@{w}' AS system, qid, doc_id, rank FROM ({rrf_sql(str(2 * w), str(2 - 2 * w))}) WHERE rank < 5" for w in (0.25, 0.75)),
)
def fusion_grid(spark, sf):
    """Several fusions of the same two pools, which are computed once."""
    from tarn.plans.scratch import cut

    pools = cut(both(spark, sf), "pools")
    lex, dense = X.theoretical_min(F.col("lex"), 0.0), X.theoretical_min(F.col("dense"), -2.0)
    systems = {f"hybrid:convex@{a}": X.convex(pools, a, lex, dense) for a in (0.0, 0.5)} | {f"hybrid:wrrf@{w}": X.rrf(pools, w) for w in (0.25, 0.75)}
    out = None
    for name, rows in systems.items():
        part = rows.where("rank < 5").select(F.lit(name).alias("system"), "qid", "doc_id", "rank")
        out = part if out is None else out.unionAll(part)
    return out


HYBRID_SQL = f"""(WITH f AS (SELECT qid, doc_id, rank, score, lang || '-' || source AS slug FROM {convex_sql(0.25, False)} JOIN documents USING (doc_id)),
    v AS (SELECT *, round(1.0 / (61 + rank) * pow(0.7, row_number() OVER (PARTITION BY qid, slug ORDER BY rank) - 1), 12) AS value FROM f)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY value DESC, rank) - 1 AS pos, doc_id, slug, score FROM v QUALIFY pos < 10)"""


def hybrid(spark, sf, limit: int = 10):
    """BM25 and exact vectors, convex fusion, slug decay, cut."""
    fused = convex(spark, sf, 0.25)
    slugs = sections(spark, sf).select(F.col("id").alias("doc_id"), "slug")
    return R.slug_decay(fused.join(slugs, "doc_id"), 0.7, limit).select("qid", "pos", "doc_id", "slug", "score")


@query("hybrid_search", f"SELECT qid, pos, doc_id, slug, score FROM {HYBRID_SQL}")
def hybrid_search(spark, sf):
    return hybrid(spark, sf)


@query(
    "served_search",
    f"""WITH r AS (SELECT h.*, CASE WHEN h.doc_id % 7 = 0 THEN 'restricted' ELSE 'public' END AS s FROM {HYBRID_SQL} h),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid, slug, s ORDER BY pos) AS nth FROM r)
    SELECT qid, slug, s = 'restricted' AS notice, CASE WHEN s <> 'restricted' THEN doc_id END AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS pos FROM n WHERE s <> 'restricted' OR nth = 1""",
)
def served_search(spark, sf):
    """Hybrid search with restricted rows turned into one notice a slug."""
    rows = hybrid(spark, sf).withColumnRenamed("pos", "rank").withColumn("sensitivity", F.when(F.col("doc_id") % 7 == 0, "restricted").otherwise("public"))
    kept = X.ranked(R.restrict(rows).drop("sensitivity").withColumnRenamed("rank", "was"), "was")
    return kept.select("qid", "slug", "notice", "doc_id", F.col("rank").alias("pos"))


@query(
    "retrieve_all_systems",
    f"""WITH a AS (SELECT 'bm25' AS system, qid, rank AS pos, doc_id FROM {LEX_SQL} WHERE rank < 10 UNION ALL SELECT 'dense', qid, rank, doc_id FROM {DENSE_SQL} WHERE rank < 10 UNION ALL SELECT 'hybrid', qid, pos, doc_id FROM {HYBRID_SQL})
    SELECT system, qid, pos::BIGINT AS pos, doc_id FROM a WHERE NOT (system = 'dense' AND qid % 2 = 0)""",
)
def retrieve_all_systems(spark, sf):
    """Every system from one deep read a leg; finished (system, query) keys are skipped."""
    from tarn.plans.scratch import cut

    lex, dense = cut(lexical_leg(spark, sf), "lex"), cut(dense_leg(spark, sf), "dense")
    fused = X.convex(X.legs(lex, dense), 0.25, X.theoretical_min(F.col("lex"), 0.0), X.theoretical_min(F.col("dense"), -2.0))
    slugs = sections(spark, sf).select(F.col("id").alias("doc_id"), "slug")
    picked = R.slug_decay(fused.join(slugs, "doc_id"), 0.7, 10)
    named = lambda d, n, pos: d.select(F.lit(n).alias("system"), "qid", F.col(pos).alias("pos"), "doc_id")
    rows = named(lex.where("rank < 10"), "bm25", "rank").unionAll(named(dense.where("rank < 10"), "dense", "rank")).unionAll(named(picked, "hybrid", "pos"))
    finished = table(spark, sf, "benchmark").where("item_id % 2 = 0").select(F.lit("dense").alias("system"), F.col("item_id").alias("qid"))
    return rows.join(finished, ["system", "qid"], "left_anti")


@query("anti_finished", "SELECT event_type AS system, user_id AS qid, count(*)::BIGINT AS n FROM events WHERE (event_type, user_id) NOT IN (SELECT event_type, user_id FROM events WHERE event_type = 'error') GROUP BY ALL")
def anti_finished(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("system"), F.col("user_id").alias("qid"))
    done = e.where("system = 'error'").distinct()
    return e.join(done, ["system", "qid"], "left_anti").groupBy("system", "qid").agg(F.count("*").alias("n"))
