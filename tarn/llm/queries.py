"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints link at four or fewer differing bits."""
    from tarn.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of every page, written as archives, read back and assembled."""
    from tarn.llm.warc import captures

    whole = captures(_table(spark, sf_dir, "pages"))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d FROM p),
w AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM s)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, true AS complete
FROM w
"""


def _remainder() -> Column:
    """crc32 of the id's digits, modulo five."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every whole text under a byte-context model of the training rows."""
    from tarn.llm.ppm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), _remainder() == 1)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at cosine 0.9 and their components."""
    from tarn.llm.crosspolytope import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.9)


OP4_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON r.v = p.a),
g AS (SELECT v, min(c) AS component_id FROM r GROUP BY v), l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN g ON v.vec_id = g.v LEFT JOIN l ON l.a = v.vec_id
"""

#: Target token shares of the languages.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def domain_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """A classifier of languages, learned from the texts of the labelled table's documents."""
    from tarn.llm.mixing import fit_classifier

    chosen = _table(spark, sf_dir, "labels").select("doc_id").where("doc_id is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    labelled = docs.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most LABELLED ids
    return fit_classifier(labelled, list(TARGETS), domain_col="lang", sample=LABELLED)


#: Labelled documents that the classifier of languages learns from.
LABELLED = 2000


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and the rate of every document that bring the token shares to their targets."""
    from tarn.llm.mixing import fit_rates, memberships, with_rates

    docs = _table(spark, sf_dir, "documents")
    members = memberships(docs, domain_classifier(spark, docs, sf_dir))
    rated = with_rates(members, fit_rates(members, list(TARGETS.values())), len(TARGETS))
    return rated.select("doc_id", "n_tokens", "rate", *(F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(TARGETS)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the unigram reading of a public vocabulary."""
    import public_tokenizers

    from tarn.llm.counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from the labelled rows that are not held out."""
    from tarn.llm.crf import predicted, score_texts, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = score_texts(docs, train(docs, labels.where(_remainder() != 0)))
    held_out = F.coalesce(_remainder() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth, by Euclidean distance."""
    from tarn.llm.crosspolytope import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text, as digests."""
    import public_tokenizers

    from tarn.llm.bpe import round_trip

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every whole text, plain and linked."""
    from tarn.llm.secrets import in_order, scan, shown

    found = scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", "linked"), in_order)).alias("spans"),
    )


def _op10_sql() -> str:
    """The same spans in DuckDB: gaps and matches of each pattern, running positions, and a self-join for linking."""
    from tarn.llm.secrets import ACCESS, ASSIGN, HEX, KINDS, LOGIN, PASS, ROLES, WEAK

    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, unnest(m) AS s, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM "
        f"(SELECT r, regexp_extract_all(t, {quoted(p)}) AS m, string_split_regex(t, {quoted(p)}) AS g FROM d) WHERE len(m) > 0"
        for k, p in enumerate((ASSIGN, ACCESS, HEX, WEAK))
    )
    names = "[" + ", ".join(map(quoted, KINDS)) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({found}),
p AS (SELECT r, kind, s, sum(length(gap) + length(s)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM x),
q AS (SELECT r, CASE kind WHEN 0 THEN CASE WHEN length(regexp_extract(s, {quoted(ASSIGN)}, 2)) >= 8 THEN 0 ELSE 6 END
    WHEN 1 THEN CASE WHEN length(s) >= 16 THEN 1 ELSE 7 END WHEN 2 THEN CASE WHEN length(s) >= 32 THEN 2 ELSE 8 END
    ELSE CASE WHEN regexp_full_match(s, {quoted(LOGIN)}) THEN 4 WHEN regexp_full_match(s, {quoted(PASS)}) THEN 5 ELSE 3 END END AS kind,
  e - length(s) AS b, e FROM p),
a AS (SELECT * FROM q WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM q o WHERE o.r = q.r AND o.kind < 3 AND o.b < q.e AND q.b < o.e)),
c AS (SELECT *, {list(ROLES)}[kind + 1] AS role FROM a),
l AS (SELECT r, kind, b, e FROM c WHERE kind < 3 UNION SELECT w.r, w.kind, w.b, w.e FROM c w JOIN c o ON o.r = w.r AND w.kind >= 3
  AND o.b <= w.e + 400 AND w.b <= o.e + 400 AND NOT (o.b < w.e AND w.b < o.e) AND o.role <> w.role AND 2 IN (o.role, w.role)),
g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
  string_agg({names}[kind + 1] || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, kind) FILTER (WHERE kind < 3) AS base,
  string_agg({names}[kind + 1] || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, kind) AS spans FROM l GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language, scored by their worst cut."""
    from tarn.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"), least=100, most=2000, share=100)


OP11_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(s, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, z AS size, unnest(list_transform(range(1, len(w) - z + 2), lambda i: array_to_string(w[i:i + z - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4), (5)) AS sizes(z) WHERE len(w) >= z),
c AS MATERIALIZED (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM c WHERE size = 1 GROUP BY lang),
o AS MATERIALIZED (SELECT * FROM c WHERE size >= 2 AND f >= 100),
k AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM o),
s AS (SELECT k.lang, k.phrase, k.a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score FROM k JOIN n ON n.lang = k.lang
  JOIN c x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN c y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:k.size], ' ')),
b AS (SELECT lang, phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT a.lang, a.phrase FROM o a JOIN o b ON a.lang = b.lang AND b.size > a.size AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ') AND 100 * b.f >= 100 * a.f),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b ANTI JOIN d ON b.lang = d.lang AND b.phrase = d.phrase)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM t WHERE rank <= 2000
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every document's pieces in sequences of 1,024 tokens."""
    import public_tokenizers

    from tarn.llm.packing import pack

    packed = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two public vocabularies in every whole text, and how common they are in all texts."""
    import public_tokenizers

    from tarn.llm.alignment import align

    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align(_table(spark, sf_dir, "documents"), a, public_tokenizers.PATTERN, b)


QUERIES = {"op5_mixing": op5_mixing, "op9_token_counts": op9_token_counts, "op6_quality": op6_quality, "op3_ppm": op3_ppm, "op4_embedding_dedup": op4_embedding_dedup, "op8_nearest": op8_nearest, "op2_warc": op2_warc, "op10_secrets": op10_secrets, "op1_simhash": op1_simhash, "op7_byte_bpe": op7_byte_bpe, "op11_collocations": op11_collocations, "op12_packing": op12_packing, "op13_alignment": op13_alignment}

ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op4_embedding_dedup": OP4_SQL, "op10_secrets": _op10_sql(), "op11_collocations": OP11_SQL}
