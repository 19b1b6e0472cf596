"""Re-ranking, selection, demotion and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import fusion as X
from tarn.operators import rank as R
from tarn.queries import query
from tarn.queries.lexical_queries import SPLIT, bm25, bm25_sql
from tarn.plans.scratch import cut
from tarn.sources.tables import SECTIONS_SQL, TEXT_QUERIES_SQL, sections, table, text_queries

B = bm25_sql(k=20)
ROWS_SQL = f"(SELECT b.*, s.slug, s.title, s.heading, s.content FROM {B} b JOIN {SECTIONS_SQL} s ON s.id = b.doc_id)"


def pool(spark, sf, k: int = 20):
    """The lexical pool with its sections."""
    return bm25(spark, sf, k).join(sections(spark, sf).withColumnRenamed("id", "doc_id"), "doc_id")


#: A deterministic stand-in for a neural scorer: shared words over the text length.
RERANKED_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rr DESC, rank) - 1 AS pos FROM (SELECT r.*, round(len(list_intersect(list_distinct({SPLIT.format('query')}), list_distinct({SPLIT.format('content')}))) / (10.0 + ln(1.0 + length(content))), 9) AS rr FROM {ROWS_SQL} r JOIN {TEXT_QUERIES_SQL} USING (qid)))"""


def stub(query, content):
    from tarn.functions.text import query_tokens

    return F.round(F.size(F.array_intersect(query_tokens(query), query_tokens(content))) / (10.0 + F.log(1.0 + F.length(content))), 9)


def reranked(spark, sf):
    rows = pool(spark, sf).join(text_queries(spark, sf), "qid")
    return R.rerank(rows, stub(F.col("query"), F.col("content")))


@query("rerank_stub", f"SELECT qid, doc_id, pos, rr AS score FROM {RERANKED_SQL}")
def rerank_stub(spark, sf):
    return reranked(spark, sf).select("qid", "doc_id", "pos", F.col("rerank").alias("score"))


@query("rerank_model")
def rerank_model(spark, sf):
    """The pool by a linear model that learned from the judgements of every other query; scores rounded."""
    from tarn.operators.rerank import LinearModel, rerank
    from tarn.sources.tables import containment_qrels

    rows = pool(spark, sf).select("qid", "rank", "doc_id", F.col("content").alias("text")).join(text_queries(spark, sf), "qid")
    rows = cut(rows, "pool")
    judged = rows.where("qid % 2 = 1").join(containment_qrels(spark, sf), ["qid", "doc_id"], "left").withColumn("label", F.coalesce("grade", F.lit(0)))
    model = LinearModel.fit(judged)
    return rerank(rows, lambda: model).select("qid", "doc_id", "rank", "pos", F.round("rerank", 6).alias("score"), "fallback")


@query("rerank_text", f"SELECT id, title || ' — ' || heading || chr(10) || left(content, 2000) AS text FROM {SECTIONS_SQL}")
def rerank_text(spark, sf):
    named = F.coalesce(F.nullif("title", F.lit("")), F.col("slug"))
    return sections(spark, sf).select("id", F.concat(named, F.lit(" — "), "heading", F.lit("\n"), F.substring("content", 1, 2000)).alias("text"))


def z_sql(c: str) -> str:
    return f"CASE WHEN stddev_pop({c}) OVER q <= 1e-9 * greatest(1.0, abs(avg({c}) OVER q)) THEN 0.0 ELSE ({c} - avg({c}) OVER q) / nullif(stddev_pop({c}) OVER q, 0) END"


@query("blend_scores", f"SELECT qid, doc_id, round(blended, 4) AS blended FROM (SELECT *, 0.5 * {z_sql('rr')} + 0.5 * {z_sql('score')} AS blended FROM {RERANKED_SQL} WINDOW q AS (PARTITION BY qid))")
def blend_scores(spark, sf):
    rows = R.blend(reranked(spark, sf).drop("pos"), F.col("rerank"), F.col("score"), 0.5)
    return rows.select("qid", "doc_id", F.round("blended", 4).alias("blended"))


@query(
    "rerank_fill_tail",
    f"WITH h AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rr DESC, rank) - 1 AS pos FROM {RERANKED_SQL} WHERE rank < 5) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY h.pos NULLS LAST, b.rank) - 1 AS pos FROM {B} b LEFT JOIN h USING (qid, doc_id)",
)
def rerank_fill_tail(spark, sf):
    rows = pool(spark, sf)
    head = R.rerank(rows.where("rank < 5").join(text_queries(spark, sf), "qid"), stub(F.col("query"), F.col("content"))).select("qid", "doc_id", "pos")
    return R.splice(head, rows.select("qid", "doc_id", "rank")).select("qid", "doc_id", "pos")


DECAY_SQL = f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value DESC, rank) - 1 AS pos FROM (SELECT *, round(1.0 / (61 + rank) * pow(0.5, row_number() OVER (PARTITION BY qid, slug ORDER BY rank) - 1), 12) AS value FROM {ROWS_SQL}) QUALIFY pos < 5)"


@query("slug_decay", f"SELECT qid, doc_id, slug, pos FROM {DECAY_SQL}")
def slug_decay(spark, sf):
    return R.slug_decay(pool(spark, sf), 0.5, 5).select("qid", "doc_id", "slug", "pos")


@query("decay_stats", f"WITH p AS (SELECT qid, count(*)::BIGINT AS pool, count(DISTINCT slug)::BIGINT AS slugs FROM {ROWS_SQL} GROUP BY qid), d AS (SELECT qid, count(*) FILTER (WHERE rank >= 5)::BIGINT AS displaced FROM {DECAY_SQL} GROUP BY qid) SELECT qid, pool, slugs, displaced FROM p JOIN d USING (qid)")
def decay_stats(spark, sf):
    rows = pool(spark, sf).select("qid", "doc_id", "slug", "rank")
    whole = rows.groupBy("qid").agg(F.count("*").alias("pool"), F.countDistinct("slug").alias("slugs"))
    moved = R.slug_decay(rows, 0.5, 5).groupBy("qid").agg(F.sum((F.col("rank") >= 5).cast("long")).alias("displaced"))
    return whole.join(moved, "qid")


EDGES_SQL = "(SELECT DISTINCT lang || '-' || source AS src, lang || '-src' || (doc_id % 20) AS dst FROM documents WHERE doc_id % 9 = 0 AND source <> 'src' || (doc_id % 20) UNION SELECT DISTINCT lang || '-' || source, 'en-src' || (doc_id % 7) FROM documents WHERE doc_id % 11 = 0 AND lang || '-' || source <> 'en-src' || (doc_id % 7))"


def edges(spark, sf):
    """A link graph over the notes' slugs, derived from ids."""
    d = table(spark, sf, "documents")
    slug = F.concat_ws("-", "lang", "source")
    a = d.where("doc_id % 9 = 0").select(slug.alias("src"), F.concat("lang", F.lit("-src"), (F.col("doc_id") % 20).cast("string")).alias("dst"))
    b = d.where("doc_id % 11 = 0").select(slug.alias("src"), F.concat(F.lit("en-src"), (F.col("doc_id") % 7).cast("string")).alias("dst"))
    return a.unionAll(b).where("src <> dst").distinct()


@query(
    "link_expand",
    f"""WITH p AS (SELECT qid, doc_id, slug, rank FROM {ROWS_SQL} WHERE rank < 6), f AS (SELECT qid, slug, min(rank) AS at_rank FROM p GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY at_rank) AS n FROM f QUALIFY n <= 3),
    x AS (SELECT qid, n, 0 AS way, dst AS slug FROM s JOIN {EDGES_SQL} e ON s.slug = e.src UNION ALL SELECT qid, n, 1, src FROM s JOIN {EDGES_SQL} e ON s.slug = e.dst),
    g AS (SELECT qid, slug, min(way * 10 + n) AS first FROM x WHERE (qid, slug) NOT IN (SELECT qid, slug FROM f) GROUP BY ALL),
    k AS (SELECT slug, min(id) AS doc_id FROM {SECTIONS_SQL} GROUP BY slug)
    SELECT qid, slug, doc_id, row_number() OVER (PARTITION BY qid ORDER BY first, slug) - 1 AS pos FROM g JOIN k USING (slug) QUALIFY pos < 10""",
)
def link_expand(spark, sf):
    rows = pool(spark, sf, 6).select("qid", "doc_id", "slug", "rank")
    return R.expand_links(rows, sections(spark, sf).select("id", "slug"), edges(spark, sf))


FRESH = "(SELECT *, doc_id % 5 = 0 AS superseded, DATE '2024-01-01' + (doc_id % 200)::INT AS valid_until, score - 3 AS s FROM {})"
MULT = "least(CASE WHEN superseded THEN 0.5 ELSE 1.0 END, CASE WHEN DATE '2024-04-01' > valid_until THEN 0.25 ELSE 1.0 END)"


@query("freshness_demote", f"SELECT qid, doc_id, round(v, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(v, 9) DESC, rank) - 1 AS pos FROM (SELECT *, CASE WHEN s >= 0 THEN s * {MULT} ELSE s / {MULT} END AS v FROM {FRESH.format(B)})")
def freshness_demote(spark, sf):
    """Demotion after the cut; a negative score is divided, so that it falls too."""
    rows = bm25(spark, sf, 20).withColumn("valid_until", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")))
    m = R.demotion(F.col("doc_id") % 5 == 0, F.col("valid_until"), F.lit("2024-04-01").cast("date"))
    rows = rows.withColumn("score", F.round(R.scaled(F.col("score") - 3, m), 9)).withColumnRenamed("rank", "was")
    return X.ranked(rows, F.desc("score"), "was").select("qid", "doc_id", "score", F.col("rank").alias("pos"))


NOTES_REL = "(SELECT 'n' || doc_id || '.md' AS path, 'n' || doc_id AS slug, CASE doc_id % 3 WHEN 0 THEN 'n' || (doc_id + 1 + doc_id % 2) WHEN 1 THEN 'n' || doc_id END AS old, CASE WHEN doc_id % 7 = 0 THEN 'z' END AS superseded_by FROM documents) AS n"


@query("supersession", f"WITH n AS (SELECT * FROM {NOTES_REL}), h AS (SELECT old AS slug, arg_min(slug, path) AS heir FROM n WHERE old <> slug GROUP BY old) SELECT path, n.slug, coalesce(superseded_by, heir) AS superseded_by FROM n LEFT JOIN h USING (slug)")
def supersession(spark, sf):
    from tarn.queries import derived

    n = derived(spark, sf, NOTES_REL).withColumn("supersedes", F.when(F.col("old").isNotNull(), F.array("old")))
    return R.propagate_supersession(n)


@query(
    "age_label",
    """WITH d AS (SELECT event_id, greatest(date_diff('day', ts::DATE, DATE '2024-01-25') * 20, 0)::BIGINT AS d FROM events)
    SELECT event_id, d AS days, CASE WHEN d = 0 THEN 'today' WHEN d < 30 THEN d || CASE WHEN d = 1 THEN ' day ago' ELSE ' days ago' END
      WHEN d < 365 THEN (d // 30) || CASE WHEN d // 30 = 1 THEN ' month ago' ELSE ' months ago' END ELSE (d // 365) || CASE WHEN d // 365 = 1 THEN ' year ago' ELSE ' years ago' END END AS label FROM d""",
)
def age_label(spark, sf):
    days = F.greatest(F.datediff(F.lit("2024-01-25").cast("date"), F.col("ts").cast("date")) * 20, F.lit(0)).cast("long")
    return table(spark, sf, "events").select("event_id", days.alias("days")).select("event_id", "days", R.age_label(F.col("days")).alias("label"))


@query("abstain", f"SELECT qid, round(1 / (1 + exp(-(1.5 * score - 6))), 6) AS confidence, 1 / (1 + exp(-(1.5 * score - 6))) < 0.9 AS abstain FROM {B} WHERE rank = 0")
def abstain(spark, sf):
    top = bm25(spark, sf, 20).where("rank = 0").withColumn("c", R.confidence(F.col("score"), 1.5, -6.0))
    return top.select("qid", F.round("c", 6).alias("confidence"), R.abstains(F.col("c"), 0.9).alias("abstain"))


@query("restricted_filter", f"SELECT qid, slug, rank, s AS notice, CASE WHEN NOT s THEN doc_id END AS doc_id FROM (SELECT *, doc_id % 3 = 0 AS s, row_number() OVER (PARTITION BY qid, slug, doc_id % 3 = 0 ORDER BY rank) AS nth FROM {ROWS_SQL}) WHERE NOT s OR nth = 1")
def restricted_filter(spark, sf):
    rows = pool(spark, sf).select("qid", "doc_id", "slug", "rank", F.when(F.col("doc_id") % 3 == 0, "restricted").otherwise("public").alias("sensitivity"))
    return R.restrict(rows).select("qid", "slug", "rank", "notice", "doc_id")


@query(
    "evidence_label",
    f"""WITH r AS (SELECT r.*, CASE qid % 4 WHEN 0 THEN replace(slug, '-', ' ') WHEN 1 THEN title WHEN 2 THEN heading ELSE query END AS q FROM {ROWS_SQL} r JOIN {TEXT_QUERIES_SQL} USING (qid)),
    t AS (SELECT *, {SPLIT.format('q')} AS w, {SPLIT.format('title')} AS tt, {SPLIT.format('content')} AS tc FROM r)
    SELECT qid, doc_id, CASE WHEN array_to_string(w, '-') = lower(slug) THEN 'slug-exact/exists' WHEN w = tt THEN 'title-exact/exists' WHEN len(w) > 0 AND list_has_all(tt, w) THEN 'title-terms/probable'
      WHEN list_contains(w, lower(heading)) THEN 'anchor-section/probable' WHEN len(w) > 0 AND list_has_all(tc, w) THEN 'body-fts/probable' ELSE 'none/unknown' END AS evidence FROM t""",
)
def evidence_label(spark, sf):
    rows = pool(spark, sf).join(text_queries(spark, sf), "qid")
    q = F.when(F.col("qid") % 4 == 0, F.translate("slug", "-", " ")).when(F.col("qid") % 4 == 1, F.col("title")).when(F.col("qid") % 4 == 2, F.col("heading")).otherwise(F.col("query"))
    return rows.select("qid", "doc_id", R.evidence(q, F.col("slug"), F.col("title"), F.col("heading"), F.col("content")).alias("evidence"))


USED = f"(SELECT *, sum(length(content) + 60) OVER (PARTITION BY qid ORDER BY rank) AS used FROM {ROWS_SQL})"


@query("token_budget", f"SELECT qid, doc_id, used::BIGINT AS used FROM {USED} WHERE used <= 8000")
def token_budget(spark, sf):
    return R.token_budget(pool(spark, sf), F.length("content"), 2000).select("qid", "doc_id", "used")


FP = "trim(regexp_replace(lower(left(content, 100)), '\\s+', ' ', 'g'))"


@query("dedup_fingerprint", f"SELECT qid, doc_id FROM (SELECT *, CASE WHEN length({FP}) > 0 THEN {FP} ELSE slug END AS fp FROM {ROWS_SQL} WHERE score >= 0.01) WHERE length(fp) > 0 QUALIFY row_number() OVER (PARTITION BY qid, fp ORDER BY rank) = 1")
def dedup_fingerprint(spark, sf):
    return R.dedup(pool(spark, sf).where("score >= 0.01"), F.col("content"), F.col("slug")).select("qid", "doc_id")


@query("fold_units", f"SELECT qid, slug AS unit, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) - 1 AS rank FROM {ROWS_SQL} GROUP BY qid, slug")
def fold_units(spark, sf):
    return R.fold_units(pool(spark, sf), "slug")


@query("rank_scores", f"SELECT qid, doc_id, (count(*) OVER (PARTITION BY qid) - rank)::BIGINT AS score FROM {B}")
def rank_scores(spark, sf):
    """Scores for export that follow from the rank alone."""
    from pyspark.sql import Window as W

    return bm25(spark, sf, 20).select("qid", "doc_id", (F.count("*").over(W.partitionBy("qid")) - F.col("rank")).alias("score"))


@query(
    "context_assembly",
    f"""WITH d AS (SELECT *, {FP} AS fp FROM {USED} WHERE score >= 0.01 AND used <= 8000) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS pos FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid, fp ORDER BY rank) = 1)""",
)
def context_assembly(spark, sf):
    """Threshold, budget, then duplicates out."""
    kept = R.dedup(R.token_budget(pool(spark, sf).where("score >= 0.01"), F.length("content"), 2000), F.col("content"), F.col("slug"))
    return X.ranked(kept.withColumnRenamed("rank", "was"), "was").select("qid", "doc_id", F.col("rank").alias("pos"))


LIMITS = "(SELECT CASE n_chars % 6 WHEN 0 THEN NULL WHEN 1 THEN 'ten' ELSE '' || (n_chars % 130 - 5) END AS asked, n_chars % 2 = 0 AS rerank, n_chars % 50 AS depth FROM documents) AS l"


@query("pool_sizes", f"WITH c AS (SELECT *, CASE WHEN try_cast(asked AS BIGINT) IS NULL THEN 10 ELSE greatest(1, least(try_cast(asked AS BIGINT), 100)) END AS n FROM {LIMITS}) SELECT asked, n::BIGINT AS n, (CASE WHEN rerank THEN greatest(2 * n, depth) ELSE 2 * n END)::BIGINT AS pool FROM c")
def pool_sizes(spark, sf):
    """Limits as asked for, clamped, and the pools that serve them."""
    from tarn.queries import derived

    clamped = derived(spark, sf, LIMITS).withColumn("n", R.clamp_limit(F.col("asked")))
    return clamped.select("asked", "n", R.pool_size(F.col("n"), F.col("rerank"), F.col("depth")).alias("pool"))
