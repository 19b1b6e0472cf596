"""Ranking metrics and aggregates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators import metrics as M
from tarn.queries import query
from tarn.queries.lexical_queries import bm25, bm25_sql
from tarn.sources.tables import QRELS_SQL, containment_qrels, table

RUN = bm25_sql(k=10)


def ndcg_sql(run: str) -> str:
    return f"""(WITH j AS (SELECT r.qid, sum(g.grade / log2(r.rank + 2.0)) AS dcg FROM {run} r JOIN {QRELS_SQL} g ON g.qid = r.qid AND g.doc_id = r.doc_id GROUP BY r.qid),
    i AS (SELECT qid, sum(grade / log2(i + 2.0)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) - 1 AS i FROM {QRELS_SQL}) WHERE i < 10 GROUP BY qid)
    SELECT i.qid, coalesce(dcg, 0.0) / idcg AS ndcg FROM i LEFT JOIN j USING (qid))"""


NDCG_SQL = ndcg_sql(RUN)


@query("ndcg10", f"SELECT qid, round(ndcg, 6) AS ndcg FROM {NDCG_SQL}")
def ndcg10(spark, sf):
    return M.ndcg(bm25(spark, sf), containment_qrels(spark, sf)).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query(
    "recall_any_all",
    f"""WITH f AS (SELECT g.qid, count(*) AS n, min(r.rank) AS first, {', '.join(f'count(*) FILTER (WHERE r.rank < {k}) AS h{k}' for k in (1, 3, 5, 10))}
      FROM {QRELS_SQL} g LEFT JOIN {RUN} r ON g.qid = r.qid AND g.doc_id = r.doc_id GROUP BY g.qid)
    SELECT qid, {', '.join(f'round(h{k} / n::DOUBLE, 6) AS recall{k}, h{k} > 0 AS any{k}, h{k} = n AS all{k}' for k in (1, 3, 5, 10))}, round(coalesce(1.0 / (first + 1), 0.0), 6)::DOUBLE AS mrr FROM f""",
)
def recall_any_all(spark, sf):
    m = M.binary_metrics(bm25(spark, sf), containment_qrels(spark, sf))
    return m.withColumns({c: F.round(c, 6) for c, t in m.dtypes if t == "double"})


GOLD = f"(SELECT r.qid, r.rank, d.lang AS slug FROM {RUN} r JOIN documents d USING (doc_id))"


@query(
    "golden_metrics",
    f"""WITH f AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN 'easy' ELSE 'hard' END AS bucket, min(rank) FILTER (WHERE slug = CASE qid % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END) AS first FROM {GOLD} GROUP BY qid)
    SELECT bucket, count(*)::BIGINT AS n, {', '.join(f'round(avg((coalesce(first, 99) < {k})::INT), 6) AS recall{k}' for k in (1, 3, 5))}, round(avg(coalesce(1.0 / (first + 1), 0.0)), 6) AS mrr FROM f GROUP BY bucket""",
)
def golden_metrics(spark, sf):
    """First row whose slug is accepted, by bucket."""
    want = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("qid") % 4 + 1).cast("int"))
    rows = bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    first = rows.groupBy("qid").agg(F.min(F.when(F.col("lang") == want, F.col("rank"))).alias("first"))
    first = first.withColumn("bucket", F.when(F.col("qid") % 2 == 0, "easy").otherwise("hard"))
    hit = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) < k).cast("int")), 6).alias(f"recall{k}")
    return first.groupBy("bucket").agg(F.count("*").alias("n"), hit(1), hit(3), hit(5), F.round(F.avg(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0))), 6).alias("mrr"))


CASES = "(SELECT doc_id AS id, 'n' || (doc_id % 80) AS target, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'n' || (doc_id % 11) || ',' || source END AS more FROM documents) AS c"
FAMILIES = "(SELECT n_nationkey AS i, 'n' || n_nationkey || ',n' || (n_nationkey + 30) || ',src' || (n_nationkey % 12) AS members FROM nation) AS f"


@query(
    "accept_set",
    f"""WITH a AS (SELECT id, list_filter(list_concat([target], string_split(more, ',')), lambda s: s <> '') AS s0 FROM {CASES}),
    f AS (SELECT list(string_split(members, ',') ORDER BY i) AS fs FROM {FAMILIES}),
    r AS (SELECT id, list_reduce(list_concat([s0], fs), lambda acc, m: CASE WHEN list_has_any(acc, m) THEN list_distinct(list_concat(acc, m)) ELSE acc END) AS s FROM a CROSS JOIN f)
    SELECT id::BIGINT AS id, array_to_string(list_sort(s), ',') AS accepted FROM r""",
)
def accept_set(spark, sf):
    """The target, what else is expected, and every family that shares a member; families are scanned once, in order."""
    from tarn.queries import derived

    cases = derived(spark, sf, CASES).select(F.col("id").cast("long").alias("id"), F.filter(F.concat(F.array("target"), F.split("more", ",")), lambda s: s != "").alias("s"))
    families = derived(spark, sf, FAMILIES).agg(F.array_sort(F.collect_list(F.struct("i", F.split("members", ",").alias("m")))).alias("fs"))
    grown = F.aggregate("fs", F.col("s"), lambda acc, f: F.when(F.arrays_overlap(acc, f["m"]), F.array_union(acc, f["m"])).otherwise(acc))
    return cases.crossJoin(F.broadcast(families)).select("id", F.array_join(F.array_sort(grown), ",").alias("accepted"))


@query("wilson", """WITH g AS (SELECT d.source, sum(quality)::BIGINT AS hits, count(*)::BIGINT AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source)
    SELECT source, hits, n, round(greatest(0, (hits / n + 1.9208 / n - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6)::DOUBLE AS lo, round(least(1, (hits / n + 1.9208 / n + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6)::DOUBLE AS hi FROM (SELECT source, hits::DOUBLE AS hits, n::DOUBLE AS n FROM g)""".replace("SELECT source, hits, n, round", "SELECT source, hits::BIGINT AS hits, n::BIGINT AS n, round"))
def wilson(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").alias("hits"), F.count("*").alias("n"))
    lo, hi = M.wilson(F.col("hits"), F.col("n"))
    return g.select("source", "hits", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


LABELLED = "(SELECT l.doc_id, quality, toxic, lang, source, (n_chars % 97)::DOUBLE AS s FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 97).cast("double").alias("s"))
    return table(spark, sf, "labels").join(d, "doc_id")


@query(
    "auroc",
    f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM {LABELLED})
    SELECT lang, sum(quality)::BIGINT AS n_pos, (count(*) - sum(quality))::BIGINT AS n_neg, round((sum(r) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * (count(*) - sum(quality)), 0), 6)::DOUBLE AS auroc FROM r GROUP BY lang""",
)
def auroc(spark, sf):
    a = M.auroc(labelled(spark, sf), F.col("s"), F.col("quality") == 1, ["lang"])
    return a.withColumn("auroc", F.round("auroc", 6))


ANSWERABLE = f"(SELECT r.qid, max(score) AS s, (r.qid IN (SELECT qid FROM {QRELS_SQL}))::INT AS y FROM {RUN} r GROUP BY r.qid)"


@query(
    "abstain_auroc",
    f"""WITH r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM {ANSWERABLE})
    SELECT sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6)::DOUBLE AS auroc FROM r""",
)
def abstain_auroc(spark, sf):
    """How well the top score tells answerable queries from others."""
    top = bm25(spark, sf).groupBy("qid").agg(F.max("score").alias("s"))
    known = containment_qrels(spark, sf).select("qid").distinct().withColumn("y", F.lit(True))
    a = M.auroc(top.join(known, "qid", "left"), F.col("s"), F.coalesce("y", F.lit(False)))
    return a.withColumn("auroc", F.round("auroc", 6))


@query("aggregate_groups", f"SELECT coalesce(lang, 'all') AS grp, count(*)::BIGINT AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM {LABELLED} WHERE source <> 'src0' GROUP BY GROUPING SETS ((lang), ())")
def aggregate_groups(spark, sf):
    """Means of each group and of all; an excluded group stays out of both."""
    rows = labelled(spark, sf).where("source <> 'src0'")
    return rows.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic")).select(F.coalesce("lang", F.lit("all")).alias("grp"), "n", "quality", "toxic")


@query("macro_mean", f"SELECT count(*)::BIGINT AS sets, round(avg(m), 6) AS macro FROM (SELECT lang, avg(quality) AS m FROM {LABELLED} GROUP BY lang)")
def macro_mean(spark, sf):
    return labelled(spark, sf).groupBy("lang").agg(F.avg("quality").alias("m")).agg(F.count("*").alias("sets"), F.round(F.avg("m"), 6).alias("macro"))


@query("latency_percentiles", "SELECT event_type, count(*)::BIGINT AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    """Percentiles by places in one order of all rows; nothing of a group is gathered."""
    from tarn.operators.stats import percentiles

    e = table(spark, sf, "events")
    p = percentiles(e, "event_type", "value", [0.5, 0.95]).groupBy("event_type").agg(*(F.round(F.max(F.when(F.col("share") == q, F.col("v"))), 6).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum("value"), 6).alias("per_second")).join(p, "event_type").select("event_type", "n", "p50", "p95", "per_second")


@query("percentiles_whole", "SELECT round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM (SELECT l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem)")
def percentiles_whole(spark, sf):
    """The same of a whole table as one group."""
    from tarn.operators.stats import percentiles

    p = percentiles(table(spark, sf, "lineitem").withColumn("all", F.lit(1)), "all", "l_extendedprice", [0.05, 0.5, 0.99])
    return p.agg(*(F.round(F.max(F.when(F.col("share") == q, F.col("v"))), 4).alias(n) for q, n in ((0.05, "p5"), (0.5, "p50"), (0.99, "p99"))))


@query("replay_jaccard", """WITH s AS (SELECT user_id AS q, ts::DATE AS day, list(DISTINCT (props::JSON->>'k')::BIGINT) AS ids, max(event_id) AS seq FROM events WHERE event_type = 'view' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY day DESC) AS n FROM s), p AS (SELECT a.q, a.ids AS x, b.ids AS y FROM r a JOIN r b ON a.q = b.q AND a.n = 1 AND b.n = 2)
    SELECT q, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS jaccard FROM p""")
def replay_jaccard(spark, sf):
    """The two latest captures of each query: Jaccard of their result sets."""
    e = table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("q"), F.col("ts").cast("date").alias("day"), F.get_json_object("props", "$.k").cast("long").alias("id"))
    s = e.groupBy("q", "day").agg(F.collect_set("id").alias("ids"))
    n = s.withColumns({"n": F.row_number().over(W.partitionBy("q").orderBy(F.desc("day"))), "before": F.lead("ids").over(W.partitionBy("q").orderBy(F.desc("day")))})
    j = F.size(F.array_intersect("ids", "before")) / F.size(F.array_union("ids", "before"))
    return n.where("n = 1 AND before IS NOT NULL").select("q", F.round(j, 6).alias("jaccard"))


@query("count_distinct", "SELECT count(*)::BIGINT AS episodes, count(DISTINCT text)::BIGINT AS names FROM documents")
def count_distinct(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("episodes"), F.countDistinct("text").alias("names"))


@query("manifest_summary", "SELECT count(*) FILTER (WHERE source = 'src0')::BIGINT AS rules, count(*) FILTER (WHERE source <> 'src0' AND lang <> 'en')::BIGINT AS entries, count(*) FILTER (WHERE lang = 'en' AND source <> 'src0')::BIGINT AS papers FROM documents")
def manifest_summary(spark, sf):
    some = lambda c: F.sum(F.expr(c).cast("long"))
    return table(spark, sf, "documents").agg(some("source = 'src0'").alias("rules"), some("source <> 'src0' AND lang <> 'en'").alias("entries"), some("lang = 'en' AND source <> 'src0'").alias("papers"))


@query("turn_audit", """WITH r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations)
    SELECT conv_id, t::BIGINT AS user_turn, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS agent, count(*) FILTER (WHERE role = 'system')::BIGINT AS other, count(*) FILTER (WHERE role = 'assistant') >= 1 AND count(*) FILTER (WHERE role = 'system') = 0 AS flagged FROM r WHERE t > 0 GROUP BY ALL""")
def turn_audit(spark, sf):
    """What follows each user turn until the next."""
    n = F.sum((F.col("role") == "user").cast("long")).over(W.partitionBy("conv_id").orderBy("turn"))
    g = table(spark, sf, "conversations").select("conv_id", "turn", "role").withColumn("user_turn", n).where("user_turn > 0").groupBy("conv_id", "user_turn")
    of = lambda r: F.sum((F.col("role") == r).cast("long"))
    return g.agg(of("assistant").alias("agent"), of("system").alias("other"), ((of("assistant") >= 1) & (of("system") == 0)).alias("flagged"))


@query("population", "SELECT count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS clusters, count(*) / count(DISTINCT source)::DOUBLE AS per_cluster FROM documents")
def population(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.countDistinct("source").alias("clusters"), (F.count("*") / F.countDistinct("source")).alias("per_cluster"))
