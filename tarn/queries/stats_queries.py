"""Statistics over runs and labels."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.components import connected_components
from tarn.operators import metrics as M
from tarn.operators import stats as S
from tarn.queries import derived, query
from tarn.queries.lexical_queries import bm25, bm25_sql
from tarn.queries.metrics_queries import LABELLED, NDCG_SQL, labelled
from tarn.plans.scratch import cut
from tarn.sources.tables import containment_qrels, table

DRAW = "(('0x' || left(md5({}), 8))::BIGINT / 4294967296.0)"
DIFF_SQL = "(SELECT item_id AS qid, ((item_id * 37 % 101) - 45) / 100.0::DOUBLE AS v, item_id % 6 AS cluster FROM benchmark)"


def diffs(spark, sf):
    """Paired differences of all queries, in six clusters."""
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(i.alias("qid"), ((i * 37 % 101 - 45) / 100.0).alias("v"), (i % 6).alias("cluster"))


@query(
    "bootstrap_ci_hash",
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS i, v FROM {DIFF_SQL}), c AS (SELECT count(*) AS n FROM n),
    m AS (SELECT b, avg(n2.v) AS mean FROM range(200) r(b) CROSS JOIN n n1 CROSS JOIN c JOIN n n2 ON n2.i = floor({DRAW.format("b || ':' || n1.i")} * c.n)::BIGINT GROUP BY b),
    k AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS r FROM m)
    SELECT round(max(mean) FILTER (WHERE r = 5), 6) AS lo, round(max(mean) FILTER (WHERE r = 194), 6) AS hi FROM k""",
)
def bootstrap_ci_hash(spark, sf):
    return S.interval(S.bootstrap_hash(diffs(spark, sf), "v", 200), 200, 6)


@query(
    "permutation_hash",
    f"""WITH o AS (SELECT abs(avg(v)) AS o, count(*) AS n FROM {DIFF_SQL}),
    m AS (SELECT b, sum(CASE WHEN {DRAW.format("b || ':' || qid")} < 0.5 THEN -v ELSE v END) / (SELECT n FROM o) AS m FROM range(500) r(b) CROSS JOIN {DIFF_SQL} GROUP BY b)
    SELECT round((SELECT o FROM o), 6) AS observed, round((count(*) FILTER (WHERE abs(m) >= (SELECT o FROM o) - 1e-9) + 1) / 501.0, 6)::DOUBLE AS p FROM m""",
)
def permutation_hash(spark, sf):
    return S.sign_flip_hash(diffs(spark, sf), "v", 500)


CLUSTERS = f"(SELECT cluster AS qid, sum(v) AS s, count(*) AS n, avg(v) AS v FROM {DIFF_SQL} GROUP BY cluster)"


def clusters(spark, sf):
    return diffs(spark, sf).groupBy(F.col("cluster").alias("qid")).agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.avg("v").alias("v"))


@query("cluster_sums", f"SELECT qid, round(s, 6) AS s, n::BIGINT AS n FROM {CLUSTERS}")
def cluster_sums(spark, sf):
    return clusters(spark, sf).select("qid", F.round("s", 6).alias("s"), "n")


@query(
    "cluster_bootstrap_hash",
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS i, s, n FROM {CLUSTERS}), c AS (SELECT count(*) AS k FROM n),
    m AS (SELECT b, sum(n2.s) / sum(n2.n) AS mean FROM range(200) r(b) CROSS JOIN n n1 CROSS JOIN c JOIN n n2 ON n2.i = floor({DRAW.format("b || ':' || n1.i")} * c.k)::BIGINT GROUP BY b),
    k AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS r FROM m)
    SELECT round(max(mean) FILTER (WHERE r = 5), 4) AS lo, round(max(mean) FILTER (WHERE r = 194), 4) AS hi FROM k""",
)
def cluster_bootstrap_hash(spark, sf):
    """Whole clusters are drawn; the mean is the ratio of their sums to their counts."""
    drawn = S.cluster_means(clusters(spark, sf), 200, ["s", "n"])
    return S.interval(drawn.select("b", (F.col("s") / F.col("n")).alias("mean")), 200)


DRAWN = f"""n AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS i, s, n FROM {CLUSTERS}), c AS (SELECT count(*) AS k FROM n),
    m AS (SELECT b, sum(n2.s) AS s, sum(n2.n) AS n FROM range(200) r(b) CROSS JOIN n n1 CROSS JOIN c JOIN n n2 ON n2.i = floor({DRAW.format("b || ':' || n1.i")} * c.k)::BIGINT GROUP BY b)"""


@query(
    "cluster_bootstrap_p",
    f"""WITH {DRAWN}, o AS (SELECT sum(s) / sum(n) AS o FROM n) SELECT round((SELECT o FROM o), 6) AS observed,
    round((count(*) FILTER (WHERE abs(s / n - (SELECT o FROM o)) >= abs((SELECT o FROM o)) - 1e-9) + 1) / 201.0, 6)::DOUBLE AS p FROM m""",
)
def cluster_bootstrap_p(spark, sf):
    """Two-sided p of the mean difference: resampled means, centred, against the observed one; counts plus one."""
    c = clusters(spark, sf)
    observed = c.agg((F.sum("s") / F.sum("n")).alias("o"))
    means = S.cluster_means(c, 200, ["s", "n"]).crossJoin(F.broadcast(observed))  # one row
    hit = F.sum((F.abs(F.col("s") / F.col("n") - F.col("o")) >= F.abs("o") - 1e-9).cast("long"))
    return means.agg(F.round(F.max("o"), 6).alias("observed"), F.round((hit + 1) / 201, 6).alias("p"))


@query(
    "shared_draws",
    f"""WITH {DRAWN}, k AS (SELECT s / n AS a, s / (n + 2) AS b FROM m), r AS (SELECT a, a - b AS d, row_number() OVER (ORDER BY a) - 1 AS ra, row_number() OVER (ORDER BY a - b) - 1 AS rd FROM k)
    SELECT 'mean' AS metric, round(max(a) FILTER (WHERE ra = 5), 4) AS lo, round(max(a) FILTER (WHERE ra = 194), 4) AS hi FROM r
    UNION ALL SELECT 'shift', round(max(d) FILTER (WHERE rd = 5), 4), round(max(d) FILTER (WHERE rd = 194), 4) FROM r""",
)
def shared_draws(spark, sf):
    """Intervals of two ratios from one set of draws of clusters: a mean, and its difference from a shrunken one."""
    m = S.cluster_means(clusters(spark, sf), 200, ["s", "n"])
    a = F.col("s") / F.col("n")
    of = lambda name, value: S.interval(m.select("b", value.alias("mean")), 200).select(F.lit(name).alias("metric"), "lo", "hi")
    return of("mean", a).unionAll(of("shift", a - F.col("s") / (F.col("n") + 2)))


@query(
    "stratified_bootstrap",
    f"""WITH n AS (SELECT cluster, v, row_number() OVER (PARTITION BY cluster ORDER BY qid) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS n FROM {DIFF_SQL}),
    m AS (SELECT b, avg(y.v) AS mean FROM range(200) r(b) CROSS JOIN n x JOIN n y ON y.cluster = x.cluster AND y.i = floor({DRAW.format("b || ':' || x.cluster || ':' || x.i")} * x.n)::BIGINT GROUP BY b)
    SELECT round(mean, 4) AS lo FROM m QUALIFY row_number() OVER (ORDER BY mean) = 11""",
)
def stratified_bootstrap(spark, sf):
    """Lower five per cent of the mean, resampled within clusters."""
    return S.lower_bound(S.stratified_bootstrap(diffs(spark, sf), "cluster", "v", 200), 200)


@query(
    "swap_permutation",
    f"""WITH d AS (SELECT qid, v - (qid * 53 % 97 - 48) / 100.0::DOUBLE AS v FROM {DIFF_SQL}), o AS (SELECT abs(avg(v)) AS o, count(*) AS n FROM d),
    m AS (SELECT b, sum(CASE WHEN {DRAW.format("b || ':' || qid")} < 0.5 THEN -v ELSE v END) / (SELECT n FROM o) AS m FROM range(500) r(b) CROSS JOIN d GROUP BY b)
    SELECT round((SELECT o FROM o), 6) AS observed, round((count(*) FILTER (WHERE abs(m) >= (SELECT o FROM o) - 1e-9) + 1) / 501.0, 6)::DOUBLE AS p FROM m""",
)
def swap_permutation(spark, sf):
    """Two confidence signals of the same queries compared by swapping them at random."""
    d = diffs(spark, sf).withColumn("w", (F.col("qid") * 53 % 97 - 48) / 100.0)
    return S.swap_permutation(d, "v", "w", 500)


@query(
    "cluster_permutation_hash",
    f"""WITH o AS (SELECT abs(avg(v)) AS o, count(*) AS n FROM {CLUSTERS}),
    m AS (SELECT b, sum(CASE WHEN {DRAW.format("b || ':' || qid")} < 0.5 THEN -v ELSE v END) / (SELECT n FROM o) AS m FROM range(500) r(b) CROSS JOIN {CLUSTERS} GROUP BY b)
    SELECT round((SELECT o FROM o), 6) AS observed, round((count(*) FILTER (WHERE abs(m) >= (SELECT o FROM o) - 1e-9) + 1) / 501.0, 6)::DOUBLE AS p FROM m""",
)
def cluster_permutation_hash(spark, sf):
    """One sign a cluster."""
    return S.sign_flip_hash(clusters(spark, sf), "v", 500)


@query("bootstrap_ci_mt")
def bootstrap_ci_mt(spark, sf):
    """Seeded intervals and permutation p of each cluster's differences, one cluster a task."""
    return S.resampled(diffs(spark, sf).withColumn("system", F.concat(F.lit("s"), (F.col("cluster") % 3).cast("string"))).drop("cluster"), "system", "v")


@query("permutation_mt")
def permutation_mt(spark, sf):
    return bootstrap_ci_mt(spark, sf).select("system", "p")


@query("paired_clusters", f"WITH a AS (SELECT cluster, qid FROM {DIFF_SQL} WHERE qid % 5 <> 0), b AS (SELECT cluster, qid FROM {DIFF_SQL} WHERE qid % 10 <> 0), j AS (SELECT coalesce(a.cluster, b.cluster) AS cluster, a.qid AS x, b.qid AS y FROM a FULL JOIN b ON a.cluster = b.cluster AND a.qid = b.qid) SELECT cluster, count(*)::BIGINT AS n, bool_and(x IS NOT NULL AND y IS NOT NULL) AS matched FROM j GROUP BY cluster")
def paired_clusters(spark, sf):
    """Clusters whose case sets agree on both sides."""
    d = diffs(spark, sf).select("cluster", "qid")
    a, b = d.where("qid % 5 <> 0").withColumn("x", F.lit(True)), d.where("qid % 10 <> 0").withColumn("y", F.lit(True))
    return a.join(b, ["cluster", "qid"], "full_outer").groupBy("cluster").agg(F.count("*").alias("n"), F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("matched"))


@query(
    "paired_drop",
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS i, v FROM {DIFF_SQL}), c AS (SELECT count(*) AS n FROM n),
    m AS (SELECT b, avg(n2.v) AS mean FROM range(200) r(b) CROSS JOIN n n1 CROSS JOIN c JOIN n n2 ON n2.i = floor({DRAW.format("b || ':' || n1.i")} * c.n)::BIGINT GROUP BY b),
    k AS (SELECT round(mean, 6) AS hi FROM m QUALIFY row_number() OVER (ORDER BY mean) = 195), w AS (SELECT count(*) FILTER (WHERE v < 0) AS lost, count(*) FILTER (WHERE v > 0) AS won, count(*) AS n FROM {DIFF_SQL})
    SELECT lost::BIGINT AS lost, won::BIGINT AS won, n::BIGINT AS n, hi, lost - won >= greatest(2, ceil(n * 0.03)) AND hi < 0 AS drop FROM w CROSS JOIN k""",
)
def paired_drop(spark, sf):
    """A drop: net losses of at least three in a hundred (two at least) and an interval wholly below zero."""
    d = diffs(spark, sf)
    ci = S.interval(S.bootstrap_hash(d, "v", 200), 200, 6)
    lost = d.agg(F.sum((F.col("v") < 0).cast("long")).alias("lost"), F.sum((F.col("v") > 0).cast("long")).alias("won"), F.count("*").alias("n"))
    net = F.col("lost") - F.col("won")
    return lost.crossJoin(ci).select("lost", "won", "n", "hi", ((net >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.03))) & (F.col("hi") < 0)).alias("drop"))


@query("sign_test", f"""WITH g AS (SELECT cluster, count(*) FILTER (WHERE v > 0) AS wins, count(*) FILTER (WHERE v < 0) AS losses FROM {DIFF_SQL} GROUP BY cluster)
    SELECT cluster, wins::BIGINT AS wins, losses::BIGINT AS losses, round(least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1)))) / pow(2.0, wins + losses)), 6) AS p FROM g""")
def sign_test(spark, sf):
    g = diffs(spark, sf).groupBy("cluster").agg(F.sum((F.col("v") > 0).cast("long")).alias("wins"), F.sum((F.col("v") < 0).cast("long")).alias("losses"))
    return g.withColumn("p", F.round(S.sign_test(F.col("wins"), F.col("losses")), 6))


@query("cohen_kappa", "WITH j AS (SELECT quality AS a, 1 - toxic AS b FROM labels), o AS (SELECT avg((a = b)::INT) AS po, count(*)::DOUBLE AS n FROM j), x AS (SELECT a AS v, count(*) AS x FROM j GROUP BY a), y AS (SELECT b AS v, count(*) AS y FROM j GROUP BY b), e AS (SELECT sum(x * y) / (SELECT n * n FROM o) AS pe FROM x JOIN y USING (v)) SELECT round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM o CROSS JOIN e")
def cohen_kappa(spark, sf):
    k = S.kappa(table(spark, sf, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b")
    return k.select(*(F.round(c, 6).alias(c) for c in k.columns))


TESTS = "(SELECT source AS name, (3 + sum(doc_id) % 97)::DOUBLE / 997 AS p FROM documents GROUP BY source)"


def tests(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(((F.sum("doc_id") % 97 + 3).cast("double") / 997).alias("p"))


@query("holm", f"WITH r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS raw FROM {TESTS}) SELECT name, p, round(max(raw) OVER (ORDER BY p, name), 9) AS adjusted FROM r")
def holm(spark, sf):
    return S.holm(tests(spark, sf)).withColumn("adjusted", F.round("adjusted", 9))


@query("bh", f"WITH r AS (SELECT *, least(1.0, count(*) OVER () * p / row_number() OVER (ORDER BY p, name)) AS raw FROM {TESTS}) SELECT name, p, round(min(raw) OVER (ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS adjusted FROM r")
def bh(spark, sf):
    return S.benjamini_hochberg(tests(spark, sf)).withColumn("adjusted", F.round("adjusted", 9))


FRIED = "(SELECT source AS block, lang AS system, round(avg(n_chars % 13), 1) AS v FROM documents GROUP BY source, lang)"


RANKS_SQL = f"""r AS (SELECT block, system, rank() OVER (PARTITION BY block ORDER BY v DESC) + (count(*) OVER (PARTITION BY block, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY block) AS k FROM {FRIED}),
    f AS (SELECT * FROM r WHERE k = 4), g AS (SELECT system, avg(r) AS mean_rank, count(*) AS n FROM f GROUP BY system)"""
#: erfc by the midpoint rule
TAIL_SQL = "(2 / sqrt(pi()) * list_sum(list_transform(range(0, 20000), lambda i: exp(-pow(sqrt(chi2 / 2) + (i + 0.5) * 0.0005, 2)) * 0.0005)) + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2))"


@query("friedman_chi2", f"""WITH {RANKS_SQL}, t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT block, r, count(*) AS c FROM f GROUP BY block, r)),
    x AS (SELECT (12.0 * max(n) / (4 * 5) * sum((mean_rank - 2.5) * (mean_rank - 2.5)) / (1 - (SELECT t FROM t) / (max(n) * 60.0)))::DOUBLE AS chi2, max(n)::BIGINT AS blocks FROM g)
    SELECT round(chi2, 6) AS chi2, blocks, round({TAIL_SQL}, 6) AS p FROM x""")
def friedman_chi2(spark, sf):
    """The statistic with its tie correction, over blocks that have every system, and its p of three degrees of freedom."""
    r = system_ranks(spark, sf)
    ties = r.groupBy("block", "avg_rank").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    g = r.groupBy("system").agg(F.avg("avg_rank").alias("m"), F.count("*").alias("n")).agg(F.sum((F.col("m") - 2.5) * (F.col("m") - 2.5)).alias("ss"), F.max("n").alias("n"))
    chi2 = 12.0 * F.col("n") / 20 * F.col("ss") / (1 - F.col("t") / (F.col("n") * 60.0))
    return g.crossJoin(ties).select(chi2.alias("x"), F.col("n").alias("blocks")).select(F.round("x", 6).alias("chi2"), "blocks", F.round(S.chi2_tail(F.col("x"), 3), 6).alias("p"))


def system_ranks(spark, sf):
    v = table(spark, sf, "documents").groupBy(F.col("source").alias("block"), F.col("lang").alias("system")).agg(F.round(F.avg(F.col("n_chars") % 13), 1).alias("v"))
    return S.average_ranks(v, "block", "v").withColumn("k", F.count("*").over(W.partitionBy("block"))).where("k = 4")


@query("nemenyi", f"""WITH {RANKS_SQL} SELECT a.system AS system, b.system AS other, round(a.mean_rank - b.mean_rank, 6)::DOUBLE AS apart, round(2.569 * sqrt(4 * 5 / (6.0 * a.n)), 6)::DOUBLE AS critical,
    abs(a.mean_rank - b.mean_rank) > 2.569 * sqrt(4 * 5 / (6.0 * a.n)) AS differs FROM g a JOIN g b ON a.system < b.system""")
def nemenyi(spark, sf):
    """Pairs of systems whose mean ranks are further apart than the critical difference."""
    g = system_ranks(spark, sf).groupBy("system").agg(F.avg("avg_rank").alias("m"), F.count("*").alias("n"))
    a, b = g.alias("a"), g.alias("b")
    apart, critical = F.col("a.m") - F.col("b.m"), S.critical_difference(4, F.col("a.n"))
    return a.join(b, F.col("a.system") < F.col("b.system")).select(
        F.col("a.system").alias("system"), F.col("b.system").alias("other"), F.round(apart, 6).alias("apart"), F.round(critical, 6).alias("critical"), (F.abs(apart) > critical).alias("differs")
    )


RUN_A, RUN_B = bm25_sql(k=10), bm25_sql("left(text, 500)", 10)


def two_runs(spark, sf):
    return bm25(spark, sf), bm25(spark, sf, field="opening")


@query("kendall_tau", f"""WITH a AS {RUN_A}, b AS {RUN_B}, u AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS d, a.rank AS x, b.rank AS y FROM a FULL JOIN b ON a.qid = b.qid AND a.doc_id = b.doc_id),
    w AS (SELECT qid, d, coalesce(x, max(x) OVER (PARTITION BY qid) + 1) AS x, coalesce(y, max(y) OVER (PARTITION BY qid) + 1) AS y FROM u)
    SELECT p.qid, round(sum(sign(p.x - q.x) * sign(p.y - q.y)) / nullif(sqrt(count(*) FILTER (WHERE p.x <> q.x) * count(*) FILTER (WHERE p.y <> q.y)), 0), 6)::DOUBLE AS tau FROM w p JOIN w q ON p.qid = q.qid AND p.d < q.d GROUP BY p.qid""")
def kendall_tau(spark, sf):
    return S.kendall_tau(*two_runs(spark, sf)).withColumn("tau", F.round("tau", 6))


@query("rank_flips", f"""WITH a AS (SELECT qid, list(doc_id ORDER BY rank) AS x FROM {RUN_A} GROUP BY qid), b AS (SELECT qid, list(doc_id ORDER BY rank) AS y FROM {RUN_B} GROUP BY qid)
    SELECT qid, x <> y AS order_differs, list_sort(x) <> list_sort(y) AS set_differs FROM a JOIN b USING (qid)""")
def rank_flips(spark, sf):
    a, b = two_runs(spark, sf)
    ids = lambda r, n: r.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"]).alias(n))
    j = ids(a, "x").join(ids(b, "y"), "qid")
    return j.select("qid", (F.col("x") != F.col("y")).alias("order_differs"), (F.array_sort("x") != F.array_sort("y")).alias("set_differs"))


@query("platt_fit")
def platt_fit(spark, sf):
    """Logistic calibration of the top score against answerability; the rows are one a query."""
    top = bm25(spark, sf).groupBy("qid").agg(F.max("score").alias("s")).join(containment_qrels(spark, sf).select("qid").distinct().withColumn("y", F.lit(1.0)), "qid", "left").fillna({"y": 0.0})
    top = cut(top, "signals")
    scale, offset = S.platt(top, "s", "y")
    return spark.createDataFrame([(round(float(scale), 6), round(float(offset), 6), top.count())], "scale double, offset double, n long")


PROBS = f"(SELECT doc_id AS qid, s / 97 AS p, quality FROM {LABELLED})"


def probs(spark, sf):
    return labelled(spark, sf).select(F.col("doc_id").alias("qid"), (F.col("s") / 97).alias("p"), F.col("quality"))


@query("ece", f"WITH b AS (SELECT *, ntile(10) OVER (ORDER BY p, qid) AS bin FROM {PROBS}), g AS (SELECT bin, count(*) AS n, avg(p) AS c, avg(quality) AS a FROM b GROUP BY bin) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, count(*)::BIGINT AS bins FROM g")
def ece(spark, sf):
    r = S.reliability(probs(spark, sf), "p", "quality")
    return r.agg(F.round(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n"), 6).alias("ece"), F.count("*").alias("bins"))


@query("risk_coverage", f"WITH r AS (SELECT qid, row_number() OVER o / (count(*) OVER ())::DOUBLE AS coverage, avg(1 - quality) OVER (ORDER BY p DESC, qid ROWS UNBOUNDED PRECEDING) AS risk FROM {PROBS} WINDOW o AS (ORDER BY p DESC, qid)) SELECT qid, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM r")
def risk_coverage(spark, sf):
    r = S.risk_coverage(probs(spark, sf).withColumn("loss", 1 - F.col("quality")), "p", "loss")
    return r.select("qid", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query("aurc", f"WITH r AS (SELECT avg(1 - quality) OVER (ORDER BY p DESC, qid ROWS UNBOUNDED PRECEDING) AS risk, avg(1 - quality) OVER (ORDER BY quality DESC, qid ROWS UNBOUNDED PRECEDING) AS best FROM {PROBS}) SELECT round(avg(risk), 6) AS aurc, round(avg(best), 6) AS oracle FROM r")
def aurc(spark, sf):
    """Area under risk against coverage, and what an oracle's order would give."""
    rows = probs(spark, sf).withColumn("loss", 1 - F.col("quality"))
    own = S.risk_coverage(rows, "p", "loss").agg(F.round(F.avg("risk"), 6).alias("aurc"))
    return own.crossJoin(S.risk_coverage(rows, "quality", "loss").agg(F.round(F.avg("risk"), 6).alias("oracle")))


@query(
    "selective_accuracy",
    f"""WITH r AS (SELECT row_number() OVER (ORDER BY p DESC, qid) AS k, count(*) OVER () AS n, avg(1 - quality) OVER (ORDER BY p DESC, qid ROWS UNBOUNDED PRECEDING) AS risk, avg(1 - quality) OVER (ORDER BY quality DESC, qid ROWS UNBOUNDED PRECEDING) AS best, avg(1 - quality) OVER () AS whole FROM {PROBS})
    SELECT {', '.join(f'round(1 - max(risk) FILTER (WHERE k = greatest(1, ceil({c} * n - 1e-9))), 6) AS at{int(c * 100)}' for c in (0.9, 0.8, 0.7))}, round((max(whole) - avg(risk)) / nullif(max(whole) - avg(best), 0), 6) AS gap_closed FROM r""",
)
def selective_accuracy(spark, sf):
    """Accuracy of the most confident nine, eight and seven tenths, and how far the order goes from a random one to the oracle's."""
    rows = probs(spark, sf).withColumn("loss", 1 - F.col("quality"))
    n, whole = rows.agg(F.count("*"), F.avg("loss")).first()
    place = {c: max(1, math.ceil(c * n - 1e-9)) - 1 for c in (0.9, 0.8, 0.7)}
    at = [F.round(1 - F.max(F.when(F.round(F.col("coverage") * n) == i + 1, F.col("risk"))), 6).alias(f"at{int(c * 100)}") for c, i in place.items()]
    own = S.risk_coverage(rows, "p", "loss").agg(*at, F.avg("risk").alias("area"))
    best = S.risk_coverage(rows, "quality", "loss").agg(F.avg("risk").alias("best"))
    gap = (F.lit(whole) - F.col("area")) / F.nullif(F.lit(whole) - F.col("best"), F.lit(0.0))
    return own.crossJoin(best).select(*(f"at{int(c * 100)}" for c in place), F.round(gap, 6).alias("gap_closed"))


@query("confidence_signals", f"""WITH r AS {RUN_A}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM r), p AS (SELECT *, e / sum(e) OVER (PARTITION BY qid) AS p FROM e)
    SELECT qid, max(score) AS top1, round(max(score) - coalesce(max(score) FILTER (WHERE rank = 1), 0), 6) AS margin, round(sum(p * ln(p)), 6) + 0.0 AS neg_entropy, round(median(score), 7) AS med FROM p GROUP BY qid""")
def confidence_signals(spark, sf):
    over = W.partitionBy("qid")
    r = bm25(spark, sf).withColumn("e", F.exp(F.col("score") - F.max("score").over(over)))
    r = r.withColumn("p", F.col("e") / F.sum("e").over(over))
    second = F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0.0))
    return r.groupBy("qid").agg(F.max("score").alias("top1"), F.round(F.max("score") - second, 6).alias("margin"), (F.round(F.sum(F.col("p") * F.log("p")), 6) + 0.0).alias("neg_entropy"), F.round(F.median("score"), 7).alias("med"))


@query("split_sha256", "SELECT doc_id, CASE WHEN ('0x' || left(sha256(doc_id::VARCHAR), 2))::INT % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM documents")
def split_sha256(spark, sf):
    first = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2), 16, 10).cast("int")
    return table(spark, sf, "documents").select("doc_id", F.when(first % 2 == 0, "dev").otherwise("test").alias("split"))


HEXSUM = "list_sum(list_transform(string_split(left(sha1(doc_id::VARCHAR), 39), ''), lambda c: instr('0123456789abcdef', c) - 1))"


@query("split_sha1", f"SELECT doc_id, (6 * {HEXSUM} + instr('0123456789abcdef', right(sha1(doc_id::VARCHAR), 1)) - 1)::BIGINT % 10 < 7 AS dev FROM documents")
def split_sha1(spark, sf):
    """A hex number modulo ten is six times the sum of its leading digits, plus the last."""
    h = F.sha1(F.col("doc_id").cast("string"))
    digit = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    lead = F.aggregate(F.split(F.substring(h, 1, 39), ""), F.lit(0), lambda s, c: s + F.when(c == "", 0).otherwise(digit(c)))
    return table(spark, sf, "documents").select("doc_id", ((6 * lead + digit(F.substring(h, 40, 1))) % 10 < 7).alias("dev"))


LINKS_SQL = "(SELECT doc_id AS src, doc_id + 7 AS dst FROM documents WHERE n_chars % 5 IN (1, 2, 3))"


@query("components", f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {LINKS_SQL} UNION SELECT dst, src FROM {LINKS_SQL}), r AS (SELECT a AS v, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a)
    SELECT v AS vertex, min(c) AS component FROM r GROUP BY v""")
def components(spark, sf):
    """Chains of documents that a rule on their length links to the seventh after them."""
    d = table(spark, sf, "documents").where("n_chars % 5 IN (1, 2, 3)").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 7).alias("dst"))
    return connected_components(d)


CONFIGS = "(SELECT source AS name, round(avg(n_chars % 7), 2) AS recall3, round(avg(n_chars % 5), 2) AS mrr, count(DISTINCT lang) AS knobs, min(n_chars) < 1000 AS eligible FROM documents GROUP BY source) AS c"


@query("choose_config", f"SELECT name, recall3::DOUBLE AS recall3, mrr::DOUBLE AS mrr FROM {CONFIGS} WHERE eligible ORDER BY recall3 DESC, mrr DESC, knobs, name LIMIT 1")
def choose_config(spark, sf):
    c = derived(spark, sf, CONFIGS).where("eligible").orderBy(F.desc("recall3"), F.desc("mrr"), "knobs", "name").limit(1)
    return c.select("name", F.col("recall3").cast("double").alias("recall3"), F.col("mrr").cast("double").alias("mrr"))


ARMS = "(SELECT lang AS arm, source AS dataset, (min(n_chars) % 7 - 3) / 500.0 AS lo, max(n_chars) % 90 AS ms FROM documents GROUP BY lang, source) AS a"


@query("arm_choice", f"WITH g AS (SELECT arm, bool_and(lo >= -0.005) AS passes, max(ms)::BIGINT AS ms FROM {ARMS} GROUP BY arm) SELECT arm, passes, ms, passes AND ms = (SELECT min(ms) FROM g WHERE passes) AS chosen FROM g")
def arm_choice(spark, sf):
    """Arms that pass on every set; the fastest of them."""
    g = derived(spark, sf, ARMS).groupBy("arm").agg(F.bool_and(F.col("lo") >= -0.005).alias("passes"), F.max("ms").cast("long").alias("ms"))
    best = g.where("passes").agg(F.min("ms").alias("best"))
    return g.crossJoin(F.broadcast(best)).select("arm", "passes", "ms", (F.col("passes") & (F.col("ms") == F.col("best"))).alias("chosen"))


def _dev_sql(alpha: float) -> str:
    from tarn.queries.fusion_queries import convex_sql
    from tarn.queries.metrics_queries import ndcg_sql

    return f"SELECT {alpha}::DOUBLE AS alpha, qid, ndcg FROM {ndcg_sql(f'(SELECT qid, doc_id, rank FROM {convex_sql(alpha, False)} WHERE rank < 10)')}"


def _tune_sql() -> str:
    return f"""WITH n AS ({' UNION ALL '.join(map(_dev_sql, ALPHAS))}), d AS (SELECT alpha, qid % 2 AS dataset, avg(ndcg) AS ndcg FROM n WHERE qid % 3 <> 0 GROUP BY ALL),
    m AS (SELECT alpha, avg(ndcg) AS macro FROM d GROUP BY alpha) SELECT alpha, round(macro, 6) AS macro, row_number() OVER (ORDER BY round(macro, 9) DESC, alpha) = 1 AS chosen FROM m"""


#: Weights of the lexical leg that tuning tries.
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)


def _rated(spark, sf):
    """``alpha, qid, ndcg`` of the dev queries: both legs are read once, every fusion of the grid is rated on them."""
    from tarn.queries.fusion_queries import both

    pools, qrels = cut(both(spark, sf), "pools"), cut(containment_qrels(spark, sf), "qrels")
    rated = None
    for alpha in ALPHAS:
        run = _convex(pools, alpha).where("rank < 10")
        one = M.ndcg(run, qrels).select(F.lit(alpha).alias("alpha"), "qid", "ndcg")
        rated = one if rated is None else rated.unionAll(one)
    return rated.where("qid % 3 <> 0")


def _macro(rated):
    """``alpha, macro``: the mean over two sets of the mean over their queries."""
    sets = rated.groupBy("alpha", (F.col("qid") % 2).alias("dataset")).agg(F.avg("ndcg").alias("ndcg"))
    return sets.groupBy("alpha").agg(F.avg("ndcg").alias("macro"))


@query("tune_grid", _tune_sql())
def tune_grid(spark, sf):
    """The weight of the lexical leg with the best macro mean over the dev queries of two sets; of equals the lower weight."""
    macro = _macro(_rated(spark, sf))
    first = F.row_number().over(W.orderBy(F.desc(F.round("macro", 9)), "alpha")) == 1  # one row a weight
    return macro.select("alpha", F.round("macro", 6).alias("macro"), first.alias("chosen"))


def _decision_sql() -> str:
    return f"""WITH n AS ({' UNION ALL '.join(map(_dev_sql, ALPHAS))}), v AS (SELECT * FROM n WHERE qid % 3 <> 0), d AS (SELECT alpha, qid % 2 AS dataset, avg(ndcg) AS ndcg FROM v GROUP BY ALL),
    m AS (SELECT alpha, avg(ndcg) AS macro FROM d GROUP BY alpha),
    best AS (SELECT alpha FROM m WHERE alpha > 0 AND alpha < 1 ORDER BY round(macro, 4) DESC, alpha LIMIT 1), leg AS (SELECT alpha FROM m WHERE alpha IN (0, 1) ORDER BY round(macro, 9) DESC, alpha DESC LIMIT 1),
    f AS (SELECT a.qid, a.ndcg - b.ndcg AS v, row_number() OVER (ORDER BY a.qid) - 1 AS i FROM v a JOIN v b USING (qid) WHERE a.alpha = (SELECT alpha FROM best) AND b.alpha = (SELECT alpha FROM leg)),
    k AS (SELECT count(*) AS n FROM f),
    b AS (SELECT r.b, avg(y.v) AS mean FROM range(200) r(b) CROSS JOIN f x CROSS JOIN k JOIN f y ON y.i = floor({DRAW.format("r.b || ':' || x.i")} * k.n)::BIGINT GROUP BY r.b),
    r AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS r FROM b), c AS (SELECT round(max(mean) FILTER (WHERE r = 5), 4) AS lo, round(max(mean) FILTER (WHERE r = 194), 4) AS hi FROM r)
    SELECT best.alpha AS best, leg.alpha AS leg, round((SELECT avg(v) FROM f), 4) AS gain, lo, hi, lo > 0 AS passed, CASE WHEN lo > 0 THEN best.alpha ELSE leg.alpha END AS chosen FROM c, best, leg"""


@query("tune_decision", _decision_sql())
def tune_decision(spark, sf):
    """The best fusion is kept only if the interval of its gain over the best single leg lies above zero; else that leg is chosen."""
    rated = cut(_rated(spark, sf), "rated")
    macro = {r["alpha"]: r["macro"] for r in _macro(rated).collect()}  # a row a weight
    best = min((a for a in macro if 0 < a < 1), key=lambda a: (-round(macro[a], 4), a))
    leg = min((a for a in macro if a in (0.0, 1.0)), key=lambda a: (-round(macro[a], 9), -a))
    gain = rated.groupBy("qid").agg(*(F.max(F.when(F.col("alpha") == a, F.col("ndcg"))).alias(n) for n, a in (("x", best), ("y", leg)))).select("qid", (F.col("x") - F.col("y")).alias("v"))
    gain = cut(gain, "gain")
    ends = S.interval(S.bootstrap_hash(gain, "v", 200), 200).crossJoin(gain.agg(F.round(F.avg("v"), 4).alias("gain")))
    passed = F.col("lo") > 0
    return ends.select(F.lit(best).alias("best"), F.lit(leg).alias("leg"), "gain", "lo", "hi", passed.alias("passed"), F.when(passed, F.lit(best)).otherwise(F.lit(leg)).alias("chosen"))


def _convex(pools, alpha):
    from tarn.operators import fusion as X

    return X.convex(pools, alpha, X.theoretical_min(F.col("lex"), 0.0), X.theoretical_min(F.col("dense"), -2.0), "zero")


@query("pair_runs", f"WITH a AS (SELECT qid, max(score) AS x FROM {RUN_A} WHERE qid % 9 <> 0 GROUP BY qid), b AS (SELECT qid, max(score) AS y FROM {RUN_B} WHERE qid % 7 <> 0 GROUP BY qid) SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL)::BIGINT AS paired, count(*) FILTER (WHERE y IS NULL)::BIGINT AS only_a, count(*) FILTER (WHERE x IS NULL)::BIGINT AS only_b, round(avg(x - y), 6) AS diff FROM a FULL JOIN b USING (qid)")
def pair_runs(spark, sf):
    a, b = two_runs(spark, sf)
    j = a.where("qid % 9 <> 0").groupBy("qid").agg(F.max("score").alias("x")).join(b.where("qid % 7 <> 0").groupBy("qid").agg(F.max("score").alias("y")), "qid", "full_outer")
    n = lambda c: F.sum(F.expr(c).cast("long"))
    return j.agg(n("x IS NOT NULL AND y IS NOT NULL").alias("paired"), n("y IS NULL").alias("only_a"), n("x IS NULL").alias("only_b"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("diff"))


PUBLISHED = "(SELECT source AS name, round(avg(n_chars), 4) AS value FROM documents GROUP BY source) AS p"
REDONE = "(SELECT source AS name, round(avg(n_chars) + CASE WHEN min(doc_id) % 2 = 0 THEN 0.0003 ELSE 0.01 END, 4) AS again FROM documents WHERE source <> 'src3' GROUP BY source) AS r"


@query("reproduce_compare", f"SELECT name, coalesce(abs(value - again) <= 0.0005, false) AS reproduced FROM {PUBLISHED} LEFT JOIN {REDONE} USING (name)")
def reproduce_compare(spark, sf):
    j = derived(spark, sf, PUBLISHED).join(derived(spark, sf, REDONE), "name", "left")
    return j.select("name", F.coalesce(F.abs(F.col("value") - F.col("again")) <= 0.0005, F.lit(False)).alias("reproduced"))


@query(
    "noise_floor",
    f"""WITH {DRAWN}, r AS (SELECT s / n AS mean, row_number() OVER (ORDER BY s / n) - 1 AS r FROM m)
    SELECT greatest(abs(round(max(mean) FILTER (WHERE r = 5), 4)), abs(round(max(mean) FILTER (WHERE r = 194), 4))) AS floor FROM r""",
)
def noise_floor(spark, sf):
    """The largest end of any interval in absolute value."""
    return cluster_bootstrap_hash(spark, sf).agg(F.max(F.greatest(F.abs("lo"), F.abs("hi"))).alias("floor"))


@query("stratified_sample_hash", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) <= 5")
def stratified_sample_hash(spark, sf):
    order = W.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", F.row_number().over(order).alias("n")).where("n <= 5").drop("n")


BASE = "(SELECT source, avg(quality) AS base FROM {} GROUP BY source)"


@query("baseline_strict", f"WITH b AS (SELECT source, avg(quality) AS base FROM {LABELLED} GROUP BY source), n AS (SELECT source, avg(CASE WHEN doc_id % 40 = 0 THEN 0 ELSE quality END) AS now FROM {LABELLED} GROUP BY source) SELECT source, now < base - 1e-9 AS regressed FROM b JOIN n USING (source)")
def baseline_strict(spark, sf):
    rows = labelled(spark, sf)
    now = F.avg(F.when(F.col("doc_id") % 40 == 0, 0).otherwise(F.col("quality")))
    return rows.groupBy("source").agg((now < F.avg("quality") - 1e-9).alias("regressed"))


@query("candidate_deltas", f"WITH b AS (SELECT source, avg(quality) AS x FROM {LABELLED} GROUP BY source), c AS (SELECT source, avg(1 - toxic) AS y FROM {LABELLED} GROUP BY source) SELECT source, round(y - x, 6) AS delta, y >= x AS eligible FROM b FULL JOIN c USING (source)")
def candidate_deltas(spark, sf):
    g = labelled(spark, sf).groupBy("source").agg(F.avg("quality").alias("x"), F.avg(1 - F.col("toxic")).alias("y"))
    return g.select("source", F.round(F.col("y") - F.col("x"), 6).alias("delta"), (F.col("y") >= F.col("x")).alias("eligible"))


@query(
    "split_assignment",
    """WITH c AS (SELECT lang AS bucket, source AS cluster, count(*) AS n, sha256(lang || '/' || source) AS h FROM documents GROUP BY ALL),
    t AS (SELECT *, ('0x' || left(h, 2))::INT % 2 = 1 AS test FROM c),
    r AS (SELECT *, sum(n) OVER (PARTITION BY bucket) AS whole, coalesce(sum(n) FILTER (WHERE test) OVER (PARTITION BY bucket), 0) AS there,
      coalesce(sum(CASE WHEN test THEN 0 ELSE n END) OVER (PARTITION BY bucket ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
    SELECT bucket, cluster, CASE WHEN test OR there + before < 0.15 * whole THEN 'test' ELSE 'dev' END AS split FROM r""",
)
def split_assignment(spark, sf):
    """Hash split of clusters with a floor: the highest-hash dev clusters move until a bucket has 15 % in test."""
    d = table(spark, sf, "documents").groupBy(F.col("lang").alias("bucket"), F.col("source").alias("cluster")).agg(F.count("*").alias("n"))
    d = d.withColumn("h", F.sha2(F.concat_ws("/", "bucket", "cluster"), 256)).withColumn("test", F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % 2 == 1)
    bucket = W.partitionBy("bucket")
    there = F.sum(F.when(F.col("test"), F.col("n")).otherwise(0)).over(bucket)
    before = F.coalesce(F.sum(F.when(F.col("test"), 0).otherwise(F.col("n"))).over(bucket.orderBy(F.desc("h")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = there + before < 0.15 * F.sum("n").over(bucket)
    return d.select("bucket", "cluster", F.when(F.col("test") | moved, "test").otherwise("dev").alias("split"))


@query(
    "auroc_cluster_bootstrap",
    f"""WITH g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM {LABELLED})), k AS (SELECT count(*) AS k FROM g),
    c AS (SELECT source, s, sum(quality) AS pos, count(*) AS n FROM {LABELLED} GROUP BY ALL),
    d AS (SELECT b, g2.source FROM range(100) r(b) CROSS JOIN g g1 CROSS JOIN k JOIN g g2 ON g2.i = floor({DRAW.format("b || ':' || g1.i")} * k.k)::BIGINT),
    v AS (SELECT b, s, sum(pos) AS pos, sum(n) AS n FROM d JOIN c USING (source) GROUP BY b, s),
    r AS (SELECT *, sum(n) OVER (PARTITION BY b ORDER BY s) - (n - 1) / 2.0 AS rank FROM v),
    a AS (SELECT b, (sum(pos * rank) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(sum(pos) * (sum(n) - sum(pos)), 0)::DOUBLE AS a FROM r GROUP BY b),
    o AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS r FROM a WHERE a IS NOT NULL)
    SELECT round(max(a) FILTER (WHERE r = 5), 4) AS lo, round(max(a) FILTER (WHERE r = 94), 4) AS hi, (SELECT k FROM k)::BIGINT AS clusters FROM o""",
)
def auroc_cluster_bootstrap(spark, sf):
    """Ninety-per-cent interval of the AUROC by whole clusters, from the pair-win matrix of clusters; scores are ranked once."""
    drawn, k = cluster_draws(spark, sf)
    means = drawn.select("b", F.col("auroc").alias("mean")).where("mean IS NOT NULL")
    return _ends(means).withColumn("clusters", F.lit(k).cast("long"))


def cluster_draws(spark, sf):
    """A hundred draws of sources, with the area under the curve and the counts of each, and how many sources there are."""
    rows = labelled(spark, sf)
    counts = rows.groupBy("source", "s").agg(F.sum("quality").alias("pos"), F.count("*").alias("n"))
    names = S.numbered(rows.select("source").distinct(), "source").select("i", "source")
    numbered = counts.join(names, "source").select("i", "s", "pos", (F.col("n") - F.col("pos")).alias("neg"), F.col("pos").alias("good"), "n")
    return S.shared_draws(cut(numbered, "counts"), ["good", "n"], 100), names.count()


def _ends(means):
    """The sorted means at places five and ninety-four, rounded."""
    r = means.withColumn("r", F.row_number().over(W.orderBy("mean")) - 1)  # a row a draw
    end = lambda i: F.round(F.max(F.when(F.col("r") == i, F.col("mean"))), 4)
    return r.agg(end(5).alias("lo"), end(94).alias("hi"))


@query(
    "shared_metrics",
    f"""WITH g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM {LABELLED})), k AS (SELECT count(*) AS k FROM g),
    d AS (SELECT b, g2.source FROM range(100) r(b) CROSS JOIN g g1 CROSS JOIN k JOIN g g2 ON g2.i = floor({DRAW.format("b || ':' || g1.i")} * k.k)::BIGINT),
    w AS (SELECT x.b, sum(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0.0 END) / count(*)::DOUBLE AS a FROM d x JOIN {LABELLED} p ON p.source = x.source AND p.quality = 1
      JOIN d y ON y.b = x.b JOIN {LABELLED} q ON q.source = y.source AND q.quality = 0 GROUP BY x.b),
    h AS (SELECT b, sum(quality) / count(*)::DOUBLE AS h FROM d JOIN {LABELLED} USING (source) GROUP BY b),
    v AS (SELECT 'auroc' AS metric, b, a AS v FROM w UNION ALL SELECT 'share', b, h FROM h UNION ALL SELECT 'gap', b, a - h FROM w JOIN h USING (b)),
    o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS r FROM v)
    SELECT metric, round(max(v) FILTER (WHERE r = 5), 4) AS lo, round(max(v) FILTER (WHERE r = 94), 4) AS hi FROM o GROUP BY metric""",
)
def shared_metrics(spark, sf):
    """Intervals of the area under the curve, the share of good rows and their difference, from one set of draws of clusters."""
    drawn = cut(cluster_draws(spark, sf)[0], "draws")
    share = F.col("good") / F.col("n")
    of = lambda name, value: _ends(drawn.select("b", value.alias("mean")).where("mean IS NOT NULL")).select(F.lit(name).alias("metric"), "lo", "hi")
    return of("auroc", F.col("auroc")).unionAll(of("share", share)).unionAll(of("gap", F.col("auroc") - share))
