"""Ranking metrics as joins and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``qid, ndcg``: linear gain over log2 discounts, against the ideal of all judged grades; zero without an ideal."""
    gain = lambda g, r: F.sum(g / F.log2(r + 2.0))
    got = run.where(F.col("rank") < k).join(qrels, ["qid", "doc_id"]).groupBy("qid").agg(gain(F.col("grade"), F.col("rank")).alias("dcg"))
    best = qrels.withColumn("i", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "doc_id")) - 1).where(F.col("i") < k)
    ideal = best.groupBy("qid").agg(gain(F.col("grade"), F.col("i")).alias("idcg"))
    return ideal.join(got, "qid", "left").select("qid", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def binary_metrics(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``qid``, recall, any and all at each cut, and the reciprocal rank of the first relevant document."""
    relevant = qrels.where("grade > 0").select("qid", "doc_id")
    found = relevant.join(run.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    aggs = [F.count("*").alias("n"), F.min("rank").alias("first")]
    aggs += [F.sum((F.coalesce(F.col("rank") < k, F.lit(False))).cast("long")).alias(f"hit{k}") for k in cuts]
    g = found.groupBy("qid").agg(*aggs)
    cols = ["qid"]
    for k in cuts:
        cols += [(F.col(f"hit{k}") / F.col("n")).alias(f"recall{k}"), (F.col(f"hit{k}") > 0).alias(f"any{k}"), (F.col(f"hit{k}") == F.col("n")).alias(f"all{k}")]
    return g.select(*cols, F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end, within [0, 1]; zero for nothing."""
    p = hits / F.nullif(n, F.lit(0))
    centre, spread = (p + z * z / (2 * n)), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    ends = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), (centre + s * spread) / (1 + z * z / n))) for s in (-1, 1)]
    return tuple(F.when(n > 0, e).otherwise(0.0) for e in ends)


def auroc(rows: DataFrame, score: Column, positive: Column, by: list[str] | None = None) -> DataFrame:
    """``n_pos, n_neg, auroc``: the rank-sum statistic, ties by average ranks, a missing score below all; null if a class is empty.

    Scores are first counted by value, so the ranking runs over distinct values.
    """
    by = by or []
    s = F.when(score.isNull() | F.isnan(score), F.lit(float("-inf"))).otherwise(score)
    counted = rows.withColumns({"s": s, "p": positive.cast("long")}).groupBy(*by, "s").agg(F.sum("p").alias("pos"), F.count("*").alias("n"))
    over = W.partitionBy(*by).orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.withColumn("mid", F.sum("n").over(over) - (F.col("n") - 1) / 2)
    g = ranked.groupBy(*by).agg(F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg"), F.sum(F.col("pos") * F.col("mid")).alias("r"))
    u = (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))
    return g.select(*by, "n_pos", "n_neg", u.alias("auroc"))
