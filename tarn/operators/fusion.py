"""Fusion of ranked lists. Every list is a frame ``(qid, doc_id, rank from 0, score)``; order is always a column.

Scores that are missing, NaN or infinite count as missing. All rules are window and join expressions keyed
by ``qid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.topk import top

RRF_K = 60


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ranked(rows: DataFrame, *order, k: int | None = None) -> DataFrame:
    """Number rows of each query from zero, the first ``k`` only if given."""
    if k is not None:
        return top(rows, k, *order)
    return rows.withColumn("rank", (F.row_number().over(W.partitionBy("qid").orderBy(*order)) - 1).cast("long"))


def legs(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Both lists side by side: ``qid, doc_id, lex_rank, lex, dense_rank, dense``."""
    a = lexical.select("qid", "doc_id", F.col("rank").alias("lex_rank"), F.col("score").alias("lex"))
    b = dense.select("qid", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense"))
    return a.join(b, ["qid", "doc_id"], "full_outer")


def share(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    return F.coalesce(weight / (rank + (k + 1)), F.lit(0.0))


def rrf(both: DataFrame, w: float = 0.5, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; weights ``2w`` and ``2(1-w)``. Ties: the lexical list's order, then the dense one's."""
    score = F.round(share(F.col("lex_rank"), 2 * w, k) + share(F.col("dense_rank"), 2 * (1 - w), k), 12)
    rows = both.withColumn("score", score)
    return ranked(rows, F.desc("score"), F.col("lex_rank").asc_nulls_last(), "dense_rank").select("qid", "doc_id", "rank", "score")


def rrf_many(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Any number of lists, earlier lists first on ties."""
    rows = None
    for i, leg in enumerate(lists):
        part = leg.select("qid", "doc_id", F.lit(i).alias("leg"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    # the sum runs in the order of the lists, as floating sums depend on it
    parts = [F.max(F.when(F.col("leg") == i, share(F.col("rank"), 1.0, k))) for i in range(len(lists))]
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    fused = rows.groupBy("qid", "doc_id").agg(F.round(total, 12).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return ranked(fused, F.desc("score"), "first.leg", "first.rank").select("qid", "doc_id", "rank", "score")


def minmax(score: Column) -> Column:
    """Over a query's finite scores; one distinct value gives one half, a missing score zero."""
    over = W.partitionBy("qid")
    v = finite(score)
    lo, hi = F.min(v).over(over), F.max(v).over(over)
    return F.when(v.isNull(), 0.0).when(hi == lo, 0.5).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)))


def zscore(score: Column) -> Column:
    over = W.partitionBy("qid")
    v = finite(score)
    mean, sd = F.avg(v).over(over), F.stddev_pop(v).over(over)
    return F.when(v.isNull(), 0.0).when((sd == 0) | sd.isNull(), 0.5).otherwise((v - mean) / F.nullif(sd, F.lit(0.0)))


def theoretical_min(score: Column, floor: float) -> Column:
    """Between a floor that the score cannot pass and the query's best."""
    v = finite(score)
    hi = F.max(v).over(W.partitionBy("qid"))
    return F.when(v.isNull() | (hi <= floor), 0.0).otherwise((F.greatest(v, F.lit(floor)) - floor) / F.nullif(hi - floor, F.lit(0.0)))


def convex(both: DataFrame, alpha: float, lex_norm: Column, dense_norm: Column, missing: str = "zero") -> DataFrame:
    """``alpha`` of the lexical and the rest of the dense norm; ties by the better rank of either list, then id.

    ``missing``: a document absent from a list counts zero there, or the list's least norm (``leg_min``).
    """
    over = W.partitionBy("qid")
    rows = both.withColumns({"ln": F.when(F.col("lex_rank").isNotNull(), lex_norm), "dn": F.when(F.col("dense_rank").isNotNull(), dense_norm)})
    fill = lambda c: F.coalesce(c, F.coalesce(F.min(c).over(over), F.lit(0.0)) if missing == "leg_min" else F.lit(0.0))
    rows = rows.withColumn("score", F.round(alpha * fill(F.col("ln")) + (1 - alpha) * fill(F.col("dn")), 9))
    best = F.least("lex_rank", "dense_rank")
    return ranked(rows, F.desc("score"), best, "doc_id").select("qid", "doc_id", "rank", "score")


def rescue(both: DataFrame, lex_norm: Column, at: int = 5, window: int = 20, max_rank: int = 3, most: int = 2, least: float = 0.5) -> DataFrame:
    """The dense order, with up to ``most`` strong lexical hits from beyond its window put in at ``at``.

    A query without dense hits keeps its lexical order. ``score`` is the dense score; an item put in takes the
    score of the one above it.
    """
    over = W.partitionBy("qid")
    beyond = max(window, at)
    rows = both.withColumns({"ln": F.when(F.col("lex_rank").isNotNull(), lex_norm), "has_dense": F.max(F.col("dense_rank").isNotNull()).over(over)})
    strong = F.col("has_dense") & (F.col("lex_rank") < max_rank) & (F.col("ln") >= least) & (F.coalesce("dense_rank", F.lit(beyond)) >= beyond)
    rows = rows.withColumn("strong", F.coalesce(strong, F.lit(False)))
    nth = F.row_number().over(W.partitionBy("qid", "strong").orderBy(F.col("lex_rank").asc_nulls_last()))
    rows = rows.withColumn("saved", F.col("strong") & (nth <= most))
    rows = rows.where(~F.col("has_dense") | F.col("dense_rank").isNotNull() | F.col("saved"))
    rest = F.row_number().over(W.partitionBy("qid", "saved").orderBy(F.when(F.col("saved"), F.col("lex_rank")).otherwise(F.col("dense_rank")).asc_nulls_last(), "lex_rank")) - 1
    rows = rows.withColumn("own", rest).withColumns({"n_saved": F.sum(F.col("saved").cast("int")).over(over), "n_rest": F.sum((~F.col("saved")).cast("int")).over(over)})
    put = F.least(F.lit(at), F.col("n_rest"))
    pos = F.when(F.col("saved"), put + F.col("own")).otherwise(F.col("own") + F.when(F.col("own") >= put, F.col("n_saved")).otherwise(0))
    rows = rows.withColumn("rank", pos.cast("long"))
    own_score = F.when(~F.col("saved"), F.when(F.col("has_dense"), F.col("dense")).otherwise(share(F.col("lex_rank"))))
    score = F.last(own_score, ignorenulls=True).over(W.partitionBy("qid").orderBy("rank"))
    return rows.withColumn("score", score).select("qid", "doc_id", "rank", "score")
