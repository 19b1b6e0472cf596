"""Re-ranking, selection, demotion and filters over ranked rows ``(qid, rank from 0, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.topk import top as first_rows

RRF_K = 60


def slug_decay(rows: DataFrame, decay: float, limit: int, slug: str = "slug") -> DataFrame:
    """Greedy pick of ``limit`` rows, a slug's value shrinking by ``decay`` each time it is taken; adds ``pos``.

    The value of a row depends only on how many rows of its slug stand above it, so one sort equals the
    greedy loop.
    """
    nth = F.row_number().over(W.partitionBy("qid", slug).orderBy("rank")) - 1
    valued = rows.withColumn("value", F.round(1.0 / (F.col("rank") + RRF_K + 1) * F.pow(F.lit(decay), nth), 12))
    return first_rows(valued, limit, F.desc("value"), "rank", name="pos").drop("value")


def rerank(rows: DataFrame, score: Column) -> DataFrame:
    """Stable order by a scorer's ``score``, best first. A query with a missing or non-finite score, or one row, keeps its order; ``fallback`` tells."""
    over = W.partitionBy("qid")
    rows = rows.withColumn("rerank", score.cast("double"))
    bad = F.max((F.col("rerank").isNull() | F.isnan("rerank") | (F.abs("rerank") == float("inf"))).cast("int")).over(over) == 1
    rows = rows.withColumn("fallback", F.coalesce(bad, F.lit(True)) | (F.count("*").over(over) < 2))
    key = F.when(~F.col("fallback"), -F.col("rerank"))
    return rows.withColumn("pos", (F.row_number().over(over.orderBy(key.asc_nulls_last(), "rank")) - 1).cast("long"))


def zscores(c: Column, over) -> Column:
    """Population z-scores; a spread that is nothing beside the mean gives zeros."""
    mean, sd = F.avg(c).over(over), F.stddev_pop(c).over(over)
    return F.when(sd <= 1e-9 * F.greatest(F.lit(1.0), F.abs(mean)), 0.0).otherwise((c - mean) / F.nullif(sd, F.lit(0.0)))


def blend(rows: DataFrame, rerank: Column, fused: Column, b: float) -> DataFrame:
    """Order by ``(1-b) z(rerank) + b z(fused)``; ties keep their order. Adds ``blended`` and ``pos``."""
    over = W.partitionBy("qid")
    rows = rows.withColumn("blended", F.round((1 - b) * zscores(rerank, over) + b * zscores(fused, over), 9))
    return rows.withColumn("pos", (F.row_number().over(over.orderBy(F.desc("blended"), "rank")) - 1).cast("long"))


def splice(head: DataFrame, rows: DataFrame) -> DataFrame:
    """A re-ranked head ``(qid, doc_id, pos)`` followed by the rest of ``rows (qid, doc_id, rank)`` in their order."""
    both = rows.join(head, ["qid", "doc_id"], "left")
    order = W.partitionBy("qid").orderBy(F.col("pos").asc_nulls_last(), "rank")
    return both.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def demotion(superseded: Column, valid_until: Column, today: Column) -> Column:
    """Half for what is superseded, a quarter for what has passed its date; the lesser counts."""
    return F.least(F.when(superseded, 0.5).otherwise(1.0), F.when(today > valid_until, 0.25).otherwise(1.0))


def scaled(score: Column, multiplier: Column) -> Column:
    """A demoted score never rises: negative scores are divided."""
    down = F.when(multiplier == 0, F.lit(float("-inf"))).otherwise(score / F.nullif(multiplier, F.lit(0.0)))
    return F.when(score >= 0, score * multiplier).otherwise(down)


def age_label(days: Column) -> Column:
    d = F.greatest(days, F.lit(0))
    some = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    months, years = F.floor(d / 30), F.floor(d / 365)
    return F.when(d == 0, "today").when(d < 30, some(d, "day")).when(d < 365, some(months, "month")).otherwise(some(years, "year"))


def confidence(signal: Column, scale: float | None, offset: float | None) -> Column:
    """Calibrated by a logistic, or the signal as it is."""
    return signal if scale is None else 1 / (1 + F.exp(-(scale * signal + offset)))


def abstains(conf: Column, least: float) -> Column:
    """Below the least confidence; a query without one never abstains."""
    return F.coalesce(conf < least, F.lit(False))


def restrict(rows: DataFrame, sensitivity: str = "sensitivity") -> DataFrame:
    """Drop restricted rows, leaving one notice a slug at the place of its first."""
    barred = F.col(sensitivity) == "restricted"
    nth = F.row_number().over(W.partitionBy("qid", "slug", barred).orderBy("rank"))
    kept = rows.withColumn("notice", barred).withColumn("nth", nth).where(~F.col("notice") | (F.col("nth") == 1)).drop("nth")
    return kept.withColumn("doc_id", F.when(~F.col("notice"), F.col("doc_id")))


def token_budget(rows: DataFrame, chars: Column, tokens: int) -> DataFrame:
    """The prefix whose running size, sixty characters an item besides its own, stays in the budget."""
    used = F.sum(chars + 60).over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("used", used.cast("long")).where(F.col("used") <= tokens * 4)


def dedup(rows: DataFrame, content: Column, key: Column) -> DataFrame:
    """The first row of each fingerprint: a hundred squeezed lower-case characters, else the key; empty ones go."""
    squeezed = F.trim(F.regexp_replace(F.lower(F.substring(content, 1, 100)), r"\s+", " "))
    rows = rows.withColumn("fp", F.when(F.length(squeezed) > 0, squeezed).otherwise(key)).where(F.length("fp") > 0)
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("qid", "fp").orderBy("rank"))).where("nth = 1").drop("nth", "fp")


def fold_units(rows: DataFrame, unit: str) -> DataFrame:
    """Chunk ranks to unit ranks: a unit stands where its first chunk stood. ``qid, unit, rank``."""
    first = rows.groupBy("qid", F.col(unit).alias("unit")).agg(F.min("rank").alias("first"))
    return first.select("qid", "unit", (F.row_number().over(W.partitionBy("qid").orderBy("first")) - 1).cast("long").alias("rank"))


def expand_links(pool: DataFrame, sections: DataFrame, edges: DataFrame, top: int = 3, most: int = 10) -> DataFrame:
    """Neighbours of the first ``top`` distinct slugs that are not in the pool, appended below it.

    Out-links come before in-links; each neighbour is shown by its section of the lowest id.
    ``pool (qid, doc_id, slug, rank)``, ``sections (id, slug)``, ``edges (src, dst)``; returns ``qid, slug, doc_id, pos``.
    """
    firsts = pool.groupBy("qid", "slug").agg(F.min("rank").alias("at"))
    seeds = firsts.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("at"))).where(F.col("n") <= top)
    out = seeds.join(edges, F.col("slug") == F.col("src")).select("qid", "n", F.lit(0).alias("way"), F.col("dst").alias("found"))
    into = seeds.join(edges, F.col("slug") == F.col("dst")).select("qid", "n", F.lit(1).alias("way"), F.col("src").alias("found"))
    near = out.unionByName(into).groupBy("qid", F.col("found").alias("slug")).agg(F.min(F.struct("way", "n")).alias("first"))
    fresh = near.join(firsts.select("qid", "slug"), ["qid", "slug"], "left_anti")
    shown = fresh.join(sections.groupBy("slug").agg(F.min("id").alias("doc_id")), "slug")
    return first_rows(shown, most, "first", "slug", name="pos").select("qid", "slug", "doc_id", "pos")


def propagate_supersession(notes: DataFrame) -> DataFrame:
    """``path, slug, superseded_by``: a note that names ``supersedes`` marks those it names, unless they name a successor
    themselves; the lowest path that names one wins; a note cannot supersede itself."""
    named = notes.select("path", "slug", F.explode("supersedes").alias("old")).where("old <> slug")
    heirs = named.groupBy(F.col("old").alias("slug")).agg(F.min_by("slug", "path").alias("heir"))
    return notes.join(heirs, "slug", "left").select("path", "slug", F.coalesce("superseded_by", "heir").alias("superseded_by"))


def evidence(query: Column, slug: Column, title: Column, block: Column, content: Column) -> Column:
    """How a row supports a query: ``kind/verdict``, the strongest that applies."""
    from tarn.functions.text import tokens

    words = tokens(query)
    bare = F.array_join(words, "-")
    holds = lambda hay: F.forall(words, lambda w: F.array_contains(hay, w))
    return (
        F.when(bare == F.lower(slug), "slug-exact/exists")
        .when(words == tokens(title), "title-exact/exists")
        .when((F.size(words) > 0) & holds(tokens(title)), "title-terms/probable")
        .when(F.array_contains(words, F.lower(block)), "anchor-section/probable")
        .when((F.size(words) > 0) & holds(tokens(content)), "body-fts/probable")
        .otherwise("none/unknown")
    )


def clamp_limit(limit: Column, default: int = 10, most: int = 100) -> Column:
    """A whole number of results from one to ``most``; what is no number is the default."""
    n = limit.try_cast("long")
    return F.when(n.isNull(), default).otherwise(F.greatest(F.lit(1), F.least(n, F.lit(most)))).cast("long")


def pool_size(limit: Column, rerank: Column, depth: Column) -> Column:
    """Candidates that each leg fetches: twice the limit, or the re-ranker's depth if that is more."""
    return F.when(rerank, F.greatest(limit * 2, depth)).otherwise(limit * 2).cast("long")
