"""Time-bounded joins over search logs and diffs of ledgers."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.plans.scratch import cut, sized


def bounded_join(searches: DataFrame, reads: DataFrame, seconds: int) -> DataFrame:
    """Searches (all columns) with ``read_id`` of reads by the same ``sid`` of the same ``slug`` at most ``seconds`` later.

    Both sides are dealt to bins as wide as the bound, a search to its own and the next, so that the range
    condition rides on an equi-join and a busy session spreads over its bins.
    """
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    bin_ = F.floor(epoch / seconds)
    s = searches.withColumn("bin", F.explode(F.array(bin_, bin_ + 1)))
    r = reads.select(F.col("event_id").alias("read_id"), "sid", "slug", F.col("ts").alias("read_ts"), bin_.alias("bin"))
    late = F.col("read_ts") - F.col("ts")
    joined = s.join(r, ["sid", "slug", "bin"])
    return joined.where((late >= F.expr("INTERVAL 0 SECOND")) & (late <= F.expr(f"INTERVAL {seconds} SECOND"))).drop("bin")


def carried(rows: DataFrame, key: Column, ts: Column, mark: Column, number: Column) -> DataFrame:
    """``rows`` with ``last`` and ``seen``: of the marked rows of the same key up to each row, the ``number`` of the latest and how many.

    Rows are dealt to ranges of (key, time), so a key of any size spreads. In a range both run on from row to row; what the ranges before
    leave to a key that goes on in the next comes from a table with a row a range. Of equal times marked rows come first, then the
    smaller number; ``number`` is a long and tells rows of a key apart.
    """
    k, t, m, n = "carried key", "carried time", "carried mark", "carried number"
    sorted_ = rows.withColumns({k: F.xxhash64(key), t: ts, m: F.coalesce(mark, F.lit(False)), n: number.cast("long")})
    order = [k, t, F.desc(m), n]
    sorted_ = sorted_.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    names = [*rows.columns, k, t, m, n, "range"]
    at = {c: names.index(c) for c in (k, m, n)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_last, held_seen = None, -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, marks = batch.column(at[k]).to_numpy(), batch.column(at[m]).to_numpy(zero_copy_only=False)
            numbers = batch.column(at[n]).to_numpy(zero_copy_only=False)
            new = np.r_[keys[0] != held_key, keys[1:] != keys[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            goes_on = np.cumsum(new) == 0  # of the key that the last batch ended with
            place = np.maximum.accumulate(np.where(marks, np.arange(len(keys)), -1))
            there = place >= start
            total = np.cumsum(marks)
            seen = total - np.where(start > 0, total[start - 1], 0) + np.where(goes_on, held_seen, 0)
            last = np.where(there, numbers[np.maximum(place, 0)], np.where(goes_on, held_last, -1))
            known = seen > 0
            held_key, held_last, held_seen = keys[-1], last[-1], int(seen[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(last, pa.int64(), mask=~known), pa.array(seen.astype(np.int64))], [*(f"c{i}" for i in range(len(names))), "last", "seen"])

    plain = sorted_.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    filled = cut(plain.mapInArrow(run, f"{schema}, last long, seen long"), "ranges")
    ck, cr = f"c{at[k]}", f"c{len(names) - 1}"
    # what each range has of its last key, marked or not: the latest mark has been seen by its last row
    ends = filled.groupBy(cr, ck).agg(F.max_by("last", "seen").alias("last"), F.max("seen").alias("seen"), F.max(F.struct(f"c{names.index(t)}", ~F.col(f"c{at[m]}"), f"c{at[n]}")).alias("e"))
    edges = ends.groupBy(cr).agg(F.min(ck).alias("first"), F.max_by(F.struct(F.col(ck).alias("key"), "last", "seen"), ck).alias("end"))
    edges = edges.select(cr, "first", "end.*")
    same = W.partitionBy("key").orderBy(cr)  # ranges that end with one key follow each other
    far = edges.withColumn("so_far", F.struct("key", F.last("last", ignorenulls=True).over(same).alias("was"), F.sum("seen").over(same).alias("more")))
    far = far.withColumn("before", F.lag("so_far").over(W.orderBy(cr)))  # a row a range
    tail = far.where("before.key = first AND before.more > 0").select(cr, F.col("first").alias(ck), "before.was", "before.more")
    whole = filled.join(F.broadcast(tail), [cr, ck], "left")  # a row a range at most
    out = {c: F.col(f"c{i}") for i, c in enumerate(rows.columns)}
    return whole.select(*(v.alias(c) for c, v in out.items()), F.coalesce("last", "was").alias("last"), (F.col("seen") + F.coalesce("more", F.lit(0))).alias("seen"))


def asof(reads: DataFrame, searches: DataFrame, by: list[str]) -> DataFrame:
    """Backward as-of join without a bound: ``reads (event_id, ts, *by)`` with ``search_id`` of the latest of ``searches`` at or before them, else null.

    Of searches at one time the one with the greatest id is the latest.
    """
    side = lambda rows, first: rows.select("event_id", "ts", *by, F.lit(first).alias("search"))
    both = side(searches, True).unionAll(side(reads, False))
    key = F.struct(*by) if len(by) > 1 else F.col(by[0])
    found = carried(both, key, F.col("ts"), F.col("search"), F.col("event_id"))
    return found.where("NOT search").select("event_id", "ts", *by, F.col("last").alias("search_id"))


def preceding_in_ring(searches: DataFrame, reads: DataFrame, most: int = 20, seconds: int = 600) -> DataFrame:
    """``read_id, search_id``: each read with the latest search of its session that showed its slug, if that is one of the session's
    ``most`` last searches and at most ``seconds`` old; else null. ``searches`` and ``reads`` hold ``event_id, ts, sid, slug``.
    """
    latest = asof(reads, searches, ["sid", "slug"]).select(F.col("event_id").alias("read_id"), "search_id")
    side = lambda rows, first: rows.select("event_id", "ts", "sid", F.lit(first).alias("search")).distinct()
    both = side(searches, True).unionAll(side(reads, False))
    numbered = cut(carried(both, F.col("sid"), F.col("ts"), F.col("search"), F.col("event_id")).select("event_id", "ts", "search", "seen"), "numbered")
    r = numbered.where("NOT search").select(F.col("event_id").alias("read_id"), F.col("ts").alias("read_ts"), F.col("seen").alias("so_far"))
    s = numbered.where("search").select(F.col("event_id").alias("search_id"), F.col("ts").alias("search_ts"), "seen")
    joined = latest.join(r, "read_id").join(s, "search_id", "left")
    late = F.col("read_ts") - F.col("search_ts") <= F.expr(f"INTERVAL {seconds} SECOND")
    return joined.select("read_id", F.when((F.col("so_far") - F.col("seen") < most) & late, F.col("search_id")).alias("search_id"))


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``key, state`` of keys that are changed, missing or extra."""
    j = old.withColumnRenamed("sha", "was").join(new, "key", "full_outer").where("NOT (was <=> sha)")
    state = F.when(F.col("sha").isNull(), "missing").when(F.col("was").isNull(), "extra").otherwise("changed")
    return j.select("key", state.alias("state"))


def contiguous_shards(rows: DataFrame, scope: str, n: int, *order) -> DataFrame:
    """``rows`` with ``shard``: whole scopes, in the order of their first rows, in ``n`` contiguous groups whose numbers of scopes differ by one at most.

    Raises if there are fewer scopes than shards. Scopes are numbered in ranges and meet their rows as a table of known size.
    """
    from tarn.operators.stats import numbered

    first = rows.groupBy(scope).agg(F.min(F.struct(*order)).alias("at"))
    placed = numbered(first, "at", scope).select(scope, "i")
    total = placed.count()
    if n > total:
        raise ValueError(f"{total} scopes do not make {n} shards")
    base, extra = divmod(total, n)
    long = extra * (base + 1)
    shard = F.when(F.col("i") < long, F.floor(F.col("i") / (base + 1))).otherwise(extra + F.floor((F.col("i") - long) / base))
    return rows.join(sized(cut(placed.select(scope, shard.cast("int").alias("shard")), "scopes")), scope)


def merge_shards(shards: list[tuple[DataFrame, dict]], keys: list[str]) -> DataFrame:
    """The rows of all shards, each given with its configuration. Raises if configurations differ or a key is in two rows."""
    if len({repr(sorted(config.items())) for _, config in shards}) > 1:
        raise ValueError("shards of different configurations")
    whole = functools.reduce(DataFrame.unionByName, (rows for rows, _ in shards))
    twice = whole.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"keys in more than one shard or row: {[tuple(r)[:-1] for r in twice]}")
    return whole
