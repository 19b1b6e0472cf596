"""Structured Streaming forms of the log operators.

The batch operators set no policy for late rows; the streams do: a watermark of the bound itself, so rows
later than that are dropped and the state of a session stays as long as it can matter. State that is kept by key lives in
RocksDB's store, entry by entry: a changed entry is one row written, and timers drop what no later row can need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tarn.operators import memory

EVENTS = "event_id long, ts timestamp, sid long, kind string, slug long"


def read_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A file-source stream of JSON events; checkpoints make every file count once."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(path)


def attributed_reads(events: DataFrame, seconds: int = 600) -> DataFrame:
    """Stream-stream interval join: each read with every search of its session that showed its slug within the bound."""
    late = f"{seconds} seconds"
    s = events.where("kind = 'search'").select(F.col("event_id").alias("search_id"), F.col("ts").alias("search_ts"), "sid", "slug").withWatermark("search_ts", late)
    r = events.where("kind = 'read'").select(F.col("event_id").alias("read_id"), F.col("ts").alias("read_ts"), F.col("sid").alias("rsid"), F.col("slug").alias("rslug")).withWatermark("read_ts", late)
    on = f"sid = rsid AND slug = rslug AND read_ts >= search_ts AND read_ts <= search_ts + INTERVAL {seconds} SECONDS"
    return s.join(r, F.expr(on)).select("search_id", "read_id", "sid", "slug")


def _stateful(spark: SparkSession) -> None:
    """State by entries needs a store that keeps them apart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


FACTS = "owner string, fp string, fact string, sessions long, first_seen long, last_seen long"


class FactQueue(StatefulProcessor):
    """Facts of one owner: an entry a fingerprint, an index of their order, and the sessions that said them.

    The ``most`` facts that came in last stay. Where ``keep_ms`` is given, entries that were not written for so long go too.
    """

    def __init__(self, most: int, keep_ms: int | None):
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle) -> None:
        self.entries = handle.getMapState("entries", "fp string", "place long, fact string, sessions long, first long, last long", self.keep_ms)
        self.order = handle.getMapState("order", "place long", "fp string", self.keep_ms)
        self.said = handle.getMapState("said", "fp string, session string", "once boolean", self.keep_ms)
        self.ends = handle.getValueState("ends", "head long, tail long", self.keep_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Facts that a table holds: ``owner, fp, fact, session_ids, first_seen, last_seen``, queued by when they were first seen."""
        frame = initialState if isinstance(initialState, pd.DataFrame) else pd.DataFrame([initialState])
        for row in frame.sort_values(["first_seen", "fp"]).itertuples():
            for session in dict.fromkeys(row.session_ids):
                self.said.updateValue((row.fp, session), (True,))
            self._push(row.fp, row.fact, len(set(row.session_ids)), int(row.first_seen), int(row.last_seen))
        self._trim()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[str, tuple] = {}
        for row in pd.concat(rows).sort_values(["ts", "session", "fact"]).itertuples():
            fp, ts = row.fact[:80].lower(), int(row.ts)
            if self.entries.containsKey((fp,)):
                place, fact, sessions, first, last = self.entries.getValue((fp,))
                if not self.said.containsKey((fp, row.session)):
                    self.said.updateValue((fp, row.session), (True,))
                    sessions += 1
                touched[fp] = place, fact, sessions, first, max(last, ts)
                self.entries.updateValue((fp,), touched[fp])
            else:
                self.said.updateValue((fp, row.session), (True,))
                touched[fp] = self._push(fp, row.fact, 1, ts, ts)
        self._trim()
        left = [(key[0], fp, *entry[1:]) for fp, entry in touched.items() if self.entries.containsKey((fp,))]
        yield pd.DataFrame(left, columns=["owner", "fp", "fact", "sessions", "first_seen", "last_seen"])

    def _push(self, fp: str, fact: str, sessions: int, first: int, last: int) -> tuple:
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        entry = tail, fact, sessions, first, last
        self.entries.updateValue((fp,), entry)
        self.order.updateValue((tail,), (fp,))
        self.ends.update((head, tail + 1))
        return entry

    def _trim(self) -> None:
        """First in, first out, once a trigger's rows are all in."""
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        if tail - head <= self.most:
            return
        gone = [fp for place in range(head, tail - self.most) if self.order.containsKey((place,)) for fp in self.order.getValue((place,))]
        for said in [k for k in self.said.keys() if k[0] in set(gone)]:
            self.said.removeKey(tuple(said))
        for fp in gone:
            self.entries.removeKey((fp,))
        for place in range(head, tail - self.most):
            self.order.removeKey((place,))
        self.ends.update((tail - self.most, tail))

    def close(self) -> None:
        pass


def fact_state(messages: DataFrame, most: int = 100, initial: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """Keyed state of extracted facts, one queue an owner, updated with every trigger (``update`` mode).

    ``messages (owner, session, ts, text)``. A repeat in another session adds that session to the queued fact, as many as
    there are; a queue keeps its ``most`` latest facts, and the first in goes first. Rows are the facts that a trigger touched. ``initial``
    holds queues to begin with (see ``FactQueue.handleInitialState``); it is read when a checkpoint is new.
    """
    _stateful(messages.sparkSession)
    found = memory.extract_facts(messages.select("session", "ts", "text", "owner"), keep=["owner"])
    mode = "None" if keep_ms is None else "ProcessingTime"
    start = initial.groupBy("owner") if initial is not None else None
    return found.groupBy("owner").transformWithStateInPandas(FactQueue(most, keep_ms), FACTS, "Update", mode, start)


READS = "read_id long, sid long, slug long, search_id long"


class SearchRing(StatefulProcessor):
    """The last searches of one session. A timer ``seconds`` after the latest one clears them."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "at long, event_id long, slugs array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring, out = [tuple(r) for r in self.ring.get()], []
        before, bound = list(ring), self.seconds * 1_000_000
        for row in pd.concat(rows).sort_values(["ts", "event_id"]).itertuples():
            now, slugs = int(row.ts.value // 1000), [int(s) for s in row.slugs]
            if row.kind == "search":
                if slugs:
                    ring = sorted([*ring, (now, int(row.event_id), slugs)], key=lambda r: r[:2])[-self.most :]
                continue
            hit = next((i for at, i, shown in reversed(ring) if slugs and slugs[0] in shown and 0 <= now - at <= bound), None)
            out.append((int(row.event_id), key[0], slugs[0] if slugs else None, hit))
        if ring != before:
            self.ring.put([(at, i, list(shown)) for at, i, shown in ring])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((ring[-1][0] + bound) // 1000 + 1)
        yield pd.DataFrame(out, columns=["read_id", "sid", "slug", "search_id"]).astype({"slug": "Int64", "search_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        yield pd.DataFrame(columns=["read_id", "sid", "slug", "search_id"]).astype({"read_id": "Int64", "sid": "Int64", "slug": "Int64", "search_id": "Int64"})

    def close(self) -> None:
        pass


def preceding_searches(events: DataFrame, most: int = 20, seconds: int = 600) -> DataFrame:
    """Each read with the latest of its session's ``most`` last searches that showed its slug within the bound, else null.

    ``events (event_id, ts, sid, kind, slugs)``. A session's state is its ring of searches; it goes once the watermark, ``seconds`` behind the
    latest event, has passed ``seconds`` after the last of them. Rows behind the watermark are dropped. A read sees the searches that
    came with its trigger or before; the batch form is ``logs.preceding_in_ring``.
    """
    _stateful(events.sparkSession)
    late = events.withWatermark("ts", f"{seconds} seconds")
    return late.groupBy("sid").transformWithStateInPandas(SearchRing(most, seconds), READS, "Append", "EventTime")


def run_updates(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what is there in ``update`` mode; every trigger's rows go to ``sink`` as parquet under its number, once."""

    def write(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/trigger={trigger}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what is there, append it to ``sink`` as parquet, and stop."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def digest_increments(lines: DataFrame, sink: str, checkpoint: str) -> None:
    """One digest of what arrived since the last: ``lines (path, line)`` of a file source.

    The checkpoint is the cursor. It moves on once a trigger's digest is written whole; a trigger that fails is taken again, under
    the same number, so a digest neither misses a file nor holds one twice.
    """

    def write(rows: DataFrame, trigger: int) -> None:
        # a sum, so that lines that stand twice do not cancel out; beside their number it tells files of nulls apart
        sums = F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("sum")
        files = rows.groupBy("path").agg(F.count("*").alias("lines"), sums)
        files.withColumn("trigger", F.lit(trigger)).write.mode("overwrite").parquet(f"{sink}/part={trigger}")

    lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def embed_increments(chunks: DataFrame, cache: str, checkpoint: str, embed) -> None:
    """Fill the cache ``(hash, vector)`` for what a stream of ``chunks (text)`` brings: each content is encoded once.

    ``embed`` makes a vector column of a text column. A trigger's new hashes are those that no other part of the cache holds, a cache that
    was there before the checkpoint included; it writes them under the checkpoint's mark and its own number, so one that is taken again
    replaces what it wrote.
    """
    mark = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]

    def write(rows: DataFrame, trigger: int) -> None:
        spark = rows.sparkSession
        new = rows.where("text IS NOT NULL").select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"])
        # what is there counts whichever stream wrote it, but for the files of this very trigger of this checkpoint
        if _there(spark, cache):
            known = spark.read.schema("hash string, vector array<double>, part string").parquet(cache)
            new = new.join(known.where(F.col("part") != f"{mark}-{trigger}").select("hash"), "hash", "left_anti")
        new.select("hash", embed(F.col("text")).alias("vector")).write.mode("overwrite").parquet(f"{cache}/part={mark}-{trigger}")

    chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
