"""Arrow-batch plumbing that the text operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one call of a worker sees, unless a single text is longer.
SLICE_BYTES = 2 << 20


#: Rows and bytes of an Arrow batch on its way to a worker: long texts must not pile up.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's bounds on Arrow batches to these, unless they are lower already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def named(column: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def by_place(rows: DataFrame) -> DataFrame:
    """``rows`` with columns named by their places: Arrow functions do not take names with dots."""
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``limit`` bytes of the named column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield batch.slice(start)


def map_texts(
    docs: DataFrame,
    text_col: str,
    keep: list,
    schema: str,
    setup: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Run ``setup()``'s function over slices of ``(text, *keep)`` of ``limit`` bytes; ``setup`` runs once a task.

    Only the text and the kept columns leave the scan, so other columns never reach Python and may
    bear any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            for part in slices(batch, 0, limit):
                yield work(part)
        pa.default_memory_pool().release_unused()

    bound_batches(docs.sparkSession)
    return docs.select(named(text_col).cast("string").alias("text"), *keep).mapInArrow(run, schema)


def large_text(column: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets from zero, null as empty.

    Offsets of a slice start elsewhere, which some kernels (``ascii_lower`` among them) mishandle.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if data is not None else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets - offsets[0]), data)
