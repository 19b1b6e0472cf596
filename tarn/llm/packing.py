"""Packing token streams into sequences of a fixed capacity by reciprocal classes.

Class ``j`` holds lengths of ``capacity / 2^j`` tokens, and a bin of the class takes ``2^j`` of them, no more and no fewer. A
document's length in binary says which classes it belongs to: it is cut into as many whole sequences as it fills and one
piece for every further binary digit, the longest first. Bins are filled in the order in which a worker meets the pieces,
each worker for itself: nothing is shuffled, and a task holds only the pieces of its open bins, fewer than twice
``capacity`` of them.

What stands in open bins when a worker ends is joined upwards: two pieces of a class make one unit of the next, up to whole
sequences. At most one unit a class is left, and it is a sequence of its own, of a length that is a power of two. So no
sequence needs padding where those lengths count as full, at any size of input, and all but a few a worker are ``capacity`` long.

Defined results: a null or empty text is a document of its end token alone; repeated rows are packed each; very long texts are
cut as any other; other columns are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.arrow import bound_batches, named, slices
from tarn.llm.bpe import ByteBPE

#: Characters that the encoder takes in one call; longer texts are encoded as trees.
LEAF = 1 << 16
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 1 << 20


class Packer:
    """Places for the pieces of one worker's documents."""

    def __init__(self, capacity: int, worker: int):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.classes = capacity, capacity.bit_length()
        self._next = worker << 40  # no worker makes 2^40 sequences
        self._open: list[pa.Table] = []

    def pieces(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents of these lengths, in their order: each piece's document, class, start and length."""
        whole, rest = lengths // self.capacity, lengths % self.capacity
        digits = rest[:, None] >> np.arange(self.classes - 2, -1, -1) & 1  # classes 1, 2, ... by columns
        counts = np.column_stack([whole, digits])
        of = np.repeat(np.tile(np.arange(self.classes), len(lengths)), counts.ravel())
        doc = np.repeat(np.arange(len(lengths)), counts.sum(axis=1))
        size = self.capacity >> of
        ends = np.cumsum(size)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
        return doc, of, ends - size - first[doc], size

    def place(self, rows: pa.Table) -> pa.Table:
        """Those of ``rows`` (with a column ``class``) and of the held ones whose bins are full now, with their places."""
        rows = pa.concat_tables([*self._open, rows]).combine_chunks()
        of = rows.column("class").to_numpy()
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=self.classes)
        nth = np.empty(len(of), np.int64)
        nth[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        bins = counts >> np.arange(self.classes)
        begins = self._next + np.cumsum(bins) - bins
        self._next += int(bins.sum())
        full = nth >> of < bins[of]
        self._open = [rows.filter(pa.array(~full))]
        placed = rows.filter(pa.array(full))
        of, nth = of[full], nth[full]
        return self._placed(placed, begins[of] + (nth >> of), (nth & (1 << of) - 1) * (self.capacity >> of))

    def close(self) -> pa.Table | None:
        """The held pieces, joined upwards."""
        if not self._open:
            return None
        rows = self._open[0]
        of = rows.column("class").to_numpy()
        units: list[list[int]] = []
        done: list[list[int]] = []
        for j in range(self.classes - 1, 0, -1):
            units += [[i] for i in np.flatnonzero(of == j).tolist()]
            if len(units) % 2:
                done.append(units.pop())  # alone in its class: a sequence as long as it is
            units = [a + b for a, b in zip(units[::2], units[1::2], strict=True)]
        done += units
        order = np.array([i for unit in done for i in unit], np.int64)
        number = np.repeat(np.arange(len(done)), [len(unit) for unit in done]) + self._next
        size = self.capacity >> of[order]
        ends = np.cumsum(size)
        new = np.ones(len(order), bool)
        new[1:] = number[1:] != number[:-1]
        begin = (ends - size)[new]
        self._next, self._open = self._next + len(done), []
        return self._placed(rows.take(pa.array(order)), number, ends - size - np.repeat(begin, np.diff([*np.flatnonzero(new), len(order)])))

    @staticmethod
    def _placed(rows: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> pa.Table:
        return rows.drop_columns(["class"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))


def pack(docs: DataFrame, vocabulary_path: str, pattern: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``, ids as little-endian unsigned 32-bit integers.

    A document is its text's tokens and ``end_id``. ``special`` says whether strings of special tokens are read as such.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.cached(vocabulary_path, pattern, LEAF)
        encode = bpe.encode_special if special else bpe.encode
        packer = Packer(capacity, TaskContext.get().partitionId())
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                each = [[*encode(t), end_id] if t else [end_id] for t in part.column(0).to_pylist()]
                lengths = np.fromiter(map(len, each), np.int64, len(each))
                ids = np.fromiter(itertools.chain.from_iterable(each), "<u4", int(lengths.sum()))
                doc, of, start, size = packer.pieces(lengths)
                ends = np.concatenate([[0], np.cumsum(size * 4)])
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                rows = pa.table(
                    {
                        "doc_id": part.column(1).take(pa.array(doc)),
                        "start": pa.array(start),
                        "length": pa.array(size),
                        "doc_tokens": pa.array(lengths[doc]),
                        "ids": packed.cast(pa.binary()),
                        "class": pa.array(of),
                    }
                )
                yield from packer.place(rows).to_batches()
        left = packer.close()
        if left is not None:
            yield from left.to_batches()

    bound_batches(docs.sparkSession)
    read = docs.select(named(text_col).cast("string").alias("text"), named(id_col).alias("doc_id"))
    return read.mapInArrow(run, f"doc_id {key}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")


def assemble(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """``(sequence_id, length, padded, ids)``: sequences with their pieces in place; ``padded`` is what a batch makes of the length.

    A sequence has at most ``capacity`` pieces, so no group is larger than that.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts)
    ids = F.aggregate("parts", F.lit(b""), lambda out, part: F.concat(out, part["ids"]))
    full = F.expr("length & (length - 1)") == 0
    return whole.select("sequence_id", "length", F.when(full, F.col("length")).otherwise(F.lit(capacity)).alias("padded"), ids.alias("ids"))
