"""Alignment of two tokenizers over a corpus: which tokens of one stand for which of the other.

Both tokenizers encode the same bytes. Tokens are the nodes of a bipartite graph, and an edge joins two whose bytes overlap; its
connected components, found by union-find, are exactly the least groups of whole tokens of both sides. Every two tokens of a
component from different sides are a link. A link's count is the number of documents of the whole corpus that hold its pair of ids.

1. Tasks gather documents to blocks of a bounded size. A block lists its distinct pairs by falling document count, and each document
   holds its pairs as places in that list, so what is written is about two bytes a pair.
2. A block's list, with counts that are summed already, is its request. Requests are summed by pair, each first token learns its highest
   count, and the answers go back to the blocks that asked: a pair travels once a block, so no key is hotter than the number of blocks.
3. Each block meets its answers and adds them up for its documents.

Very long texts are cut where both tokenizers certainly have an end: before a space that follows no white space.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens and zero in
all numbers; repeated rows are documents of their own; other columns are not read, whatever their names; an empty table gives an
empty one. A group of very many tokens is linked by its distinct ids, not by its pairs of tokens.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.arrow import bound_batches, named
from tarn.llm.bpe import ByteBPE
from tarn.plans.scratch import cut

#: Fixed value: the mark that stands for a space in pieces.
MARK = "▁"
#: Characters that the encoder takes in one call, and of a segment of a long text.
LEAF, SEGMENT = 1 << 16, 1 << 20
#: Bytes of text that are aligned at a time, and of a block.
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20
#: Links of a group that are made one by one; beyond it distinct ids are counted first.
EXPANDED = 256


class Pieces:
    """Encoder for a sentencepiece model, and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else b"" if self._model.is_control(i) or self._model.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        #: Whether no piece goes on after a space, so that texts may be cut before one.
        self.ends_at_spaces = all(MARK not in p.lstrip(MARK) for p in names)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, before which the model puts a space."""
        return self._model.encode(text)


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """A text that begins with a space, in parts that do so too, each at least ``most`` characters long but for the last."""
    start = 0
    while len(text) - start > most and (found := _ENDS.search(text, start + most)):
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


_ENDS = re.compile(r"\S(?= )")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by union-find over all edges ``a``-``b`` at once.

    Roots hang below their least neighbouring root, then paths are halved until every node points to its root.
    """
    parent = np.arange(n)
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    return parent


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, numbered in order, from the tokens' ascending ends over the same bytes."""
    n_a, n_b = len(ends_a), len(ends_b)
    if not n_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = np.zeros((2, int(ends_a[-1]) + 1), np.int8)
    marks[0, ends_a] = marks[1, ends_b] = 1
    ends = np.flatnonzero(marks[0] | marks[1])  # each ends a stretch of bytes in one token of either side: an edge
    over_a, over_b = np.cumsum(marks[0], dtype=np.int32)[ends - 1], np.cumsum(marks[1], dtype=np.int32)[ends - 1]
    root = roots(n_a + n_b, over_a, over_b + n_a)
    group_a = np.cumsum(root[:n_a] == np.arange(n_a)) - 1
    return group_a, group_a[root[n_a:]]


def linked(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of all groups as ``(group, pair, how many)``, a pair being ``a * n_b + b``; a row may repeat a pair."""
    if not len(ids_a):
        return (np.zeros(0, np.int64),) * 3
    count_a, count_b = np.bincount(group_a), np.bincount(group_b)
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    small = count_a * count_b <= EXPANDED
    at = np.flatnonzero(small[group_a])
    times = count_b[group_a[at]]
    left = np.repeat(at, times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b[group_a[at]], times)
    out = [(group_a[left], ids_a[left] * n_b + ids_b[right], np.ones(len(left), np.int64))]
    for g in np.flatnonzero(~small):
        a, many_a = np.unique(ids_a[first_a[g] : first_a[g] + count_a[g]], return_counts=True)
        b, many_b = np.unique(ids_b[first_b[g] : first_b[g] + count_b[g]], return_counts=True)
        out.append((np.full(len(a) * len(b), g), (a[:, None] * n_b + b).ravel(), (many_a[:, None] * many_b).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _digits(n: int, width: int) -> np.ndarray:
    table = np.zeros((n, width + 1), np.uint8)
    table[:, :width] = np.array([str(i) for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)
    return table


class Aligner:
    """Both tokenizers, and what they make of slices of texts."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.a, self.b = ByteBPE.cached(path_a, pattern, LEAF), Pieces(path_b)
        self.n_a, self.n_b = len(self.a.tokens), len(self.b.tokens)
        self._lengths = [np.array([len(t) for t in tokens], np.int64) for tokens in (self.a.tokens, self.b.tokens)]
        width = len(str(max(self.n_a, self.n_b)))
        self._shown = _digits(self.n_a, width), _digits(self.n_b, width)

    def parts(self, text: str | None) -> Iterator[str]:
        """What is aligned one after the other: the text after a space, cut if it is very long."""
        if text:
            yield from segments(" " + text) if self.b.ends_at_spaces else [" " + text]

    def encode(self, part: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides, or nothing if one of them loses bytes."""
        a, b, raw = self.a.encode(part), self.b.encode(part[1:]), part.encode()
        same = b"".join(map(self.a.tokens.__getitem__, a)) == raw and b"".join(map(self.b.tokens.__getitem__, b)) == raw
        return (a, b) if same else None

    def align(self, coded: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, ...]:
        """Of parts of the same bytes: ids, lengths and groups of both sides, and the number of the part that each group is in."""
        flat = [np.fromiter(itertools.chain.from_iterable(c[side] for c in coded), np.int64) for side in (0, 1)]
        lengths = [self._lengths[side][flat[side]] for side in (0, 1)]
        group_a, group_b = groups_of(np.cumsum(lengths[0]), np.cumsum(lengths[1]))
        part_a = np.repeat(np.arange(len(coded)), [len(c[0]) for c in coded])
        first = np.flatnonzero(np.diff(group_a, prepend=-1))
        return *flat, *lengths, group_a, group_b, part_a[first]

    def shown(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, part: np.ndarray, n_parts: int) -> list[memoryview]:
        """Each part's groups as ``a1,a2|b1;a3|b2,b3;``."""
        count_a, count_b = np.bincount(group_a), np.bincount(group_b)
        out = np.empty((len(a) + len(b), self._shown[0].shape[1]), np.uint8)
        ends = np.cumsum(count_a), np.cumsum(count_b)
        at_a = np.arange(len(a)) + (ends[1] - count_b)[group_a]
        at_b = np.arange(len(b)) + ends[0][group_b]
        out[at_a], out[at_b] = self._shown[0][a], self._shown[1][b]
        out[:, -1] = ord(",")
        out[at_a[ends[0] - 1], -1], out[at_b[ends[1] - 1], -1] = ord("|"), ord(";")
        used = np.count_nonzero(out, axis=1)
        of = np.empty(len(out), np.int64)
        of[at_a], of[at_b] = part[group_a], part[group_b]
        stops = np.cumsum(np.bincount(of, used, n_parts).astype(np.int64))
        flat = memoryview(out[out != 0])
        return [flat[start:stop] for start, stop in itertools.pairwise([0, *stops])]


class _Block:
    """Documents of one block and what is known of them so far."""

    NUMBERS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, aligner: Aligner):
        self.aligner, self.ids, self.bytes = aligner, [], 0
        self.numbers, self.hashes, self.lost = [], [], set()
        self._links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting: list[tuple[int, tuple[list[int], list[int]]]] = []
        self._waits = 0

    def add(self, doc_id, text: str | None) -> None:
        doc = len(self.ids)
        self.ids.append(doc_id)
        self.numbers.append([0, 0, 0, 0])
        self.hashes.append(None)
        for part in self.aligner.parts(text):
            coded = self.aligner.encode(part)
            if coded is None:
                self.lost.add(doc)
                break
            self._waiting.append((doc, coded))
            self._waits += len(part)
            self.bytes += len(part)
            if self._waits >= SLICE_BYTES:
                self._work()

    def _work(self) -> None:
        if not self._waiting:
            return
        docs, coded = zip(*self._waiting, strict=True)
        self._waiting, self._waits = [], 0
        a, b, _, _, group_a, group_b, part = self.aligner.align(coded)
        links = np.bincount(group_a) * np.bincount(group_b)
        n_groups, n_links = np.bincount(part, minlength=len(docs)), np.zeros(len(docs), np.int64)
        np.add.at(n_links, part, links)
        for doc, (x, y), groups, many, text in zip(docs, coded, n_groups, n_links, self.aligner.shown(a, b, group_a, group_b, part, len(docs)), strict=True):
            self.numbers[doc] = [n + int(m) for n, m in zip(self.numbers[doc], (len(x), len(y), groups, many), strict=True)]
            if self.hashes[doc] is None:
                self.hashes[doc] = hashlib.sha256(text[:-1])
            else:
                self.hashes[doc].update(b";")
                self.hashes[doc].update(text[:-1])
        group, pair, many = linked(a, b, group_a, group_b, self.aligner.n_b)
        self._links.append(_summed(np.array(docs)[part[group]], pair, many))

    def rows(self) -> tuple[pa.Array, pa.Array, dict[str, list], list[bytes | None]]:
        """The block's distinct pairs and their document counts, the most frequent first; each document's numbers and packed pairs."""
        self._work()
        doc, pair, many = _summed(*(np.concatenate(c) for c in zip(*self._links, strict=True))) if self._links else (np.zeros(0, np.int64),) * 3
        if self.lost:
            kept = ~np.isin(doc, list(self.lost))
            doc, pair, many = doc[kept], pair[kept], many[kept]
        pairs, place, counts = np.unique(pair, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[place]
        order_in_doc = np.lexsort((place, doc))
        place, many, doc = place[order_in_doc], many[order_in_doc], doc[order_in_doc]
        stops = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        packed = [pack(place[i:j], many[i:j]) if j > i else None for i, j in itertools.pairwise(stops)]
        whole = [[0] * 4 if i in self.lost else n for i, n in enumerate(self.numbers)]
        hashes = ["" if i in self.lost or h is None else h.hexdigest() for i, h in enumerate(self.hashes)]
        numbers = {name: [n[k] for n in whole] for k, name in enumerate(self.NUMBERS)} | {"groups_sha256": hashes}
        return pa.array(pairs[order], pa.int64()), pa.array(counts[order], pa.int64()), numbers, packed


def _summed(doc: np.ndarray, pair: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each document and pair, in that order."""
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], pair[starts], np.add.reduceat(many[order], starts) if len(doc) else many


def pack(places: np.ndarray, many: np.ndarray) -> bytes:
    """Ascending places and how often each stands, as compressed planes of bytes of their differences."""
    rows = np.concatenate([np.diff(places, prepend=0), many]).astype("<u8" if many.max() >> 32 else "<u4")
    planes = rows.view(np.uint8).reshape(len(rows), rows.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + bytes([rows.itemsize]) + pa.compress(planes, "zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``pack`` was given."""
    size, width = int.from_bytes(packed[:8], "little"), packed[8]
    planes = np.frombuffer(pa.decompress(packed[9:], size, "zstd", asbytes=True), np.uint8).reshape(width, -1)
    rows = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)
    half = len(rows) // 2
    return np.cumsum(rows[:half]), rows[half:]


def _blocks(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents and, with ``pairs``, of blocks."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(path_a, pattern, path_b), TaskContext.get().partitionId() << 32
        block, kind = _Block(aligner), None

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, counts, numbers, packed = block.rows()
            n = len(packed)
            lists = {"pairs": pairs, "counts": counts}
            doc = [pa.array([number] * n, pa.int64()), pa.array(block.ids, kind), *(pa.array(v, pa.int64()) for k, v in numbers.items() if k != "groups_sha256"), pa.array(numbers["groups_sha256"]), pa.array(packed, pa.binary())]
            names = ["block", "doc_id", *_Block.NUMBERS, "groups_sha256", "packed"]
            for at in range(0, n, 1000):  # rows in batches of moderate size
                rows = [c.slice(at, 1000) for c in doc]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(rows[0]), pa.list_(pa.int64())) for _ in lists)], [*names, *lists])
            own = [pa.array([number], pa.int64()), pa.nulls(1, kind), *(pa.nulls(1, pa.int64()) for _ in _Block.NUMBERS), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *(pa.ListArray.from_arrays([0, len(v)], v) for v in lists.values())], [*names, *lists])

        for batch in batches:
            kind = batch.schema.field(1).type
            for doc_id, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                block.add(doc_id, text)
                if block.bytes >= BLOCK_BYTES or len(block.ids) >= BLOCK_BYTES >> 6:
                    yield from flush()
                    block, number = _Block(aligner), number + 1
        if block.ids:
            yield from flush()

    bound_batches(docs.sparkSession)
    numbers = "".join(f"{n} long, " for n in _Block.NUMBERS)
    read = docs.select(named(text_col).cast("string").alias("text"), named(id_col).alias("doc_id"))
    return read.mapInArrow(run, f"block long, doc_id {key}, {numbers}groups_sha256 string, packed binary, pairs array<long>, counts array<long>")


def _counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """``(pair, n_docs, best)`` of all pairs."""
    asked = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.*")
    counts = cut(asked.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n_docs")), "pairs")
    first = F.expr(f"pair div {n_b}").alias("a")
    highest = counts.groupBy(first).agg(F.max("n_docs").alias("highest"))
    return counts.withColumn("a", first).join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a_id, b_id, n_docs, best)``: the ids that are linked anywhere, and whether no other partner of ``a_id`` is in more documents."""
    n_b = len(Pieces(path_b).tokens)
    counted = _counts(cut(_blocks(docs, path_a, pattern, path_b, id_col, text_col), "aligned"), n_b)
    return counted.select(F.expr(f"cast(pair div {n_b} as int)").alias("a_id"), (F.col("pair") % n_b).cast("int").alias("b_id"), "n_docs", "best")


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per input row."""
    blocks = cut(_blocks(docs, path_a, pattern, path_b, id_col, text_col), "aligned")
    counted = _counts(blocks, len(Pieces(path_b).tokens))
    asked = blocks.where("pairs is not null").select(F.col("block").alias("asks"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counted, "pair").select("asks", "place", "n_docs", "best")
    own = blocks.where("pairs is null").drop("pairs", "counts")

    def meet(rows: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("place").to_numpy()
        n_docs, best = (np.zeros(len(place), np.int64) for _ in range(2))
        n_docs[place], best[place] = known.column("n_docs").to_numpy(), known.column("best").to_numpy()
        sums = []
        for packed in rows.column("packed").to_pylist():
            at, many = unpack(packed) if packed else (np.zeros(0, np.int64),) * 2
            sums.append((int(many @ best[at]), int(many @ n_docs[at])))
        found = [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
        kept = {n: rows.column(n) for n in ("doc_id", *_Block.NUMBERS)}
        return pa.table(kept | {"n_best": found[0], "count_sum": found[1], "groups_sha256": rows.column("groups_sha256")})

    key = docs.schema[id_col].dataType.simpleString()
    numbers = "".join(f"{n} long, " for n in _Block.NUMBERS)
    return own.groupBy("block").cogroup(answers.groupBy("asks")).applyInArrow(meet, f"doc_id {key}, {numbers}n_best long, count_sum long, groups_sha256 string")


def groups(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, part, groups)``: the least groups with their bytes after the leading space, in parts of a bounded size for very long texts."""
    key = docs.schema[id_col].dataType.simpleString()
    kind = "struct<start: long, end: long, a: array<int>, b: array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, pattern, path_b)
        for batch in batches:
            for doc_id, text in zip(batch.column(1), batch.column(0).to_pylist(), strict=True):
                coded = [aligner.encode(p) for p in aligner.parts(text)]
                start = -1
                for n, part in enumerate(coded if None not in coded else []):
                    a, b, length, _, group_a, group_b, _ = aligner.align([part])
                    sizes = [np.concatenate([[0], np.cumsum(np.bincount(g))]).astype(np.int32) for g in (group_a, group_b)]
                    ends = start + np.cumsum(length)[sizes[0][1:] - 1]
                    starts = np.concatenate([[start], ends[:-1]])
                    lists = [pa.ListArray.from_arrays(s, pa.array(ids, pa.int32())) for s, ids in zip(sizes, (a, b), strict=True)]
                    found = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends), *lists], ["start", "end", "a", "b"])
                    start = int(ends[-1])
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], doc_id.type), pa.array([n], pa.int32()), pa.ListArray.from_arrays([0, len(found)], found)], ["doc_id", "part", "groups"])

    bound_batches(docs.sparkSession)
    read = docs.select(named(text_col).cast("string").alias("text"), named(id_col).alias("doc_id"))
    return read.mapInArrow(run, f"doc_id {key}, part int, groups array<{kind}>")
