"""Language-model scores by prediction by partial matching, pretrained on the corpus.

Training counts every (context, next byte) of up to ``order`` bytes in all training texts, and every context
takes part. Escapes follow method D (half a count of every distinct symbol goes to the escape), and
symbols of a longer context are excluded from the shorter ones, so the probabilities of all continuations,
the end of the text among them, sum to one.

The code length of a symbol depends on it and the ``order`` before it, a gram. Blocks of texts send their
distinct grams to shards of the trie; a shard holds all contexts that share their last ``SPLIT`` symbols. A task
reads a shard as a stream, first what training texts hold, which builds the trie, then what is asked, block
after block, so neither side is ever gathered whole. Only contexts shorter than ``SPLIT``, some 66,000 whatever
the corpus, are broadcast. The shards answer with code lengths, and the blocks sum them.

A unigram word score is computed beside it, in the same way: the shards hold parts of the vocabulary.

Defined results: a null or empty text consists of its end alone; texts are lower-cased in A-Z only; a row
without an id trains and is not held out; repeated rows count and are scored each; columns other than id
and text are not read, whatever their names; a very long text is a block of its own and is read in windows;
an empty table gives an empty one; without training texts all symbols are equally likely.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.arrow import bound_batches, large_text
from tarn.plans.scratch import cut

END, PAD = 256, 257
BITS = 9
SYMBOLS = 257
#: Last symbols of a context that choose its shard of the trie.
SPLIT = 2
#: A block ends at so many bytes of text or distinct grams, unless a single text has more.
BLOCK_BYTES, BLOCK_GRAMS = 32 << 20, 2 << 20
#: Bytes of text, and positions, that are worked on at once.
PIECE_BYTES, WINDOW = 2 << 20, 1 << 21


def _stream(texts: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``pad`` starts and before an end; where each text begins, and the end of all."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lengths = np.diff(offsets)
    begins = np.r_[0, np.cumsum(lengths + pad + 1)]
    out = np.full(begins[-1], PAD, np.uint16)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    for i in range(len(texts)):
        out[begins[i] + pad : begins[i + 1] - 1] = data[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]]
    out[begins[1:] - 1] = END
    return out, begins


def _windows(texts: pa.Array, order: int):
    """``(grams, text)`` of successive windows: each symbol and the ``order`` before it, packed, and its text's number."""
    symbols, begins = _stream(texts, order)
    for lo in range(order, len(symbols), WINDOW):
        hi = min(lo + WINDOW, len(symbols))
        gram = np.zeros(hi - lo, np.int64)
        for k in range(order + 1):
            gram <<= BITS
            gram |= symbols[lo - order + k : hi - order + k]
        real = symbols[lo:hi] != PAD
        text = np.repeat(np.arange(len(texts)), np.diff(np.clip(begins, lo, hi)))
        yield gram[real], text[real]


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


class Tally:
    """Counted keys; new ones wait until they are as many as the old, so merging stays in proportion."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > len(self.keys):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """All distinct keys, ascending, and their counts."""
        if self.size:
            keys, counts = zip((self.keys, self.counts), *self.waiting)
            self.keys, self.counts = _merged(np.concatenate(keys), np.concatenate(counts))
        self.waiting, self.size = [], 0
        return self.keys, self.counts


class Places:
    """Where each of some distinct keys stands: a hash table of at most a quarter of its slots, so most are found at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.r_[keys, -1]
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, len(keys), np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = left[free]  # of several at one free slot the last stays
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """The place of each key asked for, all of which are there."""
        at = self._slot(asked)
        out = self.slots[at]
        left = np.flatnonzero(self.keys[out] != asked)
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.slots[at[left]]
            left = left[self.keys[out[left]] != asked[left]]
        return out


def _pieces(texts: pa.Array, limit: int = PIECE_BYTES):
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if len(lengths) > lo:
        yield lo, len(lengths)


# --- the trie in shards ----------------------------------------------------------------------------


def _low(n: int) -> int:
    """Mask of the last ``n`` symbols."""
    return (1 << BITS * n) - 1


def _squeezed(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _spread(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Level:
    """Contexts of one length: counts of their symbols, and what each leaves of its parent after exclusion."""

    def __init__(self, k: int, keys: np.ndarray, counts: np.ndarray, parent: Level | None):
        starts = np.flatnonzero(np.r_[True, keys[1:] >> BITS != keys[:-1] >> BITS]) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys, counts
        self.total = np.add.reduceat(counts, starts) if len(keys) else counts
        self.distinct = np.diff(np.r_[starts, len(keys)])
        self.context = keys[starts] >> BITS
        if parent is None:
            self.left, self.fresh = self.total, self.distinct
        elif len(self.context):
            above = np.searchsorted(parent.context, self.context & _low(k - 1))
            shared = parent.counts[np.searchsorted(parent.keys, self.keys & _low(k))]
            self.left = parent.total[above] - np.add.reduceat(shared, np.cumsum(self.distinct) - self.distinct)
            self.fresh = parent.distinct[above] - self.distinct


def _levels(keys: np.ndarray, counts: np.ndarray, ks: range, lower: list[Level]) -> list[Level]:
    """Levels ``ks`` above ``lower`` from counted grams."""
    found = {}
    for k in reversed(ks):
        keys = keys & _low(k + 1)
        keys, counts = _merged(keys, counts) if len(keys) else (keys, counts)
        found[k] = keys, counts
    levels = list(lower)
    for k in ks:
        levels.append(Level(k, *found[k], levels[-1] if levels else None))
    return levels


def _costs(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each gram's last symbol after the others."""
    out, done, entered = np.zeros(len(grams)), np.zeros(len(grams), bool), np.zeros(len(grams), bool)
    left, fresh = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if not len(level.context):
            continue
        context, key = grams >> BITS & _low(k), grams & _low(k + 1)
        i = np.minimum(np.searchsorted(level.context, context), len(level.context) - 1)
        j = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
        there = level.context[i] == context
        total, distinct = np.where(entered, left, level.total[i]), np.where(entered, fresh, level.distinct[i])
        has = level.keys[j] == key
        hit, miss = there & ~done & has, there & ~done & ~has & (distinct > 0)
        out[hit] += np.log10(2 * level.counts[j[hit]] - 1) - np.log10(2 * total[hit])
        out[miss] += np.log10(distinct[miss]) - np.log10(2 * total[miss])
        done |= hit
        entered |= there
        if k:
            left, fresh = np.where(there, level.left[i], left), np.where(there, level.fresh[i], fresh)
    out[~done] -= np.log10(max(1, SYMBOLS - len(levels[0].keys)))
    return out


def _gram_shard(keys: np.ndarray, order: int, shards: int) -> np.ndarray:
    return ((keys >> BITS & _low(min(SPLIT, order))) * 2654435761 >> 9) % shards


# --- blocks of texts -------------------------------------------------------------------------------

#: Of each block its texts, a piece a row (phase 3); all its words and grams in the order of the shards (phase 2); and for
#: each shard what training texts hold, with counts (phase 0), and what is asked (phase 1).
BLOCK_SCHEMA = pa.schema(
    [
        ("block", pa.int64()), ("phase", pa.int32()), ("at", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()),
        ("learned", pa.binary()), ("texts", pa.binary()), ("lengths", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
        ("n_tokens", pa.list_(pa.int64())), ("train_tokens", pa.int64()), ("train_docs", pa.int64()),
    ]
)
BLOCK = (
    "block long, phase int, at int, words binary, counts binary, grams binary, learned binary, texts binary, lengths binary, "
    "doc_ids array<bigint>, held_out array<boolean>, n_tokens array<bigint>, train_tokens long, train_docs long"
)


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts, and of each token its word's number and its text's."""
    lists = pc.ascii_split_whitespace(texts)
    tokens = lists.flatten()
    text = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    real = pc.greater(pc.binary_length(tokens), 0)
    coded = tokens.filter(real).dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False), text[real.to_numpy(zero_copy_only=False)]


class Block:
    """What texts send to the shards; the texts themselves go on piece by piece."""

    def __init__(self, number: int, order: int, shards: int):
        self.number, self.order, self.shards = number, order, shards
        self.pieces = self.size = 0
        self.grams, self.words = Tally(), defaultdict(int)

    def add(self, texts: pa.Array, ids: pa.Array, held: pa.Array) -> pa.RecordBatch:
        """Take a piece in; its row."""
        trains = ~held.to_numpy(zero_copy_only=False)
        words, word, text = _words(texts)
        for w, n in zip(words, np.bincount(word[trains[text]], minlength=len(words)).tolist()):
            self.words[w] += n
        n_tokens = np.bincount(text, minlength=len(texts)) + 1
        for grams, text in _windows(texts, self.order):
            learns = trains[text]
            self.grams.add(*np.unique(grams[learns], return_counts=True))
            asked = np.unique(grams[~learns])
            self.grams.add(asked, np.zeros(len(asked), np.int64))
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("<i8")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        row = {
            "block": self.number, "phase": 3, "at": self.pieces, "texts": _squeezed(data), "lengths": _squeezed(lengths), "doc_ids": ids.to_pylist(),
            "held_out": (~trains).tolist(), "n_tokens": n_tokens.tolist(), "train_tokens": int(n_tokens[trains].sum()), "train_docs": int(trains.sum()),
        }
        self.pieces += 1
        self.size += len(data)
        return pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)

    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or len(self.grams.keys) >= BLOCK_GRAMS

    def rows(self):
        """The rows of the shards and of the block, a few at a time."""
        words = sorted(self.words, key=lambda w: zlib.crc32(w) % self.shards)
        counts = np.array([self.words[w] for w in words], "<i8")
        bounds = np.searchsorted([zlib.crc32(w) % self.shards for w in words], np.arange(self.shards + 1))
        keys, learned = self.grams.settle()
        held_by = _gram_shard(keys, self.order, self.shards)
        order = np.argsort(held_by, kind="stable")
        keys, learned = keys[order], learned[order]
        ends = np.searchsorted(held_by[order], np.arange(self.shards + 1))
        rows = [{"block": self.number, "phase": 2, "at": -1, "words": b" ".join(words), "grams": _squeezed(np.diff(keys, prepend=0))}]
        for s in range(self.shards):
            mine, own = slice(bounds[s], bounds[s + 1]), slice(ends[s], ends[s + 1])
            for phase in (0, 1):
                w, c, g, n = words[mine], counts[mine], keys[own], learned[own]
                if not phase:
                    w, c, g, n = [x for x, y in zip(w, c) if y], c[c > 0], g[n > 0], n[n > 0]
                if w or len(g):
                    row = {"block": self.number, "phase": phase, "at": s, "words": b" ".join(w), "grams": _squeezed(np.diff(g, prepend=0))}
                    rows.append(row if phase else row | {"counts": c.tobytes(), "learned": _squeezed(n.astype("<i8"))})
            if len(rows) >= 64:
                yield pa.RecordBatch.from_pylist(rows, BLOCK_SCHEMA)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, BLOCK_SCHEMA)


ANSWER = "block long, at int, totals binary, known long, costs binary"


class Shard:
    """One shard's vocabulary and trie."""

    def __init__(self, order: int, low: tuple[np.ndarray, np.ndarray]):
        self.order, self.low = order, low
        self.total, self.tally, self.levels = defaultdict(int), Tally(), None

    def learn(self, words: bytes, counts: bytes, grams: bytes, learned: bytes) -> None:
        for w, n in zip(words.split(b" ") if words else (), np.frombuffer(counts, "<i8").tolist()):
            self.total[w] += n
        self.tally.add(np.cumsum(_spread(grams, "<i8")), _spread(learned, "<i8"))

    def answer(self, words: bytes, grams: bytes) -> tuple[bytes, bytes]:
        if self.levels is None:
            split = min(SPLIT, self.order)
            self.levels = _levels(*self.tally.settle(), range(split, self.order + 1), _levels(*self.low, range(split), []))
        totals = [self.total.get(w, 0) for w in words.split(b" ")] if words else []
        return np.array(totals, "<i8").tobytes(), _squeezed(_costs(np.cumsum(_spread(grams, "<i8")), self.levels).astype("<f8"))


class Sums:
    """The answers to one block, and sums of them over each document."""

    def __init__(self, words: bytes, grams: bytes, order: int):
        self.order, self.keys = order, np.cumsum(_spread(grams, "<i8"))
        self.place = {w: i for i, w in enumerate(words.split(b" "))} if words else {}
        self.totals, self.costs = [], []

    def add(self, totals: bytes, costs: bytes) -> None:
        """The answer of the next shard."""
        self.totals.append(np.frombuffer(totals, "<i8"))
        self.costs.append(_spread(costs, "<f8"))

    def of(self, row: dict) -> pa.RecordBatch:
        """The documents of a piece."""
        if isinstance(self.totals, list):
            self.totals = np.concatenate([np.empty(0, np.int64), *self.totals])
            self.costs = np.concatenate([np.empty(0), *self.costs])
            self.places = Places(self.keys)
        lengths, data = _spread(row["lengths"], "<i8"), _spread(row["texts"], "u1")
        n = len(lengths)
        texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.r_[0, np.cumsum(lengths)]), pa.py_buffer(data))
        words, word, text = _words(texts)
        there = self.totals[[self.place[w] for w in words]] if words else self.totals[:0]
        logs = np.bincount(text, weights=np.log10(there + 0.5)[word], minlength=n).astype(np.float64)  # of no words the sums are integers
        known = np.bincount(text, weights=(there > 0)[word], minlength=n).astype(np.int64)
        score = np.zeros(n)
        for grams, text in _windows(texts, self.order):
            score += np.bincount(text, weights=self.costs[self.places(grams)], minlength=n)
        ids, held, n_tokens = pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(row["n_tokens"], pa.int64())
        return pa.RecordBatch.from_arrays([ids, held, pa.array(score), n_tokens, pa.array(known), pa.array(logs)], ["doc_id", "held_out", "score", "n_tokens", "known_words", "logs"])


def score_texts(docs: DataFrame, held_out: Column, order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``held_out`` is a condition on ``doc_id``; rows for which it is true are scored but not learned from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        number = itertools.count(TaskContext.get().partitionId() << 32)
        block = None
        for batch in batches:
            lowered = pc.ascii_lower(large_text(batch.column(0)))
            for lo, hi in _pieces(lowered):
                block = block or Block(next(number), order, shards)
                yield block.add(lowered.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo))
                if block.full():
                    yield from block.rows()
                    block = None
        if block:
            yield from block.rows()
        pa.default_memory_pool().release_unused()

    bound_batches(spark)
    blocks = cut(rows.mapInArrow(deal, BLOCK), "blocks")
    sent = blocks.where("phase < 2").select("at", "phase", "block", "words", "counts", "grams", "learned")

    def short(batches):
        tally = Tally()
        for batch in batches:
            for g, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.cumsum(_spread(g, "<i8")) & _low(min(SPLIT, order))
                if len(keys):
                    tally.add(*_merged(keys, _spread(n, "<i8")))
        keys, counts = tally.settle()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

    # at most 258 * 257 rows
    low = sent.where("phase = 0").select("grams", "learned").mapInArrow(short, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    low = spark.sparkContext.broadcast((low.column("gram").to_numpy(), low.column("n").to_numpy()))

    def answer(batches):
        at, shard, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["at"] != at:
                    at, shard = row["at"], Shard(order, low.value)
                if row["phase"] == 0:
                    shard.learn(row["words"], row["counts"], row["grams"], row["learned"])
                    continue
                known = len(shard.total) if shard.levels is None else 0
                totals, costs = shard.answer(row["words"], row["grams"])
                out.append((row["block"], at, totals, known, costs))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()))], ["block", "at", "totals", "known", "costs"])
                out = []

    answers = cut(sent.repartition("at").sortWithinPartitions("at", "phase", "block").mapInArrow(answer, ANSWER), "answers")
    # of each block first its words and grams, then the shards' answers, then its texts
    columns = ["block", "kind", "at", "words", "grams", "totals", "costs", "texts", "lengths", "doc_ids", "held_out", "n_tokens"]
    own = blocks.where("phase >= 2").withColumn("kind", F.when(F.col("phase") == 2, 0).otherwise(2))
    every = own.unionByName(answers.withColumn("kind", F.lit(1)), allowMissingColumns=True).select(columns)

    def total(batches):
        sums = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    sums = Sums(row["words"], row["grams"], order)
                elif row["kind"] == 1:
                    sums.add(row["totals"], row["costs"])
                else:
                    yield sums.of(row)
        pa.default_memory_pool().release_unused()

    scored = every.repartition("block").sortWithinPartitions("block", "kind", "at")
    scored = scored.mapInArrow(total, "doc_id long, held_out boolean, score double, n_tokens long, known_words long, logs double")
    n, ends = blocks.where("phase = 3").agg(F.sum("train_tokens"), F.sum("train_docs")).first()
    n, ends = n or 0, ends or 0
    distinct = (answers.agg(F.sum("known")).first()[0] or 0) + (ends > 0)
    base = F.col("logs") + F.lit(float(np.log10(ends + 0.5))) - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (distinct + 1))))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known_words") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
