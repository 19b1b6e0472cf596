"""Phrase collocations: how much more often words stand together than apart, over exact counts of a whole corpus.

1. Texts are lower-cased (A-Z) and cut into pieces, and identical pieces become one row with a multiplicity.
2. Every task makes the weighted n-grams of its pieces, adds up those it has seen and sends them to hash buckets of
   (group, phrase); a bucket is summed by duckdb within a bound of memory, beyond which it goes to that task's own temporary
   files. Phrases below the least count end there.
3. Words and pairs come first. Longer phrases are made only where all pairs inside may be frequent, which a Bloom
   filter of fixed size tells: it errs towards more phrases, so counts never depend on it.
4. Each candidate asks for the counts of its parts: requests are shuffled to where the counts are, so parts meet by their key,
   and answers, eight a candidate at most, return to the candidate.

Phrases of two words and more are candidates; parts of a candidate are as frequent as it is, so all have been kept.

Defined results: a null text is empty and a null group is ``und``; texts or pieces without words add nothing; repeated rows count
each; a very long piece is one row; other columns are not read, whatever their names; an empty table gives an empty one.
Products have up to 38 digits: ``1000 * a * n`` beyond that raises.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.arrow import bound_batches, large_text, named, slices
from tarn.plans.scratch import cut, sized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of pieces.
ENDS = r"[.,;:!?\x0A-\x0D]"
#: Words of the longest phrase.
LONGEST = 5
#: Bytes of pieces whose n-grams a task adds up at a time, and what a bucket's duckdb may hold in memory.
SLICE_BYTES, BUCKET_MEMORY = 8 << 20, "256MB"
#: The filter of frequent pairs has 2^26 bits (8 MB), each pair sets three.
FILTER_BITS, PROBES = 26, (0, 19, 38)
GRAMS = "lang string, size int, phrase string, f long"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, piece, m)``: distinct pieces that have words, and how often each stands in the texts."""
    lower = F.translate(named(text_col).cast("string"), UPPER + "\t", LOWER + " ")
    lang = F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang")
    cut_up = docs.select(lang, F.explode(F.split(lower, ENDS)).alias("piece"))
    return cut_up.select("lang", F.trim("piece").alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _pair_hash(lang: Column, first: Column, second: Column) -> Column:
    turned = lambda h, by: F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))
    return F.xxhash64(first).bitwiseXOR(turned(F.xxhash64(second), 21)).bitwiseXOR(turned(F.xxhash64(lang), 42))


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """A Bloom filter of ``(lang, phrase)`` rows of two words, as 64-bit words: 8 MB whatever the number of pairs."""
    words = F.split("phrase", " ")
    h = pairs.select(_pair_hash(F.col("lang"), words[0], words[1]).alias("h"))
    at = F.explode(F.array(*(F.shiftrightunsigned("h", p).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for p in PROBES)))
    bits = h.select(at.alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("b"))
    found = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 2^20 rows of two numbers at most
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def _hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def _possible(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for p in PROBES:
        at = h >> np.uint64(p) & np.uint64((1 << FILTER_BITS) - 1)
        found &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal keys: the first place and the sum of weights; and every key's number among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    starts = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[starts], np.add.reduceat(weights[order], starts) if len(keys) else weights[:0], number


def grams(batch: pa.RecordBatch, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The weighted n-grams of ``(lang, piece, m)`` rows: words and pairs, and per group the number of words as
    phrase '' of size 0; or, with a filter of pairs, the longer ones. Each distinct one is one row."""
    lists = pc.split_pattern(large_text(batch.column(1)), " ")
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    words, row = words.filter(pa.array(full)), row[full]
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    langs = batch.column(0).dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    weight = batch.column(2).to_numpy(zero_copy_only=False)[row]
    n_words = max(1, len(coded.dictionary))

    def shown(size: int, places: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        parts = [coded.dictionary.take(pa.array(code[places + i])) for i in range(size)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if parts else pa.array([""] * len(places))
        of = langs.dictionary.take(pa.array(lang[places]))
        return pa.RecordBatch.from_arrays([of.cast(pa.string()), pa.array(np.full(len(places), size, np.int32)), phrase.cast(pa.string()), pa.array(f)], ["lang", "size", "phrase", "f"])

    if bits is None:
        first, f, _ = _summed(lang, weight)
        yield shown(0, first, f)
        first, f, number = _summed(lang * n_words + code, weight)
        yield shown(1, first, f)
        at = np.flatnonzero(row[1:] == row[:-1])
        first, f, _ = _summed(number[at] * n_words + code[at + 1], weight[at])
        yield shown(2, at[first], f)
        return
    h, lang_h = _hashes(coded.dictionary), _hashes(langs.dictionary)
    pair = np.zeros(len(code), bool)
    at = np.flatnonzero(row[1:] == row[:-1])
    pair[at] = _possible(bits, h[code[at]] ^ _turned(h[code[at + 1]], 21) ^ _turned(lang_h[lang[at]], 42))
    at = np.flatnonzero(pair)
    _, _, number = _summed((lang[at] * n_words + code[at]), weight[at])
    _, _, number = _summed(number * n_words + code[at + 1], weight[at])
    for size in range(3, LONGEST + 1):
        longer = pair[at + size - 2]  # false at a piece's last word
        at, number = at[longer], number[longer]
        first, f, number = _summed(number * n_words + code[at + size - 1], weight[at])
        yield shown(size, at[first], f)


def _make(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """N-grams of all pieces of a task, slice by slice."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        for part in slices(pa.Table.from_batches(held).combine_chunks().to_batches()[0], 1, SLICE_BYTES):
            yield from (out for out in grams(part, bits) if len(out))

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size >= SLICE_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of one bucket's n-grams, out of core; words of groups whatever their number, phrases from ``least`` on."""
    import duckdb

    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
    with tempfile.TemporaryDirectory(prefix="bucket-") as spilled:
        with duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": spilled, "preserve_insertion_order": False}) as duck:
            duck.execute("SET arrow_large_buffer_size = false")
            rows = duck.from_arrow(pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches)))  # noqa: F841
            found = duck.sql(f"SELECT lang, size, phrase, sum(f)::BIGINT AS f FROM rows GROUP BY ALL HAVING sum(f) >= {int(least)} OR size = 0")
            yield from found.to_arrow_reader(10_000)
    pa.default_memory_pool().release_unused()


def phrase_counts(distinct: DataFrame, least: int, bits: np.ndarray | None = None) -> DataFrame:
    """``(lang, size, phrase, f)`` of phrases that stand ``least`` times or more in weighted pieces: up to two words, or beyond with a filter of pairs."""
    spark = distinct.sparkSession
    bound_batches(spark, rows=10_000)
    shared = spark.sparkContext.broadcast(bits)
    made = distinct.mapInArrow(lambda batches: _make(batches, shared.value), GRAMS)
    return made.repartition("lang", "phrase").mapInArrow(lambda batches: _count(batches, least), GRAMS)


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, n, score`` of every candidate among written counts: its worst cut, the first of equals."""
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    candidates = counts.where("size >= 2").withColumnRenamed("f", "a")
    totals = sized(cut(counts.where("size = 0").select("lang", F.col("f").alias("n")), "totals"))
    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    parts = candidates.select("lang", "phrase", "a", "size", cuts)
    parts = parts.select("lang", "phrase", "a", "size", "k", F.posexplode(F.array(joined(1, F.col("k")), joined(F.col("k") + 1, F.col("size") - F.col("k")))).alias("side", "part"))
    known = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), "f")
    answers = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "size").agg(F.sort_array(F.collect_list(F.struct("k", "side", "f"))).alias("found"))
    wide = lambda c: c.cast("decimal(19,0)")
    answers = answers.join(totals, "lang").withColumn("top", wide(F.col("a") * 1000) * wide(F.col("n")))

    def of(k):
        left, right = (F.col("found")[2 * (k - 1) + i]["f"] for i in (0, 1))
        return F.struct(F.call_function("div", F.col("top"), wide(left) * wide(right)).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    worst = F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), of)).alias("worst")
    return answers.select("lang", "phrase", "size", "a", "n", worst).select("lang", "phrase", "size", "a", "worst.l", "worst.r", "n", "worst.score")


def covered(counts: DataFrame, share: int = 100) -> DataFrame:
    """``(lang, phrase)`` of candidates whose words lie inside a longer candidate that has ``share`` per cent of their count."""
    words, size = F.split("phrase", " "), F.col("size")
    starts = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), starts))
    longer = counts.where("size >= 3").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    own = counts.where("size >= 2").select("lang", "phrase", F.col("f").alias("a"))
    return own.join(longer, ["lang", "phrase"]).where(F.lit(100) * F.col("most") >= F.lit(share) * F.col("a")).select("lang", "phrase")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each group, numbered from one: hashed parts of a group first, then what they leave."""
    from pyspark.sql import Window as W

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return first.drop("part").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, share: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each group's best phrases of two to five words."""
    distinct = cut(pieces(docs, text_col, lang_col), "pieces")
    short = cut(phrase_counts(distinct, least), "short")
    bits = pair_filter(short.where("size = 2"))
    long = cut(phrase_counts(distinct, least, bits), "long")
    counts = short.unionByName(long)
    kept = scored(counts).join(covered(counts, share), ["lang", "phrase"], "left_anti")
    best = ranked(kept, most)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
