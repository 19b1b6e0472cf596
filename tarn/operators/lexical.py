"""Lexical search: a standing inverted index, BM25 top-k for many queries at once, and small lookups.

BM25 is Robertson and Zaragoza's, k1 = 1.2 and b = 0.75, with an idf floor; scores are rounded so that ties
are ties in every engine. A document has named fields; a search weighs their counts, or looks at one field alone.

Documents are dealt to segments, bounded in documents and text, by the hashes of their ids and numbered in a segment by their length. A row of the index is a
term's list in a segment: where it stands and how often, and for every block of documents (``BLOCK``) the most that it occurs in each
field. Files are bucketed by segment and sorted by term, so a search reads the rows of its own terms and a segment's rows
meet in one task without a shuffle. There the blocks of a query are taken in the order of what they can score at most, and
those that cannot reach the k-th score are never opened. Documents of a block are of like length, so that bound is close. Only ``k``
rows a query and segment travel.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.text import query_tokens, query_tokens_stop, tokens
from tarn.functions.topk import top
from tarn.plans.batches import bound_batches
from tarn.plans.scratch import cut, scratch_path

K1, B, IDF_FLOOR, DIGITS = 1.2, 0.75, 1e-6, 6
#: Distinct (query, term) pairs of a block of queries; a block is what is broadcast.
BLOCK_TERMS = 1 << 18
#: Documents of a block and of a segment at most, and of a segment at least where there are many cores to use.
BLOCK, SEGMENT, LEAST_SEGMENT = 32, 1 << 13, 1 << 10
#: Bytes of text of a segment, about, where documents are long; counts of terms that are inverted at once; counts that a search keeps weighed.
TEXT, SLICE, WEIGHED = 32 << 20, 1 << 18, 1 << 20
#: Blocks of each segment that are opened first, for the score that all others have to reach, where there are more than ``FEW`` segments.
FIRST, FEW = 2, 32
#: Terms of a query from which on its blocks cannot be told apart by bounds, so that all are opened at once.
LONG = 8
#: Distinct terms up to which they go to the scan as literals, which leaves out parts of files.
LITERALS = 256
#: Files of an index at most.
BUCKETS = 4096
ROW = (
    "seg int, h long, dfs array<int>, places array<int>, fields array<tinyint>, tfs array<int>, "
    "blocks array<int>, block_fields array<tinyint>, tops array<int>, docs array<long>, lengths array<int>"
)


def postings(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """``(term, doc_id, tf)``."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(text)).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """``(doc_id, dl)``: tokens of each document; those without any count zero."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(tokens(text)).cast("long").alias("dl"))


def query_terms(queries: DataFrame, most: int | None = None, tokenise=query_tokens) -> DataFrame:
    """``(qid, term)``: the distinct tokens of each query, all of them unless ``most`` says otherwise."""
    t = tokenise(F.col("query"))
    return queries.select("qid", F.explode(F.slice(t, 1, most) if most else t).alias("term"))


@dataclass
class Index:
    """``rows`` of terms in segments, ``terms (h, df, dfs)``, and how many documents and tokens of each field there are."""

    rows: DataFrame
    terms: DataFrame
    fields: list[str]
    n: int
    tokens: list[int]
    segments: int
    block: int


def _numbers(spark: SparkSession, segments: int, buckets: int) -> list[int]:
    """Numbers of segments; where there are no more than files, such that each has a file of its own."""
    if segments > buckets:
        return list(range(segments))
    tried = spark.range(32 * buckets).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(buckets))).agg(F.min("id").alias("id")).collect()
    found = sorted(r["id"] for r in tried)  # one a file at most
    return found + [-1 - i for i in range(segments - len(found))]


def _forward(docs: DataFrame, doc_id: str, fields: Mapping[str, Column], tokenise, segments: list[int]) -> DataFrame:
    """``seg, doc_id, lengths, terms, fields, tfs``: distinct terms of each document and field, by their 64-bit hashes."""
    hashed = [F.coalesce(F.transform(tokenise(text), lambda t: F.xxhash64(t)), F.array().cast("array<bigint>")).alias(f"t{i}") for i, text in enumerate(fields.values())]
    nth = F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.lit(1)), F.lit(len(segments))).cast("int")
    seg = (nth if segments == list(range(len(segments))) else F.element_at(F.array(*map(F.lit, segments)), nth + 1)).cast("int").alias("seg")
    rows = docs.where(F.col(doc_id).isNotNull()).select(seg, F.col(doc_id).cast("long").alias("doc_id"), *hashed)
    width = len(hashed)

    def count(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes = np.stack([np.diff(part.column(2 + f).offsets.to_numpy()) for f in range(width)], 1)
                doc = np.concatenate([np.repeat(np.arange(len(sizes)), sizes[:, f]) for f in range(width)])
                term = np.concatenate([part.column(2 + f).flatten().to_numpy() for f in range(width)])
                field = np.repeat(np.arange(width, dtype=np.int8), sizes.sum(0))
                order = np.lexsort((field, term, doc))
                doc, term, field = doc[order], term[order], field[order]
                starts = _starts(doc, term, field)
                tf = np.diff(np.r_[starts, len(doc)]).astype(np.int32)
                ends = _ends(np.bincount(doc[starts], minlength=len(sizes)))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term[starts], field[starts], tf)]
                lengths = pa.ListArray.from_arrays(_ends(np.full(len(sizes), width)), pa.array(sizes.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lengths, *lists], ["seg", "doc_id", "lengths", "terms", "fields", "tfs"])

    return rows.mapInArrow(count, "seg int, doc_id long, lengths array<int>, terms array<long>, fields array<tinyint>, tfs array<int>")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())


def _invert(batches: Iterator[pa.RecordBatch], per_block: int) -> Iterator[pa.RecordBatch]:
    """The rows of one segment: one without a term that holds the documents in the order of their length, and a term each.

    Batches are held as counts in the order of their terms' hashes; ranges of hashes are inverted in turn, about ``SLICE`` counts at a time.
    """
    seg, ids, lengths, held = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
        seg, first = column("seg")[0].as_py(), sum(map(len, ids))
        ids.append(column("doc_id").to_numpy().copy())
        lengths.append(column("lengths").flatten().to_numpy().reshape(batch.num_rows, -1).copy())
        term = column("terms").flatten().to_numpy()
        order = np.argsort(term, kind="stable").astype(np.int32)
        doc = np.repeat(np.arange(first, first + batch.num_rows, dtype=np.int32), np.diff(column("terms").offsets.to_numpy()))
        held.append((term[order], doc[order], *(column(c).flatten().to_numpy()[order] for c in ("fields", "tfs"))))
        del batch, column, term, order, doc
    if seg is None:
        return
    ids, lengths = np.concatenate(ids), np.concatenate(lengths)
    order = np.lexsort((ids, lengths.sum(1)))
    place_of = np.empty(len(ids), np.int32)
    place_of[order] = np.arange(len(ids))
    names, width = [f.split(" ")[0] for f in ROW.split(", ")], lengths.shape[1]
    whole = _term_rows(seg, *(x[:0] for x in (held[0][0], place_of, *held[0][2:])), width, per_block)
    whole = [pa.array([v], r.type) for v, r in zip([seg, *[None] * 8, ids[order].tolist(), lengths[order].ravel().tolist()], whole, strict=True)]
    yield pa.RecordBatch.from_arrays(whole, names)
    slices = 1 << max(0, math.ceil(sum(len(h[0]) for h in held) / SLICE) - 1).bit_length()  # hashes spread evenly
    bounds = [-(1 << 63) + i * ((1 << 64) // slices) for i in range(1, slices)]
    cuts = [[0, *np.searchsorted(h[0], np.array(bounds, np.int64)), len(h[0])] for h in held]
    for i in range(slices):
        term, doc, field, tf = (np.concatenate([h[c][lo[i] : lo[i + 1]] for h, lo in zip(held, cuts, strict=True)]) for c in range(4))
        if len(term):
            yield pa.RecordBatch.from_arrays(_term_rows(seg, term, place_of[doc], field, tf, width, per_block), names)


def _term_rows(seg: int, term: np.ndarray, place: np.ndarray, field: np.ndarray, tf: np.ndarray, width: int, per_block: int) -> list[pa.Array]:
    """Columns of ``ROW``, a term each, of all counts of these terms in a segment."""
    order_p = np.lexsort((field, place, term))
    place, term, field, tf = place[order_p], term[order_p], field[order_p], tf[order_p]
    begins = _starts(term)
    number = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(term)]))
    once = _starts(term, place)
    dfs = np.zeros((len(begins), 1 + width), np.int32)
    dfs[:, 0] = np.bincount(number[once], minlength=len(begins))
    for f in range(width):
        dfs[:, 1 + f] = np.bincount(number[field == f], minlength=len(begins))
    block = place // per_block
    order_b = np.lexsort((field, block, number))
    tops_at = _starts(number[order_b], block[order_b], field[order_b])
    tops = np.maximum.reduceat(tf[order_b], tops_at) if len(tops_at) else tf
    owner = number[order_b][tops_at]
    # a short list tells by itself what its blocks hold at most
    kept = (2 * np.bincount(owner, minlength=len(begins)) <= np.bincount(number, minlength=len(begins)))[owner]
    top_ends = _ends(np.bincount(owner[kept], minlength=len(begins)))
    own_ends = pa.array(np.r_[begins, len(term)], pa.int32())
    lists = lambda ends, *values: [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]
    none = [pa.nulls(len(begins), pa.list_(pa.int64())), pa.nulls(len(begins), pa.list_(pa.int32()))]
    return [
        pa.array(np.full(len(begins), seg, np.int32)), pa.array(term[begins]), *lists(_ends(np.full(len(begins), 1 + width)), dfs.ravel()),
        *lists(own_ends, place, field, tf), *lists(top_ends, *(x[order_b][tops_at][kept].astype(t) for x, t in ((block, np.int32), (field, np.int8))), tops[kept]), *none,
    ]


def _segments(n: int, held: int, cores: int) -> int:
    """How many segments ``n`` documents of ``held`` bytes are dealt to."""
    each = min(SEGMENT, max(LEAST_SEGMENT, math.ceil(n / cores)))
    return max(1, math.ceil(n / each), min(n, math.ceil(held / TEXT)))


def write_index(docs: DataFrame, path: str, doc_id: str = "id", fields: Mapping[str, Column] | None = None, tokenise=tokens, block: int = BLOCK) -> None:
    """Build an index of ``docs`` below ``path``: one scan of the texts, one shuffle of counted terms by segment."""
    spark = docs.sparkSession
    bound_batches(spark)
    fields = fields or {"content": F.col("content")}
    size = functools.reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") for text in fields.values()))
    n, held = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    segments = _segments(n, held, spark.sparkContext.defaultParallelism)
    buckets = min(segments, BUCKETS)
    forward = _forward(docs, doc_id, fields, tokenise, _numbers(spark, segments, buckets))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _invert(batches, block)

    rows = forward.repartition(buckets, "seg").groupBy("seg").applyInArrow(invert, ROW)
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows.write.bucketBy(buckets, "seg").sortBy("seg", "h").option("path", f"{path}/rows").option("parquet.block.size", 8 << 20).saveAsTable(name)
    built = spark.table(name)
    width = len(fields)
    sums = [F.sum(F.col("dfs")[i]).cast("long").alias(f"d{i}") for i in range(width + 1)]
    terms = built.where("h is not null").groupBy("h").agg(*sums)
    terms.select("h", F.col("d0").alias("df"), F.array(*(f"d{i + 1}" for i in range(width))).alias("dfs")).write.parquet(f"{path}/terms")
    of_field = lambda f: F.filter("lengths", lambda x, i: i % width == f)
    tokens_of = [F.sum(F.aggregate(of_field(f), F.lit(0).cast("long"), lambda a, x: a + x)) for f in range(width)]
    stats = built.where("h is null").agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).cast("long").alias("n"), F.array(*(F.coalesce(t, F.lit(0)) for t in tokens_of)).cast("array<bigint>").alias("tokens"))
    named = F.array(*map(F.lit, fields)).alias("fields")
    stats.select("n", "tokens", named, F.lit(segments).alias("segments"), F.lit(block).alias("block"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/stats")
    spark.sql(f"DROP TABLE {name}")  # its files stay


def _table_name(path: str) -> str:
    return "tarn_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def read_index(spark: SparkSession, path: str) -> Index:
    """The index below ``path``. Its rows are declared as a bucketed table of this session, so that a segment is read by one task."""
    s = spark.read.parquet(f"{path}/stats").first()
    name = _table_name(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ROW}) USING parquet CLUSTERED BY (seg) SORTED BY (seg, h) INTO {s['buckets']} BUCKETS LOCATION '{path}/rows'")
    spark.catalog.refreshTable(name)
    return Index(spark.table(name), spark.read.parquet(f"{path}/terms"), s["fields"], s["n"], s["tokens"], s["segments"], s["block"])


def build_index(docs: DataFrame, doc_id: str = "id", fields: Mapping[str, Column] | None = None, tokenise=tokens, block: int = BLOCK) -> Index:
    """An index for this application alone."""
    path = scratch_path(docs.sparkSession, "index")
    write_index(docs, path, doc_id, fields, tokenise, block)
    return read_index(docs.sparkSession, path)


@dataclass
class _Scoring:
    """What a search takes from the index: weights of the fields, or one field alone with its own lengths and frequencies."""

    weights: np.ndarray
    alone: int | None
    avgdl: float
    k: int
    block: int


def _scoring(index: Index, k: int, weights: Mapping[str, float] | None, alone: str | None) -> _Scoring:
    w = np.array([float(f == alone) if alone else (weights or {}).get(f, 1.0 if not weights else 0.0) for f in index.fields])
    tokens_ = index.tokens[index.fields.index(alone)] if alone else sum(index.tokens)
    return _Scoring(w, index.fields.index(alone) if alone else None, tokens_ / index.n if index.n and tokens_ else 1.0, k, index.block)


class _Segment:
    """The rows of one segment that a block of queries asks for."""

    def __init__(self, rows: pa.Table, scoring: _Scoring):
        self.scoring, self.block, width = scoring, scoring.block, len(scoring.weights)
        column = lambda name: rows.column(name).combine_chunks()  # noqa: E731 - each list is copied once
        self.docs = column("docs").flatten().to_numpy()  # of the one row without a term
        lengths = column("lengths").flatten().to_numpy().reshape(-1, width)
        length = lengths.sum(1) if scoring.alone is None else lengths[:, scoring.alone]
        self.norm = K1 * (1 - B + B * length / scoring.avgdl)
        self.n_blocks = -(-len(self.docs) // self.block)
        self.least = np.minimum.reduceat(self.norm, np.arange(0, len(self.docs), self.block)) if len(self.docs) else self.norm
        known = np.flatnonzero(column("h").is_valid().to_numpy(zero_copy_only=False))
        h = column("h").fill_null(0).to_numpy()[known]
        order = np.argsort(h, kind="stable")
        self._order, self.h = known[order], h[order]
        self._ends, self._top_ends = column("places").offsets.to_numpy(), column("blocks").offsets.to_numpy()
        self._lists = [column(c).values.to_numpy() for c in ("places", "fields", "tfs")]
        self._tops = [column(c).values.to_numpy() for c in ("blocks", "block_fields", "tops")]
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._opened: dict[int, np.ndarray] = {}
        self._whole: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self._weighed = 0

    def _summed(self, at: np.ndarray, field: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted counts of places (or blocks) that come in order, fields put together; those of no weight are left out."""
        f = count * self.scoring.weights[field]
        if len(self.scoring.weights) > 1:
            starts = _starts(at)
            at, f = at[starts], np.add.reduceat(f, starts) if len(starts) else f
        some = f > 0
        return (at, f) if some.all() else (at[some], f[some])

    def bound(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of a term, and the most that it adds to a document there, before its idf."""
        if row not in self._bounds:
            lo, hi = self._top_ends[row : row + 2]
            if lo < hi:
                blocks, f = self._summed(*(x[lo:hi] for x in self._tops))
            else:
                places, f = self._summed(*(x[self._ends[row] : self._ends[row + 1]] for x in self._lists))
                starts = _starts(places // self.block)
                blocks, f = places[starts] // self.block, np.maximum.reduceat(f, starts) if len(starts) else f
            self._bounds[row] = blocks.astype(np.int32), f * (K1 + 1) / (f + self.least[blocks])
        return self._bounds[row]

    def scores(self, row: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a term in ascending ``blocks``, and what it adds to them before its idf."""
        if row not in self._opened:
            places = self._lists[0][self._ends[row] : self._ends[row + 1]]
            self._opened[row] = np.searchsorted(places, np.arange(self.n_blocks + 1) * self.block).astype(np.int32)
        cuts = self._opened[row] + self._ends[row]
        at = _ranges(cuts[blocks], cuts[blocks + 1])
        places, f = self._summed(*(x[at] for x in self._lists))
        return places, f * (K1 + 1) / (f + self.norm[places])

    def whole(self, row: int) -> tuple[np.ndarray, np.ndarray, int]:
        """All places of a term, what it adds to them before its idf, and how many blocks they are in."""
        if row not in self._whole:
            places, f = self._summed(*(x[self._ends[row] : self._ends[row + 1]] for x in self._lists))
            self._weighed += len(places)
            if self._weighed > WEIGHED:
                self._whole, self._weighed = {}, len(places)
            self._whole[row] = places, f * (K1 + 1) / (f + self.norm[places]), len(_starts(places // self.block))
        return self._whole[row]

    def _all(self, rows: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The best of all places of a long query."""
        found, k = [self.whole(row) for row, _ in rows], self.scoring.k
        total = np.bincount(np.concatenate([p for p, _, _ in found]), np.concatenate([weight * add for (_, add, _), (_, weight) in zip(found, rows, strict=True)]), len(self.docs))
        places = np.flatnonzero(total)
        values = np.round(total[places], DIGITS)
        if len(values) > k:
            near = values >= np.partition(values, len(values) - k)[len(values) - k]
            places, values = places[near], values[near]
        keep = np.lexsort((self.docs[places], -values))[:k]
        blocks = sum(n for _, _, n in found)
        return places[keep], values[keep], blocks, blocks

    def best(self, hashes: np.ndarray, idf: np.ndarray, least: float | None) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Places and scores of one query's best documents; how many of its terms' blocks there are and were opened.

        Without ``least`` only the ``FIRST`` blocks are opened that may hold the best; with it those that come after them and may reach it;
        if it is below zero all that may reach the best found here.
        """
        at = np.searchsorted(self.h, hashes)
        there = np.flatnonzero((at < len(self.h)) & (self.h[np.minimum(at, len(self.h) - 1)] == hashes)) if len(self.h) else at[:0]
        rows, k = [(int(self._order[at[i]]), idf[i]) for i in there], self.scoring.k
        if len(rows) >= LONG and least is not None and least < 0:
            return self._all(rows)
        most, terms_in = np.zeros(self.n_blocks), np.zeros(self.n_blocks, np.int64)
        for row, weight in rows:
            blocks, bound = self.bound(row)
            most[blocks] += weight * bound
            terms_in[blocks] += 1
        order = np.argsort(-most, kind="stable")[: np.count_nonzero(most)]
        places, values, opened, step = np.empty(0, np.int64), np.empty(0), 0, FIRST
        order, least = (order[:FIRST], 0.0) if least is None else (order if least < 0 else order[FIRST:], least)
        done = 0
        while done < len(order):
            chosen = order[done : done + step]
            chosen = np.sort(chosen[most[chosen] >= least - 10.0**-DIGITS])
            if not len(chosen):
                break
            done, step, opened = done + step, 2 * step, opened + int(terms_in[chosen].sum())
            total = np.zeros(len(chosen) * self.block)
            slot = np.zeros(self.n_blocks, np.int64)
            slot[chosen] = np.arange(len(chosen)) * self.block
            for row, weight in rows:
                found, add = self.scores(row, chosen)
                total += np.bincount(slot[found // self.block] + found % self.block, weight * add, len(total))
            hit = np.flatnonzero(total)
            places = np.concatenate([places, chosen[hit // self.block] * self.block + hit % self.block])
            values = np.concatenate([values, np.round(total[hit], DIGITS)])
            keep = np.lexsort((self.docs[places], -values))[:k]
            places, values = places[keep], values[keep]
            if len(values) == k:
                least = max(least, values[-1])
        return places, values, int(terms_in.sum()), opened


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    sizes = hi - lo
    return np.arange(sizes.sum()) + np.repeat(lo - np.cumsum(sizes) + sizes, sizes)


def _rated(terms: DataFrame, index: Index, scoring: _Scoring):
    """Blocks of whole queries: ``(qids, hash, query number, idf)`` of the terms that the index knows."""
    df = F.col("df") if scoring.alone is None else F.col("dfs")[scoring.alone]
    idf = F.greatest(F.log((index.n - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
    asked = cut(terms.select("qid", F.xxhash64("term").alias("h")), "asked")  # broadcast by its size as a written table, joined otherwise
    rated = index.terms.join(asked, "h").where(df > 0).select("qid", "h", idf.alias("idf"))
    rows = sorted(rated.collect()) if asked.count() <= BLOCK_TERMS else rated.orderBy("qid", "h").toLocalIterator(prefetchPartitions=True)
    return _blocks(rows)


def _search(block: tuple[np.ndarray, ...], index: Index, scoring: _Scoring, least: np.ndarray | None = None) -> DataFrame:
    """Every segment's best documents of each query of a block, with blocks of its terms there and opened."""
    spark, segments = index.rows.sparkSession, index.rows
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((*block, least))

    def run(rows: pa.Table) -> pa.Table:
        qids, h, number, idf, floor = sent.value
        segment, out = _Segment(rows, scoring), []
        ends = np.searchsorted(number, np.arange(len(qids) + 1))
        for q, (lo, hi) in enumerate(itertools.pairwise(ends)):
            places, values, there, opened = segment.best(h[lo:hi], idf[lo:hi], None if floor is None else floor[q])
            if there:
                out.append((np.full(len(places) + 1, qids[q]), np.r_[segment.docs[places], -1], np.r_[values, 0.0], np.r_[np.zeros(len(places), np.int64), there], np.r_[np.zeros(len(places), np.int64), opened]))
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, t) for t in (np.int64, np.int64, float, np.int64, np.int64)]
        return pa.table(dict(zip(("qid", "doc_id", "score", "there", "opened"), found, strict=True)))

    hashes = np.unique(block[1])
    if len(hashes) <= LITERALS:
        asked = segments.where(F.col("h").isNull() | F.col("h").isin(hashes.tolist()))
    else:  # at most BLOCK_TERMS hashes, or those of one query
        known = spark.createDataFrame(pa.table({"asked": pa.array([None, *hashes.tolist()], pa.int64())}))
        asked = segments.join(F.broadcast(known), F.col("h").eqNullSafe(F.col("asked")), "left_semi")
    return asked.groupBy("seg").applyInArrow(run, "qid long, doc_id long, score double, there long, opened long")


def _found(terms: DataFrame, index: Index, scoring: _Scoring) -> DataFrame | None:
    """Rows of ``_search`` over all blocks of queries: what each segment's likeliest blocks hold, then all that may reach their k-th score."""
    found = []
    for block in _rated(terms, index, scoring):
        if index.segments <= FEW:
            found.append(_search(block, index, scoring, np.full(len(block[0]), -1.0)))
            continue
        early = cut(_search(block, index, scoring), "early")
        kth = top(early.where("there = 0"), scoring.k, F.desc("score"), "doc_id").where(F.col("rank") == scoring.k - 1).select("qid", "score").toArrow()
        least = np.zeros(len(block[0]))
        least[np.searchsorted(block[0], kth.column("qid").to_numpy())] = kth.column("score").to_numpy()
        late = _search(block, index, scoring, least)
        found += [early, late]
    if len(found) > 2:  # written, a block of queries lets go of what it sent
        found = [cut(part, "found") for part in found]
    return functools.reduce(DataFrame.unionByName, found) if found else None


def bm25_topk(terms: DataFrame, index: Index, k: int, weights: Mapping[str, float] | None = None, alone: str | None = None) -> DataFrame:
    """``qid, doc_id, rank (from 0), score``: best ``k`` documents of each query, ties to the smaller id.

    ``terms (qid, term)`` holds distinct terms of each query. ``weights`` of fields multiply their counts (those not named have
    none); lengths and document frequencies are those of whole documents. ``alone`` searches one field as if there were no other. Blocks
    of queries, ``BLOCK_TERMS`` of their terms at a time, are sent to the index in turn; documents without any term of a query are none
    of its results.
    """
    found = _found(terms, index, _scoring(index, k, weights, alone))
    if found is None:
        found = terms.sparkSession.createDataFrame([], "qid long, doc_id long, score double, there long, opened long")
    return top(found.where("there = 0"), k, F.desc("score"), "doc_id").select("qid", "doc_id", "rank", "score")


def search_cost(terms: DataFrame, index: Index, k: int, weights: Mapping[str, float] | None = None, alone: str | None = None) -> DataFrame:
    """``qid, there, opened``: blocks of postings that a query's terms have, and those that its search opened."""
    found = _found(terms, index, _scoring(index, k, weights, alone))
    if found is None:
        return terms.sparkSession.createDataFrame([], "qid long, there long, opened long")
    searches = 1 if index.segments <= FEW else 2  # each counts the blocks that there are
    return found.where("there > 0").groupBy("qid").agg((F.sum("there") / searches).cast("long").alias("there"), F.sum("opened").alias("opened"))


def _blocks(rows):
    """Whole queries, about ``BLOCK_TERMS`` rows at a time: query ids, and of each term its hash, query number and idf."""
    held: list = []
    for _, query in itertools.groupby(rows, key=lambda r: r["qid"]):
        held += query
        if len(held) >= BLOCK_TERMS:
            yield _arrays(held)
            held = []
    if held:
        yield _arrays(held)


def _arrays(rows: list) -> tuple[np.ndarray, ...]:
    qids, number = np.unique(np.array([r["qid"] for r in rows]), return_inverse=True)
    h, idf = np.array([r["h"] for r in rows]), np.array([r["idf"] for r in rows])
    order = np.lexsort((h, number))
    return qids, h[order], number[order], idf[order]


def idf_top_tokens(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``qid, tokens``: of a query with more than ``k`` tokens the rarest ``k`` that the index knows, in query order.

    A query of fewer tokens keeps them all, and so does one none of whose tokens is known.
    """
    q = queries.select("qid", query_tokens_stop(F.col("query")).alias("ts")).select("qid", F.size("ts").alias("n"), F.posexplode("ts").alias("i", "term"))
    found = cut(q.withColumn("h", F.xxhash64("term")), "tokens").join(index.terms, "h", "left")
    rarity = F.round(F.log(F.lit(index.n + 1.0) / (F.col("df") + 1)), 9)
    over = W.partitionBy("qid")
    rated = found.withColumn("r", F.row_number().over(over.orderBy(F.desc_nulls_last(rarity), "i"))).withColumn("known", F.count("df").over(over))
    kept = rated.where((F.col("n") <= k) | (F.col("known") == 0) | (F.col("df").isNotNull() & (F.col("r") <= k)))
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]), " ").alias("tokens"))


def search_fts(queries: DataFrame, docs: DataFrame, index: Index, limit: int, decay: float = 1.0, alone: str | None = None) -> DataFrame:
    """Lexical search with snippets: ``qid, pos, id, slug, score, snippet``; under decay three times as many are fetched and re-picked."""
    from tarn.functions.text import match_snippet
    from tarn.operators.rank import slug_decay

    pool = bm25_topk(query_terms(queries), index, limit * 3 if decay < 1 else limit, alone=alone)
    rows = pool.join(docs.select(F.col("id").alias("doc_id"), "slug"), "doc_id")
    picked = slug_decay(rows, decay, limit) if decay < 1 else rows.withColumn("pos", F.col("rank"))
    shown = picked.join(docs.select(F.col("id").alias("doc_id"), "content"), "doc_id").join(queries, "qid")
    return shown.select("qid", "pos", "doc_id", "slug", F.round("score", 3).alias("score"), match_snippet(F.col("content"), F.col("query")).alias("snippet"))


def trigger_keys(text: Column) -> Column:
    """Distinct key words of a text by what they match with: their first five letters, or all four."""
    from tarn.functions.text import TRIGGER_STOPWORDS

    stop = F.array(*map(F.lit, TRIGGER_STOPWORDS))
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))
    return F.transform(words, lambda w: F.substring(w, 1, 5))


def trigger_accuracy(prompts: DataFrame, skills: DataFrame) -> DataFrame:
    """``skill, overlap, accuracy`` for ``prompts (prompt, item, text)`` that want the skill ``item``, and ``skills (skill, description)``.

    Prompts and skills meet by key words that match. Pairs that share none are not made: how many there are, and how many of
    them were wanted, follows from the counts.
    """
    asked = prompts.select("prompt", "item", F.explode(trigger_keys(F.col("text"))).alias("key")).groupBy("key", "prompt", "item").agg(F.count("*").alias("words"))
    held = skills.select("skill", F.explode(F.array_distinct(trigger_keys(F.col("description")))).alias("key"))
    met = asked.join(held, "key").groupBy("skill", "prompt", "item").agg(F.sum("words").alias("words"))
    right = F.sum((F.col("item") == F.col("skill")).cast("long")).alias("hit")
    found = met.groupBy("skill").agg(F.sum("words").alias("overlap"), F.count("*").alias("shared"), right)
    wanted = prompts.groupBy(F.col("item").alias("skill")).agg(F.count("*").alias("wanted"))
    n = prompts.agg(F.count("*").alias("n"))
    none = lambda c: F.coalesce(c, F.lit(0))
    rated = skills.select("skill").join(found, "skill", "left").join(wanted, "skill", "left").crossJoin(F.broadcast(n))  # one row
    # right are those that share and were wanted, and those that neither share nor were wanted
    good = F.col("n") - none(F.col("shared")) - none(F.col("wanted")) + 2 * none(F.col("hit"))
    return rated.select("skill", none(F.col("overlap")).alias("overlap"), F.round(good / F.col("n"), 9).alias("accuracy"))
