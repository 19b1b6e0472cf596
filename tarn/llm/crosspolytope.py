"""Cross-polytope hashing after fast Hadamard rotations, for near-duplicates and nearest neighbours.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; the hash of a unit vector is
the nearest signed axis. Multiprobe ranks the other axes by how near they come. Seeds are fixed, so every
task draws the same rotations.

Vectors that are null, empty, zero, of another length than the most, or that hold null or non-finite
components take no part, nor do rows without an id. Components are read in double precision. An empty
table gives an empty result; only the id and the vector are read, so other columns may bear any name.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.components import connected_components
from tarn.llm.arrow import named
from tarn.plans.scratch import cut, sized

#: Stored vectors of a bucket that one task holds at once; larger buckets are dealt to several tasks.
SLICE = 1024
#: Asking rows that are compared with a slice at once: no more pairs than ``TILE * SLICE`` exist at a time.
TILE = 64
#: Rows whose buckets a task remembers while it tells where pairs meet first.
REMEMBERED = 1 << 15
#: Stored rows a bucket should hold on average; more rows get more rotations a table.
FILL = 4
ROUNDS = 3
#: Candidate buckets that are ranked at once, 32 bytes each.
PROBED = 1 << 21
#: Queries that one exact scan answers.
SCANNED = 1024
#: Bucket sizes are broadcast only where the number of possible buckets is below this.
BROADCAST_ROWS = 1 << 18


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x


class CrossPolytope:
    """``tables`` hashes, each of ``parts`` rotations; a bucket is the parts' axes as one number."""

    def __init__(self, dim: int, tables: int, parts: int, probes: int, seed: int = 20):
        self.width = 1 << max(0, (dim - 1).bit_length())
        self.tables, self.parts, self.probes, self.dim = tables, parts, probes, dim
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, parts, ROUNDS, self.width))

    def scores(self, unit: np.ndarray, table: int, part: int) -> np.ndarray:
        """Closeness to each signed axis: columns below ``width`` are positive axes, the others negative."""
        x = np.zeros((len(unit), self.width))
        x[:, : self.dim] = unit
        for signs in self.signs[table, part]:
            x = hadamard(x * signs) / np.sqrt(self.width)
        return np.concatenate([x, -x], 1)

    def buckets(self, unit: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """Nearest buckets of each row, its home first, then probes by the closeness they lose.

        Rotations are merged one by one. Of two lists in the order of their losses, the pair of the i-th and the j-th entry comes
        after at least ``i * j`` others, so only pairs with ``i * j`` up to ``probes`` are looked at: some ``probes * ln(axes)`` of them a row.
        """
        probes = probes or self.probes
        rows = max(1, PROBED // (probes * (1 + int(math.log(2 * self.width)))))
        return np.concatenate([self._merged(unit[lo : lo + rows], table, probes) for lo in range(0, max(1, len(unit)), rows)])

    def _merged(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        axes, loss = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for part in range(self.parts):
            s = self.scores(unit, table, part)
            best = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            lost = s.max(1, keepdims=True) - np.take_along_axis(s, best, 1)
            i, j = _leading(axes.shape[1], best.shape[1], probes)
            both = loss[:, i] + lost[:, j]
            order = np.argsort(both, axis=1, kind="stable")[:, :probes]
            loss = np.take_along_axis(both, order, 1)
            axes = np.take_along_axis(axes, i[order], 1) * (2 * self.width) + np.take_along_axis(best, j[order], 1)
        return axes

    def homes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The nearest bucket alone."""
        bucket = np.zeros(len(unit), np.int64)
        for part in range(self.parts):
            bucket = bucket * (2 * self.width) + self.scores(unit, table, part).argmax(1)
        return bucket

    def needed(self, asking: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """How many probes a table the unit vector ``asking[i]`` needs to reach the home of ``stored[i]`` in some table."""
        out = np.full(len(asking), np.iinfo(np.int64).max)
        for table in range(self.tables):
            lost, at = [], 0.0
            for part in range(self.parts):
                s = self.scores(asking, table, part)
                home = self.scores(stored, table, part).argmax(1)
                lost.append(s.max(1, keepdims=True) - s)
                at = at + np.take_along_axis(lost[-1], home[:, None], 1)[:, 0]
            for i in range(len(asking)):
                out[i] = min(out[i], 1 + _below([x[i] for x in lost], at[i]))
        return out


@functools.lru_cache(64)
def _leading(n: int, m: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, in the order of the first, that may be among the ``probes`` least sums of two ascending lists."""
    each = np.minimum(m, np.maximum(1, probes // np.arange(1, n + 1)))
    each[np.arange(n) >= probes] = 0
    i = np.repeat(np.arange(n), each)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)


def _below(lost: list[np.ndarray], bound: float) -> int:
    """How many sums of one entry of each array lie below ``bound``, rounding aside."""
    cut_at = (len(lost) + 1) // 2
    halves = [functools.reduce(lambda x, y: (x[:, None] + y[None]).ravel(), part, np.zeros(1)) for part in (lost[:cut_at], lost[cut_at:])]
    return int(np.searchsorted(np.sort(halves[0]), bound - 1e-12 - halves[1]).sum())


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim).astype(np.float64)


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector takes part, lengths aside."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, str, int]:
    """``(id, vector array<double>)`` of the rows that take part, their length, how a component packs without loss, and how many."""
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim, n = (lengths["dim"], lengths["count"]) if lengths else (1, 0)
    return rows.where(F.size("vector") == dim), dim, kind, n


def _arrays(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pieces(batches, rows: int = 2048):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _cells(batches, keys: list[str], held: int, columns):
    """Stream rows sorted by ``keys`` and role: ``(key, stored, asking)``, both tuples of arrays, the asking rows in pieces.

    ``columns`` makes arrays of a batch. Stored rows (role 0) of a cell come first and are gathered; they are the same
    object for the whole cell, given first without asking rows, then with each piece of at most ``held`` of them.
    """
    key, gathered, whole = None, [], None

    def joined():
        return gathered[0] if len(gathered) == 1 else tuple(map(np.concatenate, zip(*gathered)))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy() for k in [*keys, "role"]], 1)
        arrays = columns(batch)
        starts = np.flatnonzero(np.r_[True, (cols[1:] != cols[:-1]).any(1)])
        for lo, hi, now in zip(starts.tolist(), [*starts[1:].tolist(), len(cols)], map(tuple, cols[starts].tolist())):
            if now[:-1] != key:
                if gathered:
                    yield key, joined(), None
                key, gathered, whole = now[:-1], [], None
            if now[-1] == 0:
                gathered.append(tuple(x[lo:hi] for x in arrays))
                continue
            if gathered:
                whole, gathered = joined(), []
                yield key, whole, None
            if whole is not None:
                for at in range(lo, hi, held):
                    yield key, whole, tuple(x[at : min(hi, at + held)] for x in arrays)
    if gathered:
        yield key, joined(), None


def _cell_sizes(dealt: DataFrame, hashes: CrossPolytope, cells: int) -> DataFrame:
    """``(t, cell, slices)`` of the cells that hold stored rows; broadcast where there cannot be many."""
    home = F.sum((F.col("role") == 0).cast("long"))
    sizes = dealt.groupBy("t", "cell").agg(home.alias("home"), F.count("*").alias("there"))
    sizes = sizes.where("home > 0").select("t", "cell", "there", F.ceil(F.col("home") / SLICE).cast("int").alias("slices"))
    return F.broadcast(sizes) if hashes.tables * cells <= BROADCAST_ROWS else sizes


# --- nearest neighbours ---------------------------------------------------------------------------


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    tables: int = 10,
    probes: int | None = None,
    recall: float = 0.96,
    sample: int = 128,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by Euclidean distance of each query row found.

    ``queries`` is a condition on ``id``, the rows that ask; every row is indexed in its home bucket of every
    table, and a query visits its ``probes`` nearest buckets a table. A bucket is an axis of each of so many
    rotations that about ``FILL`` rows share one, so buckets multiply with the rows. Where ``probes`` is not
    given, an exact scan for ``sample`` queries (hashed ids first) tells how many reach the share ``recall`` of their neighbours:
    few in clustered data, many where neighbours are hardly nearer than other rows.

    Distances are exact, on the original vectors; a row whose id equals the query's is not its neighbour; ties
    go to the smaller id. Repeated rows of an id count once, at their nearest. A query that finds fewer than
    ``k`` other ids, while the table has more, is answered by an exact scan of all rows, ``SCANNED`` at a time.
    """
    rows, dim, kind, n = prepared(vectors, id_col, vector_col)
    rows = cut(rows.dropDuplicates(["id", "vector"]).withColumn("asks", F.coalesce(queries, F.lit(False))), "vectors")
    axes = 2 << max(0, (dim - 1).bit_length())
    parts = max(1, math.ceil(math.log(max(n / FILL, 2)) / math.log(axes)))
    hashes = CrossPolytope(dim, tables, parts, 1)
    hashes.probes = min(axes**parts, probes or _probes(rows, hashes, k, dim, recall, sample))
    names = ["t", "cell", "role", "id", "raw", "fine"]

    def deal(batches):
        for batch in _pieces(batches):
            x = _arrays(batch, 1, dim)
            ids, asks = batch.column(0).to_numpy(), np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            raw, unit = _packed(x, kind), _unit(x)
            for t in range(tables):
                home = hashes.homes(unit, t)
                own = [np.full(len(x), t), home // axes, np.zeros(len(x), int), ids]
                yield pa.RecordBatch.from_arrays([*map(pa.array, own), raw, _packed(home % axes, "<i4")], names)
                for lo in range(0, len(asks), TILE):
                    who = asks[lo : lo + TILE]
                    found = np.sort(hashes.buckets(unit[who], t), 1)
                    # a query goes once to a cell, with the buckets that it visits there
                    at, first = np.divmod(np.arange(found.size), found.shape[1])
                    cell, fine = np.divmod(found.ravel(), axes)
                    begins = np.flatnonzero((first == 0) | np.r_[True, cell[1:] != cell[:-1]])
                    visits = pa.array([f.astype("<i4").tobytes() for f in np.split(fine, begins[1:])], pa.binary())
                    visit = [np.full(len(begins), t), cell[begins], np.ones(len(begins), int), ids[who][at[begins]]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, visit), raw.take(pa.array(who[at[begins]])), visits], names)

    dealt = cut(rows.select("id", "vector", "asks").mapInArrow(deal, "t long, cell long, role long, id long, raw binary, fine binary"), "buckets")
    own = F.pmod(F.xxhash64("id", "raw", F.lit(3)), F.col("slices")).cast("int")
    met = dealt.join(_cell_sizes(dealt, hashes, axes ** (parts - 1)), ["t", "cell"]).withColumn("own", own)
    slices = F.when(F.col("role") == 1, F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("own"))
    placed = met.select(*names, F.explode(slices).alias("slice"))
    keys = ["t", "cell", "slice"]

    def columns(batch):
        fine = np.empty(batch.num_rows, object)
        fine[:] = batch.column("fine").to_pylist()
        return _matrix(batch.column("raw"), dim, kind), batch.column("id").to_numpy(), fine

    def search(batches):
        last = None
        for _, stored, asking in _cells(batches, keys, TILE, columns):
            if asking is None:
                continue
            if stored is not last:
                last, (x, ids, homes) = stored, stored
                fine = np.frombuffer(b"".join(homes.tolist()), "<i4")
            q, of, visits = asking
            visits = [np.frombuffer(b, "<i4") for b in visits]
            open_ = np.zeros((len(visits), axes), bool)
            open_[np.repeat(np.arange(len(visits)), [len(v) for v in visits]), np.concatenate(visits)] = True
            a, b = np.nonzero(open_[:, fine])
            if len(a):
                yield _best(q, of, x, ids, a, b, k)

    found = placed.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(search, "query_id long, vec_id long, score double")
    top = cut(_ranked(found, k), "found")
    least = min(k, rows.agg(F.count_distinct("id")).first()[0] - 1)
    whole = top.where(F.col("rank") == least).select(F.col("query_id").alias("id"))
    if least < 1:
        return top
    short = rows.where("asks").join(whole, "id", "left_anti").select("id", "vector")
    blocks = math.ceil(short.count() / SCANNED)
    if not blocks:
        return top
    short = cut(short.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks))), "short")
    scans = []
    for block in range(blocks):
        held = short.where(F.col("block") == block).select("id", "vector").toArrow()  # some SCANNED queries
        if held.num_rows:
            q = held.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            scans.append(cut(_scan(rows, q, held.column("id").to_numpy(), k, dim), "scanned"))
    exact = _ranked(functools.reduce(DataFrame.unionByName, scans), k)
    return top.join(exact.select("query_id").distinct(), "query_id", "left_anti").select(*top.columns).unionByName(exact)


def _probes(rows: DataFrame, hashes: CrossPolytope, k: int, dim: int, recall: float, sample: int) -> int:
    """Probes a table that reach ``recall`` of the true neighbours of a bounded sample of queries."""
    asked = rows.where("asks").orderBy(F.xxhash64("id", F.lit(9)), "id", "vector").limit(sample).select("id", "vector").collect()
    if not asked:
        return 1
    q, of = np.array([r["vector"] for r in asked]), np.array([r["id"] for r in asked])
    true = _ranked(_scan(rows, q, of, k, dim), k).select(F.col("vec_id").alias("id"), "query_id")
    # at most ``sample * k`` pairs
    pairs = rows.join(F.broadcast(true), "id").groupBy("query_id", "id").agg(F.min("vector").alias("vector")).collect()
    if not pairs:
        return 1
    where = {i: n for n, i in enumerate(of.tolist())}
    asking = _unit(q)[[where[r["query_id"]] for r in pairs]]
    need = np.sort(hashes.needed(asking, _unit(np.array([r["vector"] for r in pairs]))))
    return int(need[math.ceil(recall * len(need)) - 1])


def _best(q: np.ndarray, of: np.ndarray, x: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> pa.RecordBatch:
    """Of the pairs (query ``a``, stored row ``b``) the ``k`` nearest ids of each query, each id at its nearest row."""
    d = np.concatenate([np.sqrt(((q[a[lo : lo + 65536]] - x[b[lo : lo + 65536]]) ** 2).sum(1)) for lo in range(0, len(a), 65536)])
    keep = of[a] != ids[b]
    a, vec, d = a[keep], ids[b[keep]], d[keep]
    order = np.lexsort((d, vec, a))
    a, vec, d = a[order], vec[order], d[order]
    once = np.r_[True, (a[1:] != a[:-1]) | (vec[1:] != vec[:-1])][: len(a)]
    a, vec, d = a[once], vec[once], d[once]
    order = np.lexsort((vec, d, a))
    a, vec, d = a[order], vec[order], d[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    a, vec, d = a[rank < k], vec[rank < k], d[rank < k]
    return pa.RecordBatch.from_arrays([pa.array(of[a]), pa.array(vec), pa.array(d)], ["query_id", "vec_id", "score"])


def _scan(rows: DataFrame, q: np.ndarray, of: np.ndarray, k: int, dim: int) -> DataFrame:
    """The ``k`` nearest of a block of queries in every piece of all rows."""

    def run(batches):
        for piece in _pieces(batches, SLICE):
            x, ids = _arrays(piece, 1, dim), piece.column(0).to_numpy()
            for lo in range(0, len(q), TILE):
                a, b = np.divmod(np.arange(len(q[lo : lo + TILE]) * len(x)), len(x))
                yield _best(q[lo : lo + TILE], of[lo : lo + TILE], x, ids, a, b, k)

    return rows.select("id", "vector").mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- near-duplicates ------------------------------------------------------------------------------


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.9,
    tables: int = 10,
    probes: int = 6,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per input row.

    Equal vectors are one class. Each class is stored in its home bucket of two rotations a table and
    asks in its ``probes`` nearest buckets; pairs that meet are verified by cosine in double precision. A
    pair counts only at the first place where it meets, which both vectors' buckets tell, so links are
    counted whole without sending pairs on; components travel as spanning links. However alike the vectors of
    a bucket are, a task holds the pairs of one tile at a time, as places in its slice. Rows that take no part
    have no links and are their own component; a row without an id has neither component nor mark.
    """
    rows, dim, kind, _ = prepared(vectors, id_col, vector_col)
    classes = rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    hashes = CrossPolytope(dim, tables, 2, probes)
    names = ["t", "cell", "role", "class", "n", "raw"]

    def deal(batches):
        for batch in _pieces(batches):
            x = _arrays(batch, 2, dim)
            raw, unit = _packed(x, kind), _unit(x)
            for t in range(tables):
                found = hashes.buckets(unit, t)
                at = np.repeat(np.arange(len(x)), found.shape[1])
                role = np.tile(np.minimum(np.arange(found.shape[1]), 1), len(x))
                own = (c.take(pa.array(at)) for c in (batch.column(0), batch.column(1), raw))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(found.ravel()), pa.array(role), *own], names)

    dealt = cut(classes.select("class", "n", "vector").mapInArrow(deal, "t long, cell long, role long, class long, n long, raw binary"), "buckets")
    sizes = _cell_sizes(dealt, hashes, (2 * hashes.width) ** 2).where("there > 1")
    own = F.pmod(F.xxhash64("class", F.lit(3)), F.col("slices")).cast("int")
    asks = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(s.alias("slice"), F.lit(1).cast("long").alias("role")))
    stays = F.transform(F.sequence(F.lit(0), F.col("own")), lambda s: F.struct(s.alias("slice"), (s < F.col("own")).cast("long").alias("role")))
    met = dealt.join(sizes, ["t", "cell"]).withColumn("own", own).withColumn("at", F.explode(F.when(F.col("role") == 1, asks).otherwise(stays)))
    placed = met.select("t", "cell", F.col("at.slice").cast("long").alias("slice"), F.col("at.role").alias("role"), "class", "n", "raw")
    keys = ["t", "cell", "slice"]

    def columns(batch):
        return _unit(_matrix(batch.column("raw"), dim, kind)), batch.column("class").to_numpy(), batch.column("n").to_numpy()

    def link(batches):
        covers = Covers(hashes)
        for (t, cell, _), stored, asking in _cells(batches, keys, SLICE, columns):
            found = _linked(t, cell, stored, stored if asking is None else asking, covers, least)
            if found is not None:
                yield found

    found = placed.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(link, "class long, links long, root long")
    found = cut(found, "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("class").alias("src"), F.col("root").alias("dst")))
    numbered = classes.join(groups, F.col("class") == F.col("vertex"), "left").withColumn("component", F.coalesce("component", "class"))
    numbered = cut(numbered.select("class", "vector", "id", "n", "component"), "numbered")
    # as a table of known size: broadcast, or joined in a way that splits a component of very many classes
    roots = sized(cut(numbered.groupBy("component").agg(F.min("id").alias("root")), "roots"))
    labelled = (
        numbered.join(roots, "component")
        .join(links, "class", "left")
        .select("vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "root")
    )
    every = vectors.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).cast("array<double>").alias("vector"))
    part = F.col("vec_id").isNotNull() & usable(F.col("vector")) & (F.size("vector") == dim)
    # rows that take no part would all meet under one key
    apart = every.where(~part).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("root"))
    joined = every.where(part).join(labelled, "vector").select("vec_id", "links", "root").unionByName(apart)
    return joined.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("root").alias("component_id"), (F.col("vec_id") == F.col("root")).alias("kept"))


class Covers:
    """Buckets of rows in every table, each row's home first; the last ``REMEMBERED`` rows are kept."""

    def __init__(self, hashes: CrossPolytope):
        self.hashes, self.known = hashes, {}

    def __call__(self, unit: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """``(rows, tables, probes)`` of rows and their ids."""
        new = [i for i, own in enumerate(ids.tolist()) if own not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(range(len(ids)))
        if new:
            found = np.stack([self.hashes.buckets(unit[new], t) for t in range(self.hashes.tables)], 1)
            self.known.update(zip(ids[new].tolist(), found))
        return np.stack([self.known[i] for i in ids.tolist()])


def _linked(t: int, cell: int, there: tuple, here: tuple, covers: Covers, least: float) -> pa.RecordBatch | None:
    """Links between two slices' rows (unit vectors, classes, how many rows a class stands for) that meet first in this
    cell: each row's sum, and a root that it hangs on. ``here is there`` asks for the links within a slice."""
    (x, x_ids, x_n), (z, z_ids, z_n) = there, here
    same, size, links = there is here, len(x_ids), None
    for lo in range(0, len(z_ids), TILE):
        y = z[lo : lo + TILE]
        s = y @ x.T
        if not same and s.max() < least - 1e-9 or size < 2 and same:
            continue
        a, b = np.nonzero(s >= least - 1e-9)
        sure = s[a, b] >= least + 1e-9
        close = np.flatnonzero(~sure)  # products of matrices round by their shapes; sums of rows do not
        sure[close] = (y[a[close]] * x[b[close]]).sum(1) >= least
        a, b = a[sure] + lo, b[sure]
        if same:
            a, b = a[b < a], b[b < a]
        if not len(a):
            continue
        if links is None:
            ids = x_ids if same else np.concatenate([x_ids, z_ids])
            links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        new = _meet_first(t, cell, z_ids[a] < x_ids[b], covers(z[ua], z_ids[ua]), ia, covers(x[ub], x_ids[ub]), ib)
        a, b = a[new], b[new]
        u = a if same else a + size
        np.add.at(links, u, x_n[b])
        np.add.at(links, b, z_n[a])
        while True:
            low = np.minimum(label[u], label[b])
            if np.array_equal(low, label[u]) and np.array_equal(low, label[b]):
                break
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[b], low)
            while not np.array_equal(label, up := label[label]):
                label = up
    some = np.flatnonzero(links) if links is not None else ()
    if len(some):
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[label[some]])], ["class", "links", "root"])


def _meet_first(t: int, cell: int, less: np.ndarray, ca: np.ndarray, ia: np.ndarray, cb: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Whether no earlier place has each pair: tables in turn, in each the home of the smaller class first (``less``: that of a)."""
    new, open_ = np.zeros(len(less), bool), np.ones(len(less), bool)
    for table in range(t + 1):
        a, b = ca[ia, table], cb[ib, table]
        home_a, home_b = (b == a[:, :1]).any(1), (a == b[:, :1]).any(1)
        first = np.where(np.where(less, home_a, ~home_b), a[:, 0], b[:, 0])
        meets = home_a | home_b
        if table == t:
            return open_ & meets & (first == cell)
        open_ &= ~meets
    return new
