"""SimHash fingerprints, and near-duplicate groups found with BK-trees.

Every fingerprint stands in several tables of shards, so that any two that may link share a shard. A shard's
fingerprints form BK-trees whose children are keyed by their Hamming distance to the parent; a search follows
only edges within the radius of the distance at hand. A shard of more than ``cell`` fingerprints is cut into
slices of a tree each: a slice is searched where it is built, and its tree, as bytes of a proven bound, meets the
other slices of its shard, broadcast where all such trees together stay below ``TREES_BYTES`` (measured before),
by tiles of slices otherwise. What a search sends on is a spanning forest of the links it found, never all pairs.

``near_duplicates`` links fingerprints within ``radius`` bits. They agree on at least ``blocks - radius`` of
``blocks`` bit blocks (pigeonhole), and each choice of that many blocks is a table, so no link is lost.

``similar`` links texts by the Jaccard similarity of their shingle sets. Tables are keyed by pairs of least
permuted shingle hashes, which texts of similarity s share with odds s * s a table; fingerprints within a wide
radius make candidates, and every link is verified on the whole sets.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like
any other; a text with fewer words than a shingle is one shingle; a very long text is hashed in blocks;
repeated rows give repeated results; a null id takes part in its fingerprint's group and gets that group's
component, which is null only if the whole group has no id; columns other than the id and the text are not
read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.components import connected_components
from tarn.llm.arrow import bound_batches, map_texts, named
from tarn.plans.scratch import cut, sized

SEED = 42
#: Hashes whose bits are counted at once.
BLOCK = 1 << 17
#: Rows that a search task gathers before it builds a forest over them.
FOREST = 1 << 15
#: (query, node) pairs of one search front at most, unless a single cell needs more.
FRONT = 1 << 20
#: Trees of sliced shards are broadcast up to this size.
TREES_BYTES = 64 << 20
#: Slices of a row of tiles.
TILE = 8
#: Shingles that a slice of sets holds, unless a single text has more.
SET_SIZE = 1 << 20


def _hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in blocks."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    while len(h := np.fromiter(map(xxhash.xxh64_intdigest, itertools.islice(grams, BLOCK), itertools.repeat(SEED)), np.uint64)):
        yield h


def _majority(blocks) -> int:
    """A bit is set if it is set in over half the hashes."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in blocks:
        n += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the shingles' hashes."""
    return _majority(_hashes(text, shingle))


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashes(text, shingle)]))


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""

    def setup():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t or "", shingle) for t in batch.column(0).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return work

    return map_texts(docs, text_col, [named(id_col).cast("long").alias("doc_id")], "doc_id long, fp long", setup)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class BKForest:
    """One BK-tree for each root, in arrays; all trees are built and searched together."""

    def __init__(self, fps: np.ndarray, roots: np.ndarray):
        """``roots[i]``: index of the item that is the root of i's tree; a root names itself."""
        n = len(fps)
        self.fps = fps
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        at, left = roots.copy(), np.flatnonzero(roots != np.arange(n))
        while len(left):
            d = popcount(fps[left] ^ fps[at[left]])
            key = at[left] * 65 + d
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            child = left[first]  # ``left`` ascends, so this is each group's least item
            parent[child], edge[child] = at[child], d[first]
            at[left] = child[group]
            left = left[at[left] != left]
        self.children = np.flatnonzero(parent >= 0)
        key = parent[self.children] * 65 + edge[self.children]
        order = np.argsort(key, kind="stable")
        self.children, self.key = self.children[order], key[order]

    def within(self, queries: np.ndarray, start: np.ndarray, radius: int):
        """Pairs (query number, item) at ``radius`` or less, searching from each query's root."""
        q, node = np.arange(len(queries)), start
        while len(q):
            d = popcount(queries[q] ^ self.fps[node])
            hit = d <= radius
            yield q[hit], node[hit]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - low
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, node = np.repeat(q, n), self.children[np.repeat(low, n) + offset]


def _fold(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least index reachable, after the links ``(u, v)`` as well as those that ``label`` stands for."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def _hung(label: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hung = np.flatnonzero(label != np.arange(len(label)))
    return reps[hung], reps[label[hung]]


def _alike(n: np.ndarray, u: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of ``n`` members are near enough in size to be ``least`` similar."""
    return np.minimum(n[u], n[v]) >= least * np.maximum(n[u], n[v]) - 1e-9


def _own_links(cells: np.ndarray, fps: np.ndarray, reps: np.ndarray, n: np.ndarray, radius: int, least: float):
    """Spanning links inside whole cells, each of which is one tree."""
    starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(1)])
    sizes = np.diff(np.r_[starts, len(fps)])
    root = np.repeat(starts, sizes)
    forest = BKForest(fps, root)
    done = np.cumsum(np.repeat(sizes, sizes))
    label, lo = np.arange(len(fps)), 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + FRONT, "right")))
        for q, node in forest.within(fps[lo:hi], root[lo:hi], radius):
            q = q + lo
            keep = (q > node) & _alike(n, q, node, least)
            label = _fold(label, q[keep], node[keep])
        lo = hi
    return _hung(label, reps)


TREE = [("fps", "<u8"), ("reps", "<i8"), ("n", "<i4"), ("children", "<i4"), ("key", "<i4")]


def _packed_tree(fps: np.ndarray, reps: np.ndarray, n: np.ndarray) -> bytes:
    tree = BKForest(fps, np.zeros(len(fps), np.int64))
    parts = {"fps": fps, "reps": reps, "n": n, "children": np.r_[0, tree.children], "key": np.r_[-1, tree.key]}
    return b"".join(parts[name].astype(kind).tobytes() for name, kind in TREE)


def _tree(raw: bytes) -> dict[str, np.ndarray]:
    size, at, out = len(raw) // sum(np.dtype(kind).itemsize for _, kind in TREE), 0, {}
    for name, kind in TREE:
        out[name] = np.frombuffer(raw, kind, size, at)
        at += out[name].nbytes
    return out


def _cross_links(a: bytes, b: bytes, radius: int, least: float):
    """Spanning links between the rows of two slices: those of ``b`` ask the tree of ``a``."""
    a, b = _tree(a), _tree(b)
    tree = BKForest.__new__(BKForest)
    tree.fps, tree.children, tree.key = a["fps"], a["children"][1:].astype(np.int64), a["key"][1:].astype(np.int64)
    size = len(a["fps"])
    n, label = np.concatenate([a["n"], b["n"]]), np.arange(size + len(b["fps"]))
    for lo in range(0, len(b["fps"]), max(1, FRONT // size)):
        asking = b["fps"][lo : lo + max(1, FRONT // size)]
        for q, node in tree.within(asking, np.zeros(len(asking), np.int64), radius):
            q = q + lo + size
            keep = _alike(n, q, node, least)
            label = _fold(label, q[keep], node[keep])
    return _hung(label, np.concatenate([a["reps"], b["reps"]]))


def _edges(src: np.ndarray, dst: np.ndarray) -> list[pa.Array]:
    return [pa.array(src, pa.int64()), pa.array(dst, pa.int64())]


def shard_links(keyed: DataFrame, radius: int, cell: int = 1024, least: float = 0.0) -> DataFrame:
    """``(src, dst)`` that connect whatever the shards of ``keyed (t, key, fp, rep, n)`` hold within ``radius`` bits.

    ``n`` is a size; sizes further apart than the share ``least`` do not link.
    """
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("there")).where("there > 1")
    slices = F.ceil(F.col("there") / cell).cast("int")
    placed = keyed.join(sizes, ["t", "key"]).withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("fp", "rep", F.lit(7)), slices).cast("int"))
    cells = ["t", "key", "slice"]
    dealt = placed.select(*cells, "slices", "fp", "rep", F.col("n").cast("int").alias("n")).repartition(*cells).sortWithinPartitions(*cells, "fp")

    def build(batches):
        kept, rows = [], 0

        def found(table: pa.Table):
            cols = {c: table.column(c).to_numpy() for c in table.column_names}
            fps = cols["fp"].view(np.uint64)
            places = np.stack([cols[c] for c in cells], 1)
            src, dst = _own_links(places, fps, cols["rep"], cols["n"], radius, least)
            none = pa.nulls(len(src), pa.int64())
            yield pa.RecordBatch.from_arrays([*_edges(src, dst), none.cast(pa.int32()), none, none.cast(pa.int32()), none.cast(pa.int32()), pa.nulls(len(src), pa.binary())], names)
            starts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(1)])
            for lo, hi in zip(starts, np.r_[starts[1:], len(places)]):
                if cols["slices"][lo] > 1:
                    tree = _packed_tree(fps[lo:hi], cols["rep"][lo:hi], cols["n"][lo:hi])
                    t, key, part = places[lo].tolist()
                    row = [pa.nulls(1, pa.int64())] * 2 + [pa.array([t], pa.int32()), pa.array([key], pa.int64()), pa.array([part], pa.int32()), pa.array([cols["slices"][lo]], pa.int32()), pa.array([tree], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= FOREST:
                table = pa.Table.from_batches(kept)
                places = np.stack([table.column(c).to_numpy() for c in cells], 1)
                border = np.flatnonzero((places[1:] != places[:-1]).any(1))
                if len(border):
                    yield from found(table.slice(0, int(border[-1]) + 1))
                    table = table.slice(int(border[-1]) + 1)
                kept, rows = table.to_batches(), table.num_rows
        if rows:
            yield from found(pa.Table.from_batches(kept))

    names = ["src", "dst", "t", "key", "slice", "slices", "tree"]
    built = cut(dealt.mapInArrow(build, "src long, dst long, t int, key long, slice int, slices int, tree binary"), "trees")
    edges, trees = built.where("tree is null").select("src", "dst"), built.where("tree is not null").select("t", "key", "slice", "slices", "tree")
    size = trees.agg(F.sum(F.octet_length("tree"))).first()[0]
    if not size:
        return edges
    bound_batches(keyed.sparkSession)
    if size > TREES_BYTES:
        return edges.unionByName(_tiled(trees, radius, least))
    asked = F.broadcast(trees.select("t", "key", F.col("slice").alias("of"), F.col("tree").alias("other")))
    met = trees.repartition(*cells).join(asked, ["t", "key"]).where("of < slice").select("other", "tree")

    def cross(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(_edges(*_cross_links(a, b, radius, least)), ["src", "dst"])

    return edges.unionByName(met.mapInArrow(cross, "src long, dst long"))


def _tiled(trees: DataFrame, radius: int, least: float) -> DataFrame:
    """Links between slices of a shard where the trees are too many to broadcast.

    ``TILE`` slices are a row of a square, and a tile is two such rows: the key that its trees travel by. So a shard's slices
    spread over as many tasks as it has tiles, a task holds the trees of one, and a tree is sent once for every row.
    """
    row, last = F.floor(F.col("slice") / TILE), F.floor((F.col("slices") - 1) / TILE)
    other = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")
    sent = trees.withColumn("row", row).select("*", other)
    tile = ["t", "key", F.least("row", "other").alias("lo"), F.greatest("row", "other").alias("hi")]
    keys = ["t", "key", "lo", "hi"]
    dealt = sent.select(*tile, "slice", "tree").repartition(*keys).sortWithinPartitions(*keys, "slice")

    def run(batches):
        at, held = None, []
        for batch in batches:
            for t, key, lo, hi, part, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, key, lo, hi) != at:
                    at, held = (t, key, lo, hi), []
                for of, earlier in held:
                    if lo == hi or (of // TILE, part // TILE) == (lo, hi):
                        yield pa.RecordBatch.from_arrays(_edges(*_cross_links(earlier, tree, radius, least)), ["src", "dst"])
                held.append((part, tree))

    return dealt.mapInArrow(run, "src long, dst long")


def links(fps: DataFrame, radius: int, blocks: int = 6, cell: int = 1024) -> DataFrame:
    """``(src, dst)`` over ``rep`` ids that connect all of ``fps (fp, rep)`` within ``radius`` bits.

    ``fp`` must be distinct. More ``blocks`` make more and smaller shards; the links stay complete.
    """
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    tables = []
    for t, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask -= (mask >> 63) << 64
        tables.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    keyed = fps.where("rep is not null").select("fp", "rep", F.explode(F.array(*tables)).alias("k"))
    return shard_links(keyed.select("k.t", "k.key", "fp", "rep", F.lit(0).alias("n")), radius, cell)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    radius: int = 4,
    blocks: int = 6,
    cell: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document; the component is its smallest reachable id."""
    own = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    groups = connected_components(links(distinct, radius, blocks, cell))
    labelled = distinct.join(groups, distinct.rep == groups.vertex, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    # a table of known size, so that very many rows of one fingerprint (texts without words) do not meet under one key
    return own.join(sized(cut(labelled, "labelled")), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# --- similarity of shingle sets --------------------------------------------------------------------


def _permuted(tables: int) -> list[tuple[int, int]]:
    rng = np.random.default_rng(11)
    return [(int(a), int(b) | 1) for a, b in rng.integers(0, 2**63, (2 * tables, 2), np.int64)]


def sketches(docs: DataFrame, shingle: int, tables: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, digest, fp, n, keys)``: a digest of the shingle set, its fingerprint, its size and a shard key a table."""
    permuted = _permuted(tables)

    def setup():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t or "", shingle) for t in batch.column(0).to_pylist()]
            fps = np.array([_majority(s[lo : lo + BLOCK] for lo in range(0, len(s), BLOCK)) for s in sets], np.uint64)
            n = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate([s if len(s) else np.zeros(1, np.uint64) for s in sets])
            begins = np.cumsum(np.maximum(n, 1)) - np.maximum(n, 1)
            least = [np.minimum.reduceat((every ^ np.uint64(a)) * np.uint64(b), begins) for a, b in permuted]
            keys = np.stack([(x * np.uint64(0x9E3779B97F4A7C15)) ^ y for x, y in zip(least[::2], least[1::2])], 1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            digests = pa.array([_digest(s) for s in sets], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(1), digests, pa.array(fps.view(np.int64)), pa.array(n), lists], ["id", "digest", "fp", "n", "keys"])

        return work

    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    return map_texts(docs, text_col, [named(id_col).alias("id")], f"id {kind}, digest binary, fp long, n long, keys array<long>", setup)


def _digest(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.astype("<u8").tobytes())


def _verified(sets: list[np.ndarray], fps: np.ndarray, role: np.ndarray, same: bool, radius: int, least: float) -> np.ndarray:
    """Least row that each row reaches over pairs of one cell whose sets are ``least`` similar.

    Rows of role 0 form the tree; those of role 1 ask, or all do in a cell of one slice with itself. A pair that
    is connected already is not compared.
    """
    label = np.arange(len(sets))
    tree = np.flatnonzero(role == 0)
    ask = tree if same else np.flatnonzero(role == 1)
    if not len(tree) or not len(ask):
        return label
    n = np.array([len(s) for s in sets])
    every, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    shared = (count > 1)[code]
    row, code = np.repeat(np.arange(len(sets)), n)[shared], place[code][shared]
    bits = np.zeros((len(sets), max(1, -(-int((count > 1).sum()) // 64))), np.uint64)
    np.bitwise_or.at(bits, (row, code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
    forest = BKForest(fps[tree], np.zeros(len(tree), np.int64))
    most = max(1, (1 << 20) // bits.shape[1])
    step = max(1, FRONT // len(tree))
    for at in range(0, len(ask), step):
        who = ask[at : at + step]
        for q, node in forest.within(fps[who], np.zeros(len(who), np.int64), radius):
            u, v = who[q], tree[node]
            keep = _alike(n, u, v, least) & ((u > v) if same else True)
            u, v = u[keep], v[keep]
            lo, held = 0, 64
            while lo < len(u):
                x, y = u[lo : lo + held], v[lo : lo + held]
                lo += held
                open_ = label[x] != label[y]
                x, y = x[open_], y[open_]
                both = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64)
                union = n[x] + n[y] - both
                alike = both >= least * union
                label = _fold(label, x[alike], y[alike])
                held = min(2 * held, most)
    return label


def _cell_links(placed: DataFrame, radius: int, least: float) -> DataFrame:
    """``(src, dst)`` that connect what the cells of ``placed (group, slice, role, rep, fp, members)`` hold in links.

    Rows of role 0 are compared with each other if no row of role 1 is there, else those of role 1 with them, a slice's worth at a time.
    """
    bound_batches(placed.sparkSession)

    def run(batches):
        key, tree, asking, size, asked = None, [], [], 0, False

        def found(rows):
            reps, fps, role = (np.array([r[c] for r in rows]) for c in ("rep", "fp", "role"))
            members = [np.frombuffer(r["members"], "<u8") for r in rows]
            label = _verified(members, fps.view(np.uint64), role, not role.any(), radius, least)
            return pa.RecordBatch.from_arrays(_edges(*_hung(label, reps)), ["src", "dst"])

        def rest():
            if asking and tree or len(tree) > 1 and not asked:
                yield found(tree + asking)

        for batch in batches:
            for row in batch.to_pylist():
                now = row["group"], row["slice"]
                if now != key:
                    yield from rest()
                    key, tree, asking, size, asked = now, [], [], 0, False
                if row["role"] == 0:
                    tree.append(row)
                    continue
                asking.append(row)
                asked, size = True, size + len(row["members"]) // 8
                if len(asking) >= 512 or size >= SET_SIZE:
                    yield from rest()
                    asking, size = [], 0
        yield from rest()

    cells = placed.select("group", "slice", "role", "rep", "fp", "members").repartition("group", "slice").sortWithinPartitions("group", "slice", "role", "rep")
    return cells.mapInArrow(run, "src long, dst long")


def _group_links(rows: DataFrame, radius: int, least: float) -> DataFrame:
    """``(src, dst)`` that connect all links inside the groups of ``rows (group, slice, slices, rep, fp, members)``.

    Each slice is compared with itself. Where a group has several, the least of each part found asks the other slices, which
    joins most parts; then whatever is outside a group's largest part asks them too, so no link between parts is missed.
    """
    tree = rows.withColumn("role", F.lit(0))
    edges = cut(_cell_links(tree, radius, least), "links")
    sliced = rows.where("slices > 1")
    if sliced.isEmpty():
        return edges
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: i != F.col("slice")))

    def with_parts() -> DataFrame:
        parts = connected_components(edges)
        placed = sliced.drop("members").join(parts, F.col("rep") == F.col("vertex"), "left")
        return placed.select("group", "rep", F.coalesce("component", "rep").alias("part"))

    def asked(who: DataFrame) -> DataFrame:
        """Links of ``who (group, rep)`` with the other slices of their groups."""
        asks = sliced.join(who.select("rep"), "rep").withColumn("role", F.lit(1)).withColumn("slice", others)
        there = tree.where("slices > 1").join(who.select("group").distinct(), "group", "left_semi")
        return cut(_cell_links(there.unionByName(asks), radius, least), "links")

    edges = edges.unionByName(asked(cut(with_parts().where("rep = part").select("group", "rep"), "asking")))
    parts = cut(with_parts(), "parts")
    sizes = parts.groupBy("group", "part").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("group").agg(F.max_by("part", F.struct("size", "part")).alias("largest"))
    outside = cut(parts.join(largest, "group").where("part != largest").select("group", "rep"), "asking")
    return edges if outside.isEmpty() else edges.unionByName(asked(outside))


def similar(
    docs: DataFrame,
    shingle: int = 5,
    least: float = 0.8,
    radius: int = 24,
    tables: int = 10,
    cell: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, class_id, component_id``: one row per row of ``docs``; ids may be of any type that has an order.

    Equal shingle sets are one class, named by its smallest id. Classes link at a Jaccard similarity of ``least``
    or more; the component is the smallest id reachable. Two classes of similarity 0.8 share no shard with odds
    of 0.36 to the power of ``tables``, and stand further apart than ``radius`` bits with odds below one in a thousand.
    """
    own = cut(sketches(docs, shingle, tables, id_col, text_col), "sketches")
    classes = own.groupBy("digest").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    keyed = classes.where("n > 0").select(F.posexplode("keys").alias("t", "key"), "fp", "rep", "n")
    near = connected_components(shard_links(keyed, radius, cell, least))

    members = near.join(classes.select(F.col("rep").alias("vertex"), "digest", "id", "fp", "n"), "vertex").withColumnsRenamed({"vertex": "rep", "component": "group"})
    size = F.greatest(F.ceil(F.count("*") / (cell // 2)), F.ceil(F.sum("n") / SET_SIZE)).cast("int")
    placed = members.join(members.groupBy("group").agg(size.alias("slices")), "group").withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(7)), "slices").cast("int"))
    placed = cut(placed.select("id", "digest", "group", "slice", "slices", "rep", "fp"), "members")
    # only texts of groups are joined: those whose hashed id is among the groups', which are broadcast up to a checked size
    asked = sized(cut(placed.select(F.xxhash64("id").alias("h")).distinct(), "asking"))
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).withColumn("h", F.xxhash64("id")).join(asked, "h", "left_semi")
    texts = texts.drop("h").join(sized(placed), "id")

    def setup():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t or "", shingle) for t in batch.column(0).to_pylist()]
            same = pa.array([_digest(s) == d for s, d in zip(sets, batch.column(1).to_pylist())])  # rows of one id may differ
            rows = [*batch.columns[2:], pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
            return pa.RecordBatch.from_arrays(rows, [*carried, "members"]).filter(same)

        return work

    carried = ["group", "slice", "slices", "rep", "fp"]
    sets = map_texts(texts, "text", ["digest", *carried], "group long, slice int, slices int, rep long, fp long, members binary", setup)
    rows = cut(sets.dropDuplicates(["rep"]), "sets")
    groups = connected_components(_group_links(rows, radius, least))
    # most classes are alone and need no root; those of groups find it by a table of known size, so a large group stays spread
    grouped = cut(groups.join(classes.select(F.col("rep").alias("vertex"), "id"), "vertex"), "grouped")
    roots = sized(cut(grouped.groupBy("component").agg(F.min("id").alias("root")), "roots"))
    own_root = sized(cut(grouped.join(roots, "component").select("vertex", "root"), "roots"))
    labelled = classes.join(own_root, F.col("rep") == F.col("vertex"), "left").select("digest", F.col("id").alias("class_id"), F.coalesce("root", "id").alias("component_id"))
    return own.select("id", "digest").join(sized(cut(labelled, "labelled")), "digest").select("id", "class_id", "component_id")
