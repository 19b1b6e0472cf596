import random

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from tarn.llm import simhash


def brute_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


TEXTS = ["", " \t\n", "One", "one TWO three", "a b c d e", "É é A\x1cB a b c d", "x " * 5000]


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t, 4) == brute_fingerprint(t), t


@pytest.mark.parametrize("cell", [3, 1024])
def test_groups_equal_brute_force(spark, cell):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 40, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 9])):
            copy = list(base)
            if rnd.random() < 0.7:
                copy[rnd.randrange(len(copy))] = "changed"
            rows.append((i * 3 % 1000, " ".join(copy), "clash"))
            i += 1
    rows += [(1000 + j, t, None) for j, t in enumerate([*TEXTS, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, 4, 4, cell=cell).collect()}
    fps = {d: brute_fingerprint(t or "") for d, t, _ in rows}
    want = brute_components(fps, 4)
    assert len(got) == len(rows)
    for d in fps:
        assert got[d].fingerprint == f"{fps[d]:016x}"
        assert got[d].component_id == want[d]
    assert len({*want.values()}) < len(rows)


def test_dense_shard(spark):
    rnd = random.Random(1)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 9]))) for _ in range(300)}
    fps = {f: i for i, f in enumerate(sorted(fps))}
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in fps.items()], "fp long, rep long")
    edges = simhash.links(frame, 4, cell=50).collect()
    label = list(range(len(fps)))
    for _ in range(20):
        for e in edges:
            label[e.src] = label[e.dst] = min(label[e.src], label[e.dst])
    want = brute_components({i: f for f, i in fps.items()}, 4)
    assert label == [want[i] for i in range(len(fps))]
    assert len(edges) < 15 * 28 * 100


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "only null")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, 4).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0), 4).count() == 0


def test_forest_finds_all():
    rnd = np.random.default_rng(3)
    fps = rnd.integers(0, 2**63, 200, dtype=np.uint64) & np.uint64(0xFFF)
    roots = np.repeat([0, 100], 100)
    forest = simhash.BKForest(fps, roots)
    got = {(int(q), int(n)) for a, b in forest.within(fps, roots, 3) for q, n in zip(a, b)}
    assert got == {(i, j) for i in range(200) for j in range(200) if roots[i] == roots[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 3}


def test_broadcast_and_joined_trees_agree(spark, monkeypatch):
    rnd = random.Random(8)
    centre = rnd.getrandbits(62)
    rows = sorted({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 3, 7]))) for _ in range(200)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(rows)], "fp long, rep long")
    want = brute_components({i: f for i, f in enumerate(rows)}, 4)
    for bound in (0, 1 << 26):
        monkeypatch.setattr(simhash, "TREES_BYTES", bound)
        label = simhash._fold(np.arange(len(rows)), *np.array([(e.src, e.dst) for e in simhash.links(frame, 4, cell=20).collect()]).T)
        assert label.tolist() == [want[i] for i in range(len(rows))]


def test_one_large_shard_spreads_over_tiles(spark, monkeypatch):
    """Twelve thousand fingerprints under one key, beyond the broadcast: the same links, no task with more than two rows of slices."""
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 1 << 62, 300)
    fps = np.unique(np.concatenate([c ^ (np.int64(1) << rnd.integers(0, 62, 40)) for c in centres]))
    frame = spark.createDataFrame([(0, 0, int(f), i, 0) for i, f in enumerate(fps)], "t int, key long, fp long, rep long, n int")
    labels, seen = [], []
    deal = simhash._tiled
    monkeypatch.setattr(simhash, "_tiled", lambda trees, *rest: seen.append(trees) or deal(trees, *rest))
    for bound in (0, 1 << 26):
        monkeypatch.setattr(simhash, "TREES_BYTES", bound)
        found = simhash.shard_links(frame, 2, cell=256).toPandas()
        labels.append(simhash._fold(np.arange(len(fps)), found.src.to_numpy(), found.dst.to_numpy()))
    assert (labels[0] == labels[1]).all() and len(set(labels[0])) <= 300
    slices = seen[0].count()
    assert len(seen) == 1 and slices == -(-len(fps) // 256)
    rows = -(-slices // simhash.TILE)
    tiles = seen[0].selectExpr("explode(sequence(0, cast((slices - 1) div 8 as int))) AS other", "slice div 8 AS row").groupBy(F.least("row", "other"), F.greatest("row", "other")).count()
    assert tiles.count() == rows * (rows + 1) // 2 and tiles.agg(F.max("count")).first()[0] <= 2 * simhash.TILE


def brute_sets(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("cell", [6, 1024])
def test_similar_equals_brute_force(spark, cell):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    passage = [rnd.choice(words) for _ in range(60)]
    texts = ["", None, "one two", "One  two", "one two three", "x " * 400, "x " * 900]
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([8, 40, 120, 400]))]
        if rnd.random() < 0.3:
            base = base[:20] + passage + base[20:]
        for _ in range(rnd.choice([1, 1, 3, 10])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(copy) // 40)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy) + (" " + copy[0] if rnd.random() < 0.2 else ""))
    # a large group in which many are alike to some only
    base = [rnd.choice(words) for _ in range(60)]
    for _ in range(40):
        at = rnd.randrange(50)
        texts.append(" ".join([*base[:at], *(rnd.choice(words) for _ in range(rnd.choice([1, 1, 2, 3, 5]))), *base[at:]]))
    docs = spark.createDataFrame([(i * 7 % 1009, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string")
    sets = {i * 7 % 1009: brute_sets(t or "") for i, t in enumerate(texts)}
    label = {i: i for i in sets}
    alike = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    assert len(alike) > 100
    for _ in range(40):
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.id: r for r in simhash.similar(docs, cell=cell).collect()}
    assert {i: r.component_id for i, r in got.items()} == label
    assert all(r.class_id == min(j for j in sets if sets[j] == sets[i]) for i, r in got.items())
    assert simhash.similar(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    long = " ".join(str(i * 7919 % 100003) for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, 4).collect()}
    assert got[1].fingerprint == f"{brute_fingerprint(long):016x}"
    assert {r.id: r.component_id for r in simhash.similar(docs).collect()} == {1: 1, 2: 1, 3: 3}
