import numpy as np

from tarn.llm import crosspolytope as cp
from pyspark.sql import functions as F


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(3, 8))
    h = np.array([[1]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(cp.hadamard(x), x @ h)


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(2)
    a = cp._unit(rng.normal(size=(4000, 64)))
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * cp._unit(r)
    h = cp.CrossPolytope(64, 10, 2, 6)
    met = np.zeros(len(a), bool)
    for t in range(10):
        x, y = h.buckets(a, t), h.buckets(b, t)
        met |= (x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)
    assert met.mean() > 0.97, met.mean()


def vectors(rng, dim=12):
    rows = [rng.normal(size=dim) for _ in range(60)]
    rows += [rows[0] + rng.normal(size=dim) * 0.05 for _ in range(25)] + [rows[3]] * 7 + [rows[3] * 2]
    rows = [[float(np.float32(x)) for x in r] for r in rows]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] * dim, [1.0] * (dim - 1)]
    return [(i * 5 + 2, r, "clash") for i, r in enumerate(rows + bad)], len(rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket string")


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows, good = vectors(np.random.default_rng(4))
    monkeypatch.setattr(cp, "SLICE", 4)
    got = {r.vec_id: r for r in cp.near_duplicates(frame(spark, [*rows, (None, rows[3][1], "")]), tables=12).collect()}
    ids = [i for i, _, _ in rows]
    x = cp._unit(np.array([v for _, v, _ in rows[:good]]))
    linked = np.zeros((len(rows), len(rows)), bool)
    linked[:good, :good] = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    for _ in range(len(rows)):
        label = np.array([min([label[i], *label[linked[i]]]) for i in range(len(rows))])
    for i, v in enumerate(ids):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (linked[i].sum(), label[i], label[i] == v)
    assert linked.sum() > 600
    assert got[None].component_id is None and got[None].n_links == 0
    assert cp.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_nearest_equals_brute_force(spark):
    rows, good = vectors(np.random.default_rng(5))
    got = cp.nearest(frame(spark, rows), F.col("id") % 4 == 0, k=10, tables=6, probes=32).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = np.array([v for _, v, _ in rows[:good]])
    ids = np.array([i for i, _, _ in rows[:good]])
    assert set(by) == {i for i in ids if i % 4 == 0}
    for q, found in by.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        want = sorted((s, i) for s, i in zip(d, ids) if i != q)[:10]
        assert [(i, s) for s, i in want] == [(i, s) for i, s in found]
    assert cp.nearest(frame(spark, rows).limit(0), F.col("id") % 4 == 0).count() == 0
    few = cp.nearest(frame(spark, rows[:3]), F.col("id") == 2, probes=32).collect()
    assert len(few) == 2


def brute_nearest(rows, query, k):
    """Ids at their nearest rows, the query's rows aside."""
    best = {}
    for _, q in (r for r in rows if r[0] == query):
        for i, v in rows:
            if i != query:
                d = float(np.sqrt(((np.array(q) - np.array(v)) ** 2).sum()))
                best[i] = min(d, best.get(i, np.inf))
    return sorted((d, i) for i, d in best.items())[:k]


def test_repeated_rows_and_short_queries(spark, monkeypatch):
    monkeypatch.setattr(cp, "SCANNED", 3, raising=False)
    rng = np.random.default_rng(7)
    near = rng.normal(size=64)
    crowd = [(i, (near + rng.normal(size=64) * 0.3).tolist()) for i in range(60)]
    crowd += [(i, (np.array(v) + 0.01).tolist()) for i, v in crowd[:20]]
    crowd = [r for r in crowd for _ in range(10)]
    few = [(i, rng.normal(size=64).tolist()) for i in range(8)]
    for rows in (crowd, few):
        table = spark.createDataFrame([(i, v, "") for i, v in rows], "vec_id long, embedding array<double>, bucket string")
        got = cp.nearest(table, F.col("id") < 8, k=10).collect()
        for q in range(8):
            found = [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
            want = brute_nearest(rows, q, 10)
            assert [i for _, i in found] == [i for _, i in want]
            assert np.allclose([s for s, _ in found], [s for s, _ in want])


def table_of(spark, x):
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, `a.b` string")


def test_recall_at_the_defaults(spark):
    """Without clusters and with them, ten neighbours of every twentieth vector against brute force."""
    rng = np.random.default_rng(8)
    loose = rng.normal(size=(2000, 64))
    tight = rng.normal(size=(100, 64)).repeat(20, 0) + 0.3 * rng.normal(size=(2000, 64))
    for x in (loose, tight):
        x = x.astype(np.float32).astype(float)
        got = cp.nearest(table_of(spark, x), F.col("id") % 20 == 0, k=10).collect()
        hits = 0
        for q in range(0, len(x), 20):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            found = {r.vec_id: r.score for r in got if r.query_id == q}
            assert len(found) == 10 and all(s == d[i] for i, s in found.items())
            hits += len(found.keys() & set(np.argsort(d)[:10].tolist()))
        assert hits >= 0.9 * 1000, hits


def test_needed_probes_reach_the_home():
    rng = np.random.default_rng(9)
    x, y = cp._unit(rng.normal(size=(20, 16))), cp._unit(rng.normal(size=(20, 16)))
    h = cp.CrossPolytope(16, 3, 2, 1)
    need = h.needed(x, y)
    for i, n in enumerate(need):
        meets = [h.homes(y[i : i + 1], t)[0] in h.buckets(x[i : i + 1], t, int(n)) for t in range(3)]
        fewer = [n > 1 and h.homes(y[i : i + 1], t)[0] in h.buckets(x[i : i + 1], t, int(n) - 1) for t in range(3)]
        assert any(meets) and not any(fewer)


def test_near_duplicates_of_64_dimensions(spark):
    rng = np.random.default_rng(10)
    near = rng.normal(size=64)
    x = np.concatenate([rng.normal(size=(800, 64)), rng.normal(size=(60, 64)).repeat(5, 0) + 0.1 * rng.normal(size=(300, 64)), near + 0.05 * rng.normal(size=(1500, 64))])
    x = x.astype(np.float32).astype(float)
    got = {r.vec_id: r for r in cp.near_duplicates(table_of(spark, x)).collect()}
    linked = cp._unit(x) @ cp._unit(x).T >= 0.9
    label = np.array([row.argmax() for row in linked])
    missed = sum(linked[i].sum() - 1 - got[i].n_links for i in range(len(x)))
    assert missed <= 0.001 * linked.sum() and all(got[i].n_links <= linked[i].sum() - 1 for i in range(len(x)))
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_a_cell_of_near_copies_keeps_its_bound():
    import tracemalloc

    rng = np.random.default_rng(11)
    x = cp._unit(rng.normal(size=64) + 0.05 * rng.normal(size=(2048, 64)))
    slices = [(x[lo : lo + 1024], np.arange(lo, lo + 1024), np.ones(1024, int)) for lo in (0, 1024)]
    h = cp.CrossPolytope(64, 10, 2, 6)
    tracemalloc.start()
    home = int(np.bincount(h.homes(slices[0][0], 0)).argmax())
    assert cp._linked(0, home, slices[0], slices[1], cp.Covers(h), 0.9).num_rows > 1000
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_merged_probes_equal_the_whole_product():
    rng = np.random.default_rng(2)
    unit = cp._unit(rng.normal(size=(7, 10)))
    hashes = cp.CrossPolytope(10, 1, 3, 1)
    lost, best = [], []
    for part in range(3):
        s = hashes.scores(unit, 0, part)
        best.append(np.argsort(-s, axis=1, kind="stable"))
        lost.append(s.max(1, keepdims=True) - np.take_along_axis(s, best[-1], 1))
    for probes in (1, 2, 5, 33, 700, 32**3):
        found = hashes.buckets(unit, 0, probes)
        for i in range(len(unit)):
            sums = ((lost[0][i][:, None] + lost[1][i])[:, :, None] + lost[2][i]).ravel()
            order = np.argsort(sums, kind="stable")[:probes]
            a, b, c = np.unravel_index(order, (32, 32, 32))
            want = (best[0][i][a] * 32 + best[1][i][b]) * 32 + best[2][i][c]
            assert found.shape[1] == len(want) and sorted(found[i]) == sorted(want)
            assert found[i, 0] == hashes.homes(unit, 0)[i] == want[0]


def test_memory_of_many_probes():
    """Three rotations and some 17,000 probes, as 100,000 loose vectors ask for: memory does not grow with the rows at hand."""
    import tracemalloc

    rng = np.random.default_rng(5)
    hashes = cp.CrossPolytope(64, 1, 3, 1)
    unit = cp._unit(rng.normal(size=(cp.TILE, 64)))
    hashes.buckets(unit[:1], 0, 17_000)
    tracemalloc.start()
    found = hashes.buckets(unit, 0, 17_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (cp.TILE, 17_000) and most < 300e6, most
