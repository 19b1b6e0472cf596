"""The model stage: budgets, failures, and a trained model against plain loops."""

import random

import numpy as np
import pytest

from tarn.operators import rerank as R


def test_batches_hold_their_budget():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        lengths = rnd.integers(0, 200, rnd.integers(0, 60))
        got = list(R.batches_of(lengths, 400))
        assert sorted(np.concatenate(got).tolist() if got else []) == list(range(len(lengths)))
        assert all(len(b) == 1 or len(b) * lengths[b].max() <= 400 for b in got)
        assert all(lengths[a].max() <= lengths[b].min() for a, b in zip(got, got[1:]))


@pytest.fixture
def rows(spark):
    rnd = random.Random(2)
    data = [(q, i, 100 * q + i, f"q{q}", " ".join("w" for _ in range(rnd.randrange(1, 90)))) for q in range(5) for i in range(6)]
    data += [(7, 0, 700, "one", None), (8, 0, 800, None, "a"), (8, 1, 801, None, "b b")]
    return spark.createDataFrame(data, "qid long, rank long, doc_id long, query string, text string").repartition(3), data


def test_order_by_score(rows):
    frame, data = rows
    got = R.rerank(frame, lambda: lambda pairs: [len(t) % 5 for _, t in pairs], tokens=60).collect()
    for q in {d[0] for d in data}:
        own = sorted((r for r in got if r.qid == q), key=lambda r: r.pos)
        if q == 7:
            assert [r.fallback for r in own] == ["too-few"]
            continue
        assert all(r.fallback is None for r in own)
        assert [r.doc_id for r in own] == [d[2] for d in sorted((d for d in data if d[0] == q), key=lambda d: (-(len(d[4] or "") % 5), d[1]))]


@pytest.mark.parametrize("what", ["load", "always", "long", "infinite", "count"])
def test_failures_keep_the_order_and_say_why(rows, what):
    frame, data = rows

    def load():
        if what == "load":
            raise OSError("no model")

        def score(pairs):
            if what == "always" or what == "long" and any(len(t) > 170 for _, t in pairs):
                raise MemoryError
            return [float("inf") if what == "infinite" and q == "q1" else -len(t) for q, t in pairs][: -1 if what == "count" else None]

        return score

    got = R.rerank(frame, load, tokens=200).collect()
    assert len(got) == len(data)
    failed = {q for q in range(5) if what in ("load", "always", "count") or what == "infinite" and q == 1 or what == "long" and any(len(d[4]) > 170 for d in data if d[0] == q)}
    assert failed and (what in ("load", "always", "count") or len(failed) < 5)
    why = {"load": "load-OSError", "always": "MemoryError", "long": "MemoryError", "infinite": "nonfinite-score", "count": "ValueError"}[what]
    for q in range(5):
        own = sorted((r for r in got if r.qid == q), key=lambda r: r.pos)
        assert {r.fallback for r in own} == {why if q in failed else None}, (what, q)
        if q in failed:
            assert [r["rank"] for r in own] == list(range(6))
        else:
            assert [r.doc_id for r in own] == [d[2] for d in sorted((d for d in data if d[0] == q), key=lambda d: (len(d[4]), d[1]))]


def test_a_linear_model_learns(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    data = []
    for _ in range(200):
        query = [rnd.choice(words) for _ in range(5)]
        text = [rnd.choice(words) for _ in range(40)]
        label = rnd.randrange(2)
        data.append((" ".join(query), " ".join(text[:20] + (query if label else []) + text[20:]), label))
    model = R.LinearModel.fit(spark.createDataFrame(data, "query string, text string, label int").repartition(4))
    x, y = R.LinearModel.features([d[:2] for d in data]), np.array([d[2] for d in data])
    assert np.allclose(model.weights, np.linalg.solve(x.T @ x + 1e-3 * np.eye(5), x.T @ y))
    assert np.mean((model([d[:2] for d in data]) > 0.5) == y) > 0.95


def test_equal_pairs_score_alike_in_batches_of_any_size():
    rnd = np.random.default_rng(4)
    for n in range(2, 40):
        pair = (f"a b c{n}", " ".join(rnd.choice(list("abcdefgh"), n)))
        model = R.LinearModel(rnd.normal(size=5))
        assert len({float(s) for size in range(1, 24) for s in model([pair] * size)}) == 1, n
