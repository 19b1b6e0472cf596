import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing

WORDS = {"a": ["the", "ship", "with", "that"], "b": ["der", "schiff", "und", "nicht"], "c": ["que", "señor", "el", "niño"]}


def docs(spark, n=120):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        d = "abc"[min(2, int(rng.integers(0, 10)) // 4)]
        rows.append((i, " ".join(rng.choice(WORDS[d], rng.integers(1, 60))), d))
    rows += [(500, None, "a"), (501, "", "a"), (None, "the ship", "a"), (1, rows[1][1], rows[1][2]), (502, "x" * 200000, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, p string")


def test_features():
    x, words = mixing.features(pa.array(["Ab  cd\n", "", "ab", " "], pa.large_string()))
    assert words.tolist() == [2, 0, 1, 0]
    assert np.isclose(x[0].sum(), 1) and x[1].sum() == 0 and x[2].max() == 1


def test_fit_reaches_the_targets(spark):
    table = docs(spark)
    model = mixing.fit_classifier(table.where("doc_id < 60"), ["a", "b", "c"], domain_col="p")
    members = mixing.memberships(table, model)
    rates = mixing.fit_rates(members, [0.2, 0.3, 0.5])
    got = mixing.with_rates(members, rates, 3).collect()
    assert len(got) == table.count()
    w, p, r = (np.array([x[c] for x in got], float) for c in ("n_tokens", "p", "rate"))
    a = (w / w.sum() * r) @ p
    assert np.abs(a - [0.2, 0.3, 0.5]).max() < 2e-3 and rates.residual < 2e-3
    assert (r >= 0).all()
    truth = {x.doc_id: x.p for x in table.collect()}
    hit = [("abc"[int(np.argmax(x.p))] == truth[x.doc_id]) for x in got if x.doc_id is not None and 60 <= x.doc_id < 120]
    assert np.mean(hit) > 0.95
    drawn = mixing.draw(table, model, rates)
    assert drawn.columns == table.columns
    count = {x.doc_id: x["count"] for x in drawn.groupBy("doc_id").count().collect()}
    for x in got:
        if x.doc_id not in (1, None):
            assert int(np.floor(x.rate)) <= count.get(x.doc_id, 0) <= int(np.floor(x.rate)) + 1


@pytest.mark.parametrize("target", [[0.8, 0.15, 0.05], [0.02, 0.08, 0.9], [1.0, 0.0, 0.0]])
def test_fit_equals_a_plain_projected_gradient(spark, target):
    """``fit_rates`` itself against a plain loop without momentum, objective included; the last target is out of reach."""
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.3] * 3, 50), rng.integers(1, 400, 50)
    w = n / n.sum()
    metric = np.linalg.inv((p * w[:, None]).T @ p)
    r = np.ones(50)
    for _ in range(20_000):
        r = np.maximum(0, r - p @ (metric @ ((w * r) @ p - target)))
    squares = lambda r: ((w * r) @ p - target) @ metric @ ((w * r) @ p - target) / 2
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rates = mixing.fit_rates(members, target, tolerance=1e-7, rounds=200)
    got = rates(p)
    assert (got >= 0).all() and rates.gradients
    assert squares(got) <= squares(r) * (1 + 1e-6) + 1e-10  # the loop itself has not quite ended for the last target
    assert np.allclose((w * got) @ p, (w * r) @ p, atol=2e-3 if target[0] == 1 else 1e-6)
    assert np.isclose(rates.residual, np.abs((w * got) @ p - target).max())


def test_rates_of_hundreds_of_thousands_are_drawn(spark):
    """A huge rate repeats its row in the JVM, batch by batch."""
    table = spark.createDataFrame([(1, "the ship " * 300, 5)], "doc_id long, text string, copies int")
    model = mixing.fit_classifier(table.limit(0), ["a", "b"], domain_col="text")
    drawn = mixing.draw(table, model, mixing.Rates([np.array([-2e5, -2e5])]))
    assert drawn.count() == 200_001 and drawn.columns == table.columns


def test_empty(spark):
    table = docs(spark, 5)
    model = mixing.fit_classifier(table.limit(0), ["a", "b"], domain_col="p")
    members = mixing.memberships(table, model)
    assert {tuple(r.p) for r in members.collect()} == {(0.5, 0.5)}
    nothing = mixing.memberships(table.limit(0), model)
    rates = mixing.fit_rates(nothing, [1, 1])
    assert mixing.with_rates(nothing, rates, 2).count() == 0
    assert mixing.draw(table.limit(0), model, rates).count() == 0


@pytest.mark.parametrize("shares", [[97, 1, 1, 1], [900, 50, 49, 1], [997, 1, 1, 1], [99997, 1, 1, 1]])
def test_rare_domains_reach_their_targets(spark, shares):
    rows = [(n, [0.97 * (i == j) + 0.01 * (i != j) if n > 1 else float(i == j) for j in range(4)]) for i, n in enumerate(shares)]
    target = np.array([0.4, 0.2, 0.2, 0.2])
    members = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rates = mixing.fit_rates(members, list(target))
    w, p = np.array(shares) / sum(shares), np.array([p for _, p in rows])
    assert np.abs((w * rates(p)) @ p - target).max() < 1e-4 and rates.residual < 1e-4
    assert (rates(p) >= 0).all()


def test_targets_out_of_reach_are_reported(spark):
    members = spark.createDataFrame([(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="miss their targets by up to 0.2"):
        rates = mixing.fit_rates(members, [0.4, 0.4, 0.2])
    assert abs(rates.residual - 0.2) < 1e-3 and np.abs(rates(np.eye(3)[:2]) - 0.8).max() < 1e-3
