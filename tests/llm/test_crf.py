import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarn.llm import crf

GOOD = ["The weather was mild and the harbour lay quiet.", "She wrote a letter to her brother in the evening."]
BAD = ["BUY!! NOW!! CHEAP!!", "x%% y$$ z## w&&", "spam spam spam spam spam spam"]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    begins = np.array([0, 1, 5, 8])
    u, trans = rng.normal(size=8) * 3, rng.normal(size=(2, 2))
    good, joint = crf.marginals(u, trans, begins)
    for lo, hi in zip(begins, begins[1:]):
        p, pairs, total = np.zeros(hi - lo), np.zeros((hi - lo, 2, 2)), 0
        for y in itertools.product((0, 1), repeat=hi - lo):
            w = np.exp(sum(u[lo + i] for i in range(hi - lo) if y[i]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            p += w * np.array(y)
            for i in range(1, hi - lo):
                pairs[i, y[i - 1], y[i]] += w
        assert np.allclose(good[lo:hi], p / total)
        assert np.allclose(joint[lo:hi], pairs / total)


def test_gradient_equals_differences_of_the_enumerated_likelihood():
    rng = np.random.default_rng(3)
    begins, label = np.array([0, 1, 4, 8]), np.array([1.0, 0.0, 1.0])
    z, chars = rng.normal(size=(8, crf.WIDTH)), rng.integers(0, 9, 8) + 1.0
    weight = chars / np.repeat(np.add.reduceat(chars, begins[:-1]), np.diff(begins))
    theta = rng.normal(size=crf.WIDTH + 4) * 0.3

    def brute(theta):
        u, trans, out = z @ theta[: crf.WIDTH], theta[crf.WIDTH :].reshape(2, 2), 0.0
        for (lo, hi), y in zip(itertools.pairwise(begins), label):
            total = score = 0.0
            for labels in itertools.product((0, 1), repeat=hi - lo):
                w = np.exp(np.dot(labels, u[lo:hi]) + sum(trans[a, b] for a, b in itertools.pairwise(labels)))
                total, score = total + w, score + w * np.dot(labels, weight[lo:hi])
            out += np.log(score / total if y else 1 - score / total)
        return out

    value, grad = crf.likelihood(theta, z, weight, begins, label)
    assert np.isclose(value, brute(theta), rtol=1e-5)
    for i in (0, 7, crf.WIDTH - 1, crf.WIDTH, crf.WIDTH + 1, crf.WIDTH + 2, crf.WIDTH + 3):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert np.isclose(grad[i], (brute(theta + step) - brute(theta - step)) / 2e-5, rtol=1e-4, atol=1e-6)


def test_mixed_documents_get_mixed_marginals():
    """Only documents are labelled, the good ones hold a bad line at times and the bad ones a good one; lines come apart."""
    rng = np.random.default_rng(4)
    texts, label = [], []
    for _ in range(300):
        q = int(rng.random() < 0.5)
        texts.append("\n".join(str(rng.choice(GOOD if (rng.random() < 0.85) == bool(q) else BAD)) for _ in range(rng.integers(1, 9))))
        label.append(q)
    x, chars, begins = crf.line_features(pa.array(texts, pa.large_string()))
    model = crf.fit(x, chars, begins, np.array(label, float))
    lines = [GOOD[0], GOOD[1], GOOD[0], BAD[0], BAD[1], BAD[0]]
    x, _, begins = crf.line_features(pa.array(["\n".join(lines)], pa.large_string()))
    good, _ = crf.marginals((x - model.mean) / model.scale @ model.weights, model.trans, begins)
    assert good[:2].min() > good[-2:].max() + 0.3, good


def test_many_lines_stay_finite():
    texts = pa.array(["a\n" * 50000 + "B!!", "", "\n\n"], pa.large_string())
    x, chars, begins = crf.line_features(texts)
    assert len(x) == 50001 + 1 + 3 and list(begins) == [0, 50001, 50002, 50005]
    good, _ = crf.marginals(np.where(x[:, 4] > 0, -400.0, 9.0), np.array([[3.0, -3.0], [-3.0, 3.0]]), begins)
    assert np.isfinite(good).all()


def tables(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(240):
        q = int(rng.random() < 0.7)
        lines = [str(rng.choice(GOOD if q else BAD)) for _ in range(rng.integers(1, 6))]
        if not q and len(lines) > 2:
            lines[0] = GOOD[0]
        rows.append((i, "\n".join(lines), "clash"))
        labels.append((i, q))
    rows += [(500, None, ""), (501, "", ""), (502, "x" * 300000, ""), (None, GOOD[0], ""), (3, rows[3][1], "")]
    labels += [(None, 1), (7, None), (3, labels[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    model = crf.train(docs, labels.where(F.col("doc_id") % 5 != 0))
    got = crf.score_texts(docs, model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score >= 0.3) == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 5 == 0]
    assert np.mean(held) > 0.95
    kept = crf.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.3 for r in got)


def test_empty(spark):
    docs, labels = tables(spark)
    model = crf.train(docs, labels.limit(0))
    assert {r.score for r in crf.score_texts(docs, model).collect()} == {0.5}
    assert crf.score_texts(docs.limit(0), model).count() == 0


def test_blocks_equal_the_whole(monkeypatch):
    """Messages carried over blocks of a few lines, against all lines at once."""
    rng = np.random.default_rng(6)
    texts = pa.array(["\n".join(str(rng.choice(GOOD + BAD + [""])) for _ in range(n)) for n in (1, 40, 3, 1, 17, 2, 90)] + [""], pa.large_string())
    model = crf.Model(rng.normal(size=crf.WIDTH), rng.normal(size=(2, 2)), rng.normal(size=crf.WIDTH), np.ones(crf.WIDTH))
    x, chars, begins = crf.line_features(texts)
    u = (x - model.mean) / model.scale @ model.weights
    good, _ = crf.marginals(u, model.trans, begins)
    assert np.allclose(crf.goodness(u, model.trans, begins), good)
    want = [np.average(good[lo:hi], weights=chars[lo:hi] + 1.0) for lo, hi in itertools.pairwise(begins)]
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(crf, "BLOCK", block)
        assert np.allclose(crf.goodness(u, model.trans, begins), good)
        assert np.allclose(model.score(texts), want)


def test_five_million_lines_are_scored_and_passed_over_in_training(spark):
    docs, labels = tables(spark)
    whole = spark.range(1).select(F.lit(600).cast("long").alias("doc_id"), F.repeat(F.lit("ab\n"), 5_000_000).alias("text"), F.lit("").alias("score"))
    model = crf.train(docs.unionByName(whole), labels.unionByName(spark.createDataFrame([(600, 0)], labels.schema)))
    same = crf.train(docs, labels)
    assert np.allclose(model.weights, same.weights)
    assert 0 <= crf.score_texts(whole, model).first().score <= 1
    few = crf.train(docs, labels, lines=40)
    assert np.isfinite(few.weights).all() and not np.allclose(few.weights, same.weights)
