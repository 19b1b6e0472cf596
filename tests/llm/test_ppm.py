import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import ppm

ORDER = 3


def lower(text):
    return (text or "").encode().lower()


class Brute:
    """Walks the trie for every symbol, with explicit exclusion sets."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            s = [ppm.PAD] * ORDER + list(lower(t)) + [ppm.END]
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    self.counts[tuple(s[i - k : i])][s[i]] += 1

    def p(self, history, symbol):
        excluded, p = set(), 1.0
        for k in range(ORDER, -1, -1):
            context = tuple(history[len(history) - k :])
            if context not in self.counts:
                continue
            left = {s: c for s, c in self.counts[context].items() if s not in excluded}
            total = sum(left.values())
            if symbol in left:
                return p * (2 * left[symbol] - 1) / (2 * total)
            if left:
                p *= len(left) / (2 * total)
            excluded |= set(left)
        return p / (257 - len(excluded))

    def score(self, text):
        s = [ppm.PAD] * ORDER + list(lower(text)) + [ppm.END]
        return sum(math.log10(self.p(s[:i], s[i])) for i in range(ORDER, len(s)))


def corpus():
    rnd = random.Random(3)
    words = ["the", "of", "and", "Haus", "été", "x\x1cy"]
    texts = [rnd.choice([" ", "", "\n"]).join(rnd.choice(words) + rnd.choice([" ", "  ", "\t"]) for _ in range(rnd.randrange(60))) for _ in range(40)]
    return [(i, t, "clash") for i, t in enumerate([*texts, None, "", " \n", "ZZZ \x00\x07 new", "the " * 3000])] + [(None, "the of", "x"), (3, texts[3], "x")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = ppm.score_texts(docs, out, ORDER).collect()
    train = [t for i, t, _ in rows if not held(i)]
    brute = Brute(train)
    tokens = [w for t in train for w in [*lower(t).split(), b"\n"]]
    c = Counter(tokens)
    want = []
    for i, t, _ in rows:
        own = [*lower(t).split(), b"\n"]
        base = sum(math.log10((c[w] + 0.5) / (len(tokens) + 0.5 * (len(c) + 1))) for w in own)
        want.append((i, held(i), len(own), sum(c[w] > 0 for w in own), len(tokens), base, brute.score(t)))
    key = lambda r: (str(r[0]), r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert math.isclose(g[6], w[6], rel_tol=1e-9), (w, g)
    assert any(w[1] for w in want)
    assert ppm.score_texts(docs.limit(0), out, ORDER).count() == 0


def test_probabilities_sum_to_one(spark):
    texts = [t for _, t, _ in corpus()]
    brute = Brute(texts)
    docs = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tails = [b"the o", b"", b"zz", "été".encode()]
    asked = [(i * 300 + c, (t + bytes([c])).decode("latin-1")) for i, t in enumerate(tails) for c in range(128)]
    every = docs.unionByName(spark.createDataFrame(asked, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in ppm.score_texts(every, F.col("doc_id") >= 0, ORDER).collect()}
    for i, t in asked[:128:7]:
        assert math.isclose(got[i], brute.score(t), rel_tol=1e-9)
    for tail in tails:
        s = [ppm.PAD] * ORDER + list(tail)
        assert math.isclose(sum(brute.p(s, x) for x in range(257)), 1, rel_tol=1e-9)


def test_without_training(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score_texts(docs, F.lit(True), 2).collect()}
    assert math.isclose(got[1].score, 3 * math.log10(1 / 257), rel_tol=1e-9)
    assert got[2].n_known == 0 and got[2].train_tokens == 0


def test_every_context_counts(spark, monkeypatch):
    rows = [(i, t) for i, t, _ in corpus()] + [(None, "the of and " * 20000), (7777, "of the " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    monkeypatch.setattr(ppm, "WINDOW", 1000)
    monkeypatch.setattr(ppm, "PIECE_BYTES", 3000)
    brute = Brute([t for i, t in rows if not held(i)])
    want = {i: brute.score(t) for i, t in rows if held(i)}
    got = {r.doc_id: r.score for r in ppm.score_texts(docs, out, ORDER).collect() if r.held_out}
    assert len(want) > 3 and got.keys() == want.keys()
    for i, score in want.items():
        assert math.isclose(got[i], score, rel_tol=1e-9), i


def test_places():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 100_000):
        keys = rng.permutation(np.unique(rng.integers(0, 2**54, n)))
        assert (ppm.Places(keys)(np.r_[keys, keys[::-1]]) == np.r_[np.arange(len(keys)), np.arange(len(keys))[::-1]]).all()
