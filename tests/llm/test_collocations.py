import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa

from tarn.llm import collocations as c


def brute(rows, least, most, share=100):
    """All of it with dictionaries, whole integers throughout."""
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= least}
    out = {}
    for (lang, p), a in candidates.items():
        inside = any(lg == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f >= share * a for (lg, q), f in candidates.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:most]))


def corpus(seed, size):
    rnd = random.Random(seed)
    words = ["a", "B", "the", "É", "x-y", " z", "日本", "q"]
    rows = []
    for _ in range(size):
        text = "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", " ", " ", ". ", "\n", "?!"]) for _ in range(rnd.randrange(40)))
        rows.append((text, rnd.choice(["en", "en", "en", None, "dé"])))
    rows += [(None, "en"), ("", None), (" \t. \n", "en"), ("a a a a a a a", "en"), ("lone" * 3000, "fr")] + rows[:9]
    return rows


def test_equals_brute_force(spark):
    for seed, least, most in ((1, 3, 1000), (2, 12, 7), (3, 5, 40)):
        rows = corpus(seed, 150)
        docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(5)
        got = c.collocations(docs, least, most)
        assert sorted(map(tuple, got.collect())) == brute(rows, least, most)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((x, "bigint") for x in ("a", "l", "r", "n", "score"))]
    assert c.collocations(docs.limit(0), 3).count() == 0


def test_share_of_a_longer_phrase(spark):
    rows = corpus(5, 120)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, c.collocations(docs, 4, 500, share=60).collect())) == brute(rows, 4, 500, 60)


def test_filter_has_no_misses(spark):
    rnd = random.Random(3)
    pairs = {(rnd.choice(["en", "de"]), f"w{rnd.randrange(900)} é{rnd.randrange(900)}") for _ in range(4000)}
    bits = c.pair_filter(spark.createDataFrame(list(pairs), "lang string, phrase string"))

    def asked(lang, phrase):
        h = c._hashes(pa.array([*phrase.split(" "), lang], pa.large_string()))
        return c._possible(bits, h[:1] ^ c._turned(h[1:2], 21) ^ c._turned(h[2:], 42))[0]

    assert all(asked(*p) for p in pairs)
    wrong = sum(asked("fr", p) for _, p in pairs)
    assert wrong < 20


def test_products_beyond_64_bits(spark):
    """Counts of the size that a hundred terabytes give."""
    n, a, left, right = 20_000_000_000_000, 9_000_000_000_000, 9_500_000_000_001, 9_000_000_000_003
    counts = spark.createDataFrame([("en", 0, "", n), ("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)], c.GRAMS).repartition(1)
    row = c.scored(counts).first()
    assert row["score"] == 1000 * a * n // (left * right) and 1000 * a * n > 1 << 64


def test_weights_and_slices(spark):
    """A piece's multiplicity counts as so many rows, wherever slices end."""
    words = ["u", "v", "w"]
    rnd = random.Random(8)
    distinct = [("en", " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9))), rnd.randrange(1, 10**12)) for _ in range(200)]
    want = Counter()
    for _, piece, m in distinct:
        w = piece.split()
        for x in pairwise(w):
            want[" ".join(x)] += m
    got = Counter()
    table = pa.RecordBatch.from_arrays([pa.array([r[0] for r in distinct]), pa.array([r[1] for r in distinct]), pa.array([r[2] for r in distinct], pa.int64())], ["lang", "piece", "m"])
    for start in range(0, 200, 33):
        for out in c.grams(table.slice(start, 33), None):
            for r in out.to_pylist():
                if r["size"] == 2:
                    got[r["phrase"]] += r["f"]
    assert got == want and np.int64(max(want.values())) == max(want.values())
