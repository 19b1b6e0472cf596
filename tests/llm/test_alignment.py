import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tarn.llm import alignment as al

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello world, it's 2024!", " two  spaces\n\nand lines ", "ünïcödé straße", "日本語 \U0001f9ea\U0001f9ff กข", "<|endoftext|> <s> </s>", "mark ▁ here", "a" * 300, " " * 400 + "x", "\t\x00z", "\U0001fae0" * 90]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


@pytest.fixture(scope="module")
def aligner():
    return al.Aligner(*PATHS)


def plain_groups(text, libraries, tokens_a, tokens_b):
    """Groups between common ends, token by token."""
    a, b = libraries
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not text or b"".join(tokens_a[i] for i in ids_a) != (" " + text).encode() or b"".join(tokens_b[i] for i in ids_b) != (" " + text).encode():
        return [], [], []
    ends = [[], []]
    for side, (ids, tokens) in enumerate(((ids_a, tokens_a), (ids_b, tokens_b))):
        at = 0
        for i in ids:
            at += len(tokens[i])
            ends[side].append(at)
    both, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for e in both:
        x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        out.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return ids_a, ids_b, out


def brute(rows, libraries, aligner):
    each = [(doc, *plain_groups(text or "", libraries, aligner.a.tokens, aligner.b.tokens)) for doc, text in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for *_, g in each]
    docs, highest = Counter(p for c in links for p in c), defaultdict(int)
    for (a, _), n in docs.items():
        highest[a] = max(highest[a], n)
    out = []
    for (doc, ids_a, ids_b, groups), c in zip(each, links):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in c.items() if docs[p] == highest[p[0]])
        sha = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((doc, len(ids_a), len(ids_b), len(groups), sum(c.values()), best, sum(n * docs[p] for p, n in c.items()), sha))
    return out, docs, highest


def words(rnd, n):
    return "".join(rnd.choice(["the", " ship", "é", "1234", "\n", "  ", "日本", "\U0001f9ea", "'s", " token", "ization", "\t", "…", " Ä"]) for _ in range(n))


def corpus():
    rnd = random.Random(13)
    texts = [*TEXTS, "", None, TEXTS[0]] + [words(rnd, rnd.randrange(200)) for _ in range(60)]
    return list(enumerate(texts))


def test_equals_brute_force(spark, libraries, aligner):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, n_a string, `pair.s` int").repartition(4)
    want, pairs, highest = brute(rows, libraries, aligner)
    got = al.align(docs, *PATHS)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [w for w in want if w[1] == 0] and [w for w in want if w[4] > w[3]]
    table = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in al.pair_counts(docs, *PATHS).collect()}
    assert table == {p: (n, n == highest[p[0]]) for p, n in pairs.items()}
    assert al.align(docs.limit(0), *PATHS).count() == 0


def test_repeated_and_null_ids(spark, libraries, aligner):
    rows = [(None, "the ship"), (None, "the ship"), (4, "the ships"), (4, None)]
    got = al.align(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, libraries, aligner)[0]))


def test_small_blocks_and_segments(spark, libraries, aligner, monkeypatch):
    """Many blocks, and texts in many segments, give what whole ones give."""
    monkeypatch.setattr(al, "SLICE_BYTES", 200)
    rows = corpus()
    whole = {r[0]: r for r in brute(rows, libraries, aligner)[0]}
    block = al._Block(aligner)
    monkeypatch.setattr(aligner, "parts", lambda text: al.segments(" " + text, 30) if text else [])
    for doc, text in rows:
        block.add(doc, text)
    _, _, numbers, _ = block.rows()
    for i, (doc, _) in enumerate(rows):
        assert [numbers[k][i] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")] == [whole[doc][k] for k in (1, 2, 3, 4, 7)], rows[i]


def test_segments():
    text = " one  two\n three " * 20
    parts = list(al.segments(text, 25))
    assert "".join(parts) == text and all(p[0] == " " and len(p) >= 25 for p in parts[:-1])
    assert list(al.segments(" " + "x" * 99, 10)) == [" " + "x" * 99]


def test_components_against_a_loop():
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randrange(1, 30)
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(40))]
        label = list(range(n))
        for _ in range(n):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert al.roots(n, a, b).tolist() == label


def test_a_group_of_very_many_tokens():
    """A run whose ends never meet: its links are counted by distinct ids."""
    ends_a, ends_b = np.arange(1, 40_000) * 3, np.append(np.arange(0, 39_998) * 3 + 1, 39_999 * 3)
    group_a, group_b = al.groups_of(ends_a, ends_b)
    assert group_a.max() == group_b.max() == 0
    group, pair, many = al.linked(np.full(len(ends_a), 7), np.full(len(ends_b), 9), group_a, group_b, 100)
    assert (group.tolist(), pair.tolist(), many.tolist()) == ([0], [709], [len(ends_a) * len(ends_b)])
    at, times = al.unpack(al.pack(np.array([0, 3, 900]), np.array([1, len(ends_a) * len(ends_b) * 99, 2])))
    assert at.tolist() == [0, 3, 900] and times.tolist() == [1, len(ends_a) * len(ends_b) * 99, 2]


def test_groups_are_spans(spark, aligner):
    rows = [(i, t) for i, t in corpus() if t]
    for r in al.groups(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect():
        raw = b" " + dict(rows)[r.doc_id].encode()
        for g in r.groups:
            span = raw[g.start + 1 : g.end + 1]
            assert b"".join(aligner.a.tokens[i] for i in g.a) == span == b"".join(aligner.b.tokens[i] for i in g.b)


def test_a_long_text(aligner, libraries):
    """A text of several segments gives the ids of the whole."""
    text = words(random.Random(2), 3000) * 300
    coded = [aligner.encode(p) for p in aligner.parts(text)]
    assert len(coded) > 2
    assert [i for c in coded for i in c[1]] == libraries[1].encode(text)
