import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from tarn.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    import base64

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n \n", "'", "it's we're I'll", "''re", "a" * 700, " " * 300, "日本語。テスト、" * 40, "x y\u0085z ", "<|endoftext|>", "\x1c a\x1d b", "é" * 99, "🙂 " * 50]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_tree_equals_whole(plain, leaf):
    tree = bpe.ByteBPE(RANKS, PATTERN, leaf)
    rnd = random.Random(leaf)
    texts = ODD + ["".join(rnd.choice("ab '\n\t1,sretlv!。é  ") for _ in range(rnd.randrange(400))) for _ in range(150)]
    for text in texts:
        ids = tree.encode(text)
        assert ids == plain.encode_ordinary(text), repr(text)
        assert tree.decode(ids) == text.encode()


PARTS = ["a", "b", "the", "é", "日本", "'", "'s", "'ll", "!!", "1", "23", " ", "  ", "\n", "\u3000", "😀", "\x1c", "\u0300", "，", "ß", "٣", "Ⅷ", "\U0002ebf1", "\u0378"]


def test_narrow_windows(plain, monkeypatch):
    """Windows of two characters, so that tokens inside runs have to be proven stable."""
    monkeypatch.setattr(bpe, "WINDOW", 2)
    tree, rnd = bpe.ByteBPE(RANKS, PATTERN, 8), random.Random(9)
    for _ in range(1500):
        few = rnd.sample(PARTS, rnd.choice([1, 2, 3, len(PARTS)]))
        text = "".join(rnd.choice(few) for _ in range(rnd.randrange(300)))
        tree.leaf = rnd.choice([1, 3, 8, 20])
        assert tree.encode(text) == plain.encode_ordinary(text), repr(text)


def test_very_long_runs(plain):
    """Runs that the whole-text encoder cannot take, or only just; white space against what its parts make."""
    tree = bpe.ByteBPE(RANKS, PATTERN)
    for text in ["a" * 300_000, "日本語文字" * 40_000, "-" * 100_000 + "'s", "".join(random.Random(1).choice("abcXYZ019+/") for _ in range(200_000))]:
        assert tree.encode(text) == plain.encode_ordinary(text)
    ids = tree.encode("x" + " " * 3_000_000 + "y")
    space = plain._core_bpe.encode_single_piece(b" " * 2_999_999)
    assert ids == [*plain.encode_ordinary("x"), *space, *plain.encode_ordinary(" y")]
    assert tree.decode(ids) == b"x" + b" " * 3_000_000 + b"y"


def test_query_columns(spark, plain):
    rows = [(i, t, "other") for i, t in enumerate([*ODD, None, ODD[4]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, PATTERN).collect()}
    for i, text, _ in rows:
        ids = plain.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0
