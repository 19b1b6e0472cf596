import random

import public_tokenizers
import pyarrow as pa
import pytest

from tarn.llm import counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    """The same vocabulary as a unigram model of a tokenizer library."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + counts.sentencepiece_vocabulary(PATH)
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=counts.MARK, prepend_scheme="always", split=True)
    return t


TEXTS = ["", " ", "  two  spaces ", "▁mark ▁▁ x", "Hello world, it's 2024!", "ünïcödé straße\nline\ttab", "日本語 \U0001f9ea\U0001f9ff\U0001fae0 unknown กข", "aaaaaaaaaaaaaaaaaaaa", "x" * 300]


def test_equals_library(library):
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("abcdefghi  thesné▁\n🙂ဗ") for _ in range(rnd.randrange(120))) for _ in range(400)]
    counter = counts.Counter(counts.sentencepiece_vocabulary(PATH))
    got = counter(pa.array(texts, pa.large_string()))
    for text, n in zip(texts, got):
        assert n == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_ties_take_the_earlier_start():
    # "ab"+"c" and "a"+"bc" score alike, as do three letters: the match that starts first is kept at each end
    c = counts.Counter([(counts.MARK, 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0)])
    assert c.piece(counts.MARK + "abc") == 2
    assert c.piece(counts.MARK + "abq") == 2 + 1
    assert c.piece(counts.MARK + "éé") == 1 + 4


def test_query(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, TEXTS[4]])] + [(None, "a b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counter = counts.Counter(counts.sentencepiece_vocabulary(PATH))
    want = sorted(((i, int(counter(pa.array([t or ""], pa.large_string()))[0])) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, counts.count_tokens(docs, PATH).collect()), key=str) == want
    assert counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_a_long_piece_keeps_a_few_scores():
    """The ring of scores against whole lists, and a piece of three million characters."""
    rnd = random.Random(2)
    vocabulary = [(t, rnd.choice([-1.0, -2.0, -3.0])) for t in {"".join(rnd.choice("abc▁") for _ in range(rnd.randrange(1, 6))) for _ in range(60)}]
    counter = counts.Counter(vocabulary)
    table, worst = dict(vocabulary), min(s for _, s in vocabulary) - 10
    for _ in range(200):
        piece = "".join(rnd.choice("abcé▁") for _ in range(rnd.randrange(1, 40)))
        score, count = [0.0], [0]
        for e in range(1, len(piece) + 1):
            ways = [(score[e - w] + table[piece[e - w : e]], w, count[e - w] + 1) for w in range(1, min(6, e) + 1) if piece[e - w : e] in table]
            if piece[e - 1] not in table:
                ways.append((score[e - 1] + worst, 0.5, count[e - 1] + len(piece[e - 1].encode())))
            best = max(ways, key=lambda w: w[:2])
            score.append(best[0])
            count.append(best[2])
        assert counter.piece(piece) == count[-1], piece
    assert counter.piece("ab" * 1_500_000) > 0
