import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarn.llm import bpe, packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = ["", " ", "\n \n", "a" * 700, " " * 300, "日本語。テスト、" * 40, "x <|endoftext|> y<|endoftext|>", "é" * 99, "🙂 " * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_vocabulary_equals_the_library(library):
    own, rnd = bpe.ByteBPE(PATH, PATTERN, packing.LEAF), random.Random(1)
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    texts = ODD + ["".join(rnd.choice("ab '\n\t1,sretlv!。é  ") for _ in range(rnd.randrange(400))) for _ in range(300)]
    for text in texts:
        assert own.encode_special(text) == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.encode(text) == plain.encode(text, add_special_tokens=False).ids, repr(text)
        assert b"".join(own.tokens[i] for i in own.encode(text)) == text.encode()


def held(rows, capacity):
    """Sequences without gaps, documents without loss; tokens of padding, and how many sequences are short."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in rows:
        by_sequence[sequence].append((offset, length))
        by_doc[doc].append((start, length))
    padding = short = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        short += at < capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for parts in by_doc.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    return padding, short


@pytest.mark.parametrize("capacity", [1, 2, 8, 1024])
def test_places(capacity):
    rnd = np.random.default_rng(capacity)
    packer, rows, total = packing.Packer(capacity, 3), [], 0
    for block in range(6):
        lengths = rnd.integers(1, 4 * capacity + 2, 50 if block else 0)
        doc, of, start, size = packer.pieces(lengths)
        assert size.tolist() == (capacity >> of).tolist() and size.sum() == lengths.sum()
        total += int(lengths.sum())
        table = pa.table({"doc": pa.array(doc + 1000 * block), "start": pa.array(start), "length": pa.array(size), "class": pa.array(of)})
        rows += packer.place(table).to_pylist()
        assert not packer._open or len(packer._open[0]) < 2 * capacity
    rows += packer.close().to_pylist()
    padding, short = held([tuple(r[k] for k in ("doc", "start", "length", "sequence_id", "offset")) for r in rows], capacity)
    assert padding == 0 and short <= capacity.bit_length() - 1
    assert sum(r["length"] for r in rows) == total
    assert all(r["sequence_id"] >> 40 == 3 for r in rows)
    assert packing.Packer(capacity, 0).close() is None


def test_capacity_is_a_power_of_two():
    with pytest.raises(ValueError):
        packing.Packer(1000, 0)


def test_pieces_hold_the_librarys_ids(spark, library):
    rnd = random.Random(7)
    texts = [*ODD, None, ODD[5]] + [" ".join(rnd.choice(["the", "ship", "é", "1234", "\n"]) for _ in range(rnd.randrange(3000))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, `sequence.id` int").repartition(3)
    rows = packing.pack(docs, PATH, PATTERN).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.ids, r.doc_tokens, r.length))
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert b"".join(part for _, part, *_ in sorted(got[i])) == struct.pack(f"<{len(ids)}I", *ids)
        assert {n for _, _, n, _ in got[i]} == {len(ids)} and all(len(b) == 4 * n for _, b, _, n in got[i])
    padding, short = held([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], 1024)
    assert padding == 0 and short <= 3 * 10
    assert packing.pack(docs.limit(0), PATH, PATTERN).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b"), (5, "x"), (5, "x")], "doc_id long, text string").repartition(1)
    assert sorted(packing.pack(nulls, PATH, PATTERN).toPandas().length.tolist()) == [1, 1, 2, 2, 2]


def test_assembled(spark):
    texts = [(i, "the ship " * (37 * i % 900)) for i in range(60)]
    packed = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), PATH, PATTERN)
    whole = packing.assemble(packed).collect()
    assert all(r.padded == r.length == len(r.ids) // 4 for r in whole)
    assert sum(r.length for r in whole) == packed.agg({"length": "sum"}).first()[0]
    one = next(r for r in packed.collect() if r.offset == 0 and r.length < 1024)
    sequence = next(r for r in whole if r.sequence_id == one.sequence_id)
    assert zlib.crc32(sequence.ids[: 4 * one.length]) == zlib.crc32(one.ids)
