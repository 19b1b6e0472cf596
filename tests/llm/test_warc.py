import gzip
import hashlib

import pytest

from tarn.llm import warc

BIG = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "é" * 600


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        top = max(same) if len(data) >= 1000 and same else i
        kind = ("response", None) if top == i else ("revisit", top)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), *kind))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(1, "http://a/ b", BIG), (5, None, BIG), (3, "http://c", BIG), (4, "x", None), (6, "y", ""), (7, "z", "short"), (8, "z", "short"), (9, "n", "\r\n\r\nq\r\n\r\n"), (None, "k", "nul\x00l"), (10, "t", "\n" + "b" * 999), (11, "t", "\n" + "b" * 999)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.captures(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    assert all(r.complete for r in got)
    assert warc.captures(pages.limit(0)).count() == 0


def test_blocks_and_foreign_archives(spark, tmp_path):
    def record(kind, rid, block, *heads):
        return ("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *heads, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    parts = [
        record("warcinfo", "w", b"x: y"),
        record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nbody", "Content-Type: application/http;msgtype=response", "WARC-Concurrent-To: <q1>"),
        record("request", "q1", b"GET", "Content-Type: application/http"),
        record("metadata", "m1", b"k: v", "WARC-Concurrent-To: <q1>"),
        record("resource", "r2", b"plain"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    records = warc.read_archives(spark, f"file://{tmp_path}")
    assert records.count() == 5
    got = {r.record_id: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "r2"}
    assert bytes(got["r1"].response.block) == b"body"
    assert got["r1"].request.record_id == "q1"
    assert got["r1"].metadata.record_id == "m1"
    assert got["r2"].request is None
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(parts[1][:-20]))


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Small pages share files, long ones do not; a long text comes back whole. Columns with dots do no harm."""
    monkeypatch.setattr(warc, "SIZES", ((100, 5), (5000, 2), (1 << 62, 1)))
    rows = [(i, "u", "s" * (i % 90), "x") for i in range(40)] + [(100 + i, "u", "m" * (2000 + i), "x") for i in range(9)] + [(200 + i, "u", "l" * (3_000_000 + i), "x") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    most = {}
    for file in tmp_path.glob("w/*/*.gz"):
        n = sum(dict(pairs)["warc-type"] == "response" for pairs, _ in warc.parse(file.read_bytes()))
        most.setdefault(file.parent.name, []).append(n)
    assert {k: (max(v), sum(v)) for k, v in most.items()} == {"to-100": (5, 40), "to-5000": (2, 9), f"to-{1 << 62}": (1, 2)}
    got = {r.page_id: r for r in warc.captures(pages).collect()}
    assert all(got[i].payload_digest == hashlib.sha1(h.encode()).hexdigest() for i, _, h, _ in rows) and len(got) == len(rows)
