"""Work and memory that must not grow faster than the input."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import lexical, vectors


@pytest.mark.parametrize("odd", [False, True])
def test_declarative_search_takes_any_number_of_queries_and_ranks_few_pairs(spark, monkeypatch, odd):
    monkeypatch.setattr(vectors, "MOST_SENT", 7)
    monkeypatch.setattr(vectors, "PAIRS", 0)
    monkeypatch.setattr(vectors, "SAMPLE", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).round(1)
    x[100:260] = x[0]  # a large group of copies
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    if odd:  # vectors of another width, which are nobody's nearest
        corpus = corpus.unionAll(spark.createDataFrame([(1000, [9.0] * 6)], corpus.schema)).withColumn("vector", F.when(F.col("id") < 1000, F.col("vector")).otherwise(F.array(*[F.lit(99.0)] * 6)))
    d = np.sqrt(((x[::20, None] - x[None]) ** 2).sum(2)).round(9)
    want = {(20 * q, int(i), r) for q in range(20) for r, i in enumerate(np.lexsort((np.arange(400), d[q]))[:6])}
    if odd:  # they have no distance, and such come first
        first = {(r["qid"], r["id"]) for r in vectors.knn_sql(asked, corpus, 6).where("distance is null").collect()}
        assert first == {(20 * q, 1000) for q in range(20)}
        want = {(q, i, r + 1) for q, i, r in want if r < 5} | {(q, 1000, 0) for q, _ in first}
    got = {(r["qid"], r["id"], r["rank"]) for r in vectors.knn_sql(asked, corpus, 6).collect()}
    assert got == want
    if not odd:
        assert vectors._near(asked, corpus, 6, 5, 400).count() < 20 * 400 / 4


def _counted(docs: int, each: int) -> list[pa.RecordBatch]:
    """Documents of one segment as counts of ``each`` terms, in two batches."""
    rng = np.random.default_rng(5)
    terms = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    out = []
    for part in np.array_split(np.arange(docs), 2):
        own = np.sort(np.stack([rng.choice(terms, each, replace=False) for _ in part]), 1).ravel()
        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * each)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (own, np.zeros(len(own), np.int8), rng.integers(1, 4, len(own)).astype(np.int32))]
        lengths = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32)), pa.array(rng.integers(1, 99, len(part)).astype(np.int32)))
        out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(part), 7, np.int32)), pa.array(part), lengths, *lists], ["seg", "doc_id", "lengths", "terms", "fields", "tfs"]))
    return out


def test_a_segment_is_inverted_in_slices_of_bounded_size(monkeypatch):
    batches = _counted(4000, 100)
    monkeypatch.setattr(lexical, "SLICE", 1 << 30)
    whole = pa.Table.from_batches(list(lexical._invert(iter(batches), 32)))
    monkeypatch.setattr(lexical, "SLICE", 10_000)
    parts = list(lexical._invert(iter(batches), 32))
    assert pa.Table.from_batches(parts).equals(whole) and whole.num_rows == 3001
    assert max(len(p.column(3).flatten()) for p in parts) < 20_000
    tracemalloc.start()
    for _ in lexical._invert(iter(batches), 32):
        pass
    assert tracemalloc.get_traced_memory()[1] < 40 * 400_000  # bytes a count; all at once they are some hundred
    tracemalloc.stop()


def test_long_documents_make_more_segments(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} " + "long words " * 50 * (i % 3)) for i in range(60)], "id long, content string")
    monkeypatch.setattr(lexical, "TEXT", 4000, raising=False)
    index = lexical.build_index(docs)
    assert index.n == 60 and 7 <= index.segments <= 20
    asked = spark.createDataFrame([(1, "w7"), (1, "long"), (2, "w8")], "qid long, term string")
    got = {(r["qid"], r["rank"], r["doc_id"]) for r in lexical.bm25_topk(asked, index, 3).collect()}
    assert {(1, 0, 7), (2, 0, 8)} <= got and len(got) == 4


def test_segments_hardly_grow_with_the_table():
    each = {n: n / lexical._segments(n, 3300 * n, 12) for n in (50_000, 500_000, 3_000_000)}
    assert each[3_000_000] <= 1.05 * each[500_000] and each[500_000] <= 2 * each[50_000]
    assert 10**10 / lexical._segments(100_000, 10**10, 12) <= 32 << 20


@pytest.mark.parametrize("step", ["index", "search", "score", "fit"])
def test_a_worker_gets_batches_of_bounded_size(spark, step):
    from tarn.operators import rerank

    asked = spark.createDataFrame([(1, "w1")], "qid long, term string")
    index = lexical.build_index(spark.range(50).selectExpr("id", "concat('w', id) AS content"))
    long = spark.range(3000, numPartitions=1).selectExpr("id AS qid", "id AS rank", "'w' AS query", "repeat('w x ', 5000) AS text", "0 AS label")
    for key, most in (("maxRecordsPerBatch", "10000"), ("maxBytesPerBatch", "64MB")):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", most)
    if step == "index":
        lexical.build_index(spark.range(5).selectExpr("id", "'w' AS content"))
    elif step == "search":
        lexical.bm25_topk(asked, index, 1)
    elif step == "score":
        rerank.rerank(long, lambda: lambda pairs: [0.0 for _ in pairs])
    else:
        rerank.LinearModel.fit(long.limit(10))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.get_total_buffer_size()])], ["n", "bytes"])

    got = long.select("text").mapInArrow(sizes, "n long, bytes long").agg(F.max("n"), F.max("bytes"), F.sum("n")).first()
    assert got[0] <= 1000 and got[1] <= 9 << 20 and got[2] == 3000


def test_redaction_runs_a_pattern_only_where_it_may_match(spark):
    rows = [
        "", "plain words only", "-----BEGIN PRIVATE KEY----- no end", "x sk-" + "a1" * 12 + " ghp_" + "b2" * 12, "BeArEr abcdefghijklmnopq and bASIC ABCDEFGHIJKLMNOPQ=", "NTFY.sh/topic_1 ntfy_topic = 'abcdef'",
        "h.a.ts.net", "FD7A:115C:A1E0:1 100.64.0.1 100.1.2.3", "my_Api_Key: 'abcdefgh' PRIVATEKEY=abcdefgh", "a@b.co user@b.co", "Ab1-" * 12 + " " + "z" * 50, "İ TOKEN=abcdefgh KEY", None,
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, t string").repartition(1)
    got = {r["id"]: (r["o"], r["n"]) for r in docs.select("id", text.redact(F.col("t"))[0].alias("o"), text.redact(F.col("t"))[1].alias("n")).collect()}
    assert [got[i][1] for i in range(len(rows))] == [0, 0, 1, 2, 2, 2, 1, 2, 2, 1, 0, 1, None]
    assert got[9][0] == "[REDACTED:email] user@b.co" and got[12][0] is None and got[6][0] == "[REDACTED:tailnet-host]"
    for family, pattern, _ in text.REDACTIONS:  # what tells where a pattern may match holds wherever it does
        told = docs.select(F.col("t").rlike(pattern).alias("does"), text._may_match(F.col("t"), family).alias("may")).where("t is not null")
        assert told.where("does and not may").count() == 0 and told.where("not may").count() > 5
