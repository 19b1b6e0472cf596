"""Notes as files: what is pushed to the listing, and that a write is whole or not there."""

import os

import pytest
from pyspark.sql import functions as F

from tarn.sources import notes as N


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f"n{i}" if i % 3 else f"deep/n{i}", f"---\ntitle: T{i}\n---\nbody é {i}") for i in range(40)] + [("empty", None)]
    path = f"file://{tmp_path}/notes"
    N.write_notes(spark.createDataFrame(rows, "slug string, content string").repartition(3), path)
    return path, dict(rows), tmp_path


def test_round_trip(spark, folder):
    path, rows, _ = folder
    got = {r.path.split("/", 1)[1]: r for r in N.read_notes(spark, path).collect()}
    assert {k: r.content for k, r in got.items()} == {f"{s}.md": c or "" for s, c in rows.items()}
    assert got["deep/n3.md"].slug == "n3" and got["n1.md"].size == len(rows["n1"].encode())


def test_conditions_are_taken_at_the_listing(spark, folder):
    path, rows, _ = folder
    reader = N.NotesReader({"path": path, "splitBytes": str(3 * N.OPEN_BYTES)})
    assert len(reader.partitions()) > 10
    some = N.read_notes(spark, path).where("path LIKE '%/deep/%' AND size > 0")
    assert {r.slug for r in some.collect()} == {s[5:] for s in rows if s.startswith("deep/")}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (size" in plan and "Contains(path" not in plan  # what the listing tells is not tested again
    left = list(reader.pushFilters([N.ds.StringContains(("path",), "deep"), N.ds.GreaterThan(("size",), 0), N.ds.EqualTo(("slug",), "n3")]))
    assert [type(f) for f in left] == [N.ds.GreaterThan]
    assert [f[0].split("/")[-1] for p in reader.partitions() for f in p.files] == ["n3.md"]


def test_modified_since(spark, folder):
    path, rows, tmp = folder
    for top, _, names in os.walk(tmp / "notes"):
        for name in names:
            os.utime(f"{top}/{name}", (1_600_000_000, 1_600_000_000 + int(name == "n7.md")))
    since = N.read_notes(spark, path).where(F.col("modified") > F.timestamp_seconds(F.lit(1_600_000_000)))
    assert [r.slug for r in since.collect()] == ["n7"]


def test_an_aborted_write_leaves_nothing(spark, folder):
    path, rows, tmp = folder
    bad = spark.range(40).repartition(4).selectExpr("if(id = 33, '../out', concat('x', id)) AS slug", "'new' AS content")
    with pytest.raises(Exception, match="no name for a note"):
        N.write_notes(bad, path)
    assert {r.content for r in N.read_notes(spark, path).collect()} == {c or "" for c in rows.values()}
    assert os.listdir(tmp) == ["notes"]


def test_append_and_overwrite(spark, folder):
    path, rows, tmp = folder
    more = spark.createDataFrame([("later", "x")], "slug string, content string")
    N.write_notes(more, path, "append")
    assert N.read_notes(spark, path).count() == len(rows) + 1
    N.write_notes(more, path)
    assert [r.slug for r in N.read_notes(spark, path).collect()] == ["later"]
    N.write_notes(more.limit(0), path)
    assert N.read_notes(spark, path).count() == 0 and N.read_notes(spark, f"file://{tmp}/nowhere").count() == 0
    assert os.listdir(tmp) == ["notes"]
