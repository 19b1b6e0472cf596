"""Standing results: found again as long as what they derive from stays, made anew when it changes."""

import uuid

from pyspark.sql import functions as F

from tarn.plans import versioned
from tarn.plans.scratch import scratch_path


def test_rebuild_decision(spark):
    path, name, built = scratch_path(spark, "source"), f"probe-{uuid.uuid4().hex}", []

    def ensure(*parameters):
        before = len(built)
        source = spark.read.parquet(path)
        versioned.ensure(spark, name, versioned.identity(source, *parameters), lambda to: (built.append(to), source.write.parquet(to)))
        return len(built) > before

    spark.range(5).write.parquet(path)
    assert ensure() and not ensure()
    spark.range(3).write.mode("append").parquet(path)
    assert ensure() and ensure("other parameters") and not ensure("other parameters")


def test_blocks_are_resumed(spark):
    name, ran = f"probe-{uuid.uuid4().hex}", []

    def work(block):
        ran.append(block)
        return spark.range(25).where(F.col("id") % 3 == int(block))

    for digests, executed in (("aaa", 3), ("aaa", 0), ("aab", 1)):
        ran.clear()
        assert versioned.run_blocks(spark, name, {str(i): f"{i}-{d}" for i, d in enumerate(digests)}, work).count() == 25
        assert len(ran) == executed
