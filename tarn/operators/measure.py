"""Searches measured one query at a time, and their results kept under everything that they depend on."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans import versioned


def measured_search(search: Callable[[DataFrame], DataFrame], queries: DataFrame, name: str, digest: str, most: int = 100) -> DataFrame:
    """``qid, hits, seconds`` of up to ``most`` queries, smallest ids first, each run by itself after one that warms up.

    ``search`` takes queries ``(qid, query)``. Results stand under ``name`` and ``digest``, the identity of corpus, queries and
    configuration, and are measured again only if that changes. A search that fails leaves no results behind.
    """
    spark = queries.sparkSession

    def build(path: str) -> None:
        asked = [r["qid"] for r in queries.select("qid").orderBy("qid").limit(most).collect()]
        rows = []
        for qid in asked[:1] + asked:
            began = time.perf_counter()
            hits = search(queries.where(F.col("qid") == qid)).count()
            rows.append((qid, hits, time.perf_counter() - began))
        spark.createDataFrame(rows[1:], "qid long, hits long, seconds double").coalesce(1).write.parquet(path)

    return spark.read.parquet(versioned.ensure(spark, name, digest, build))
