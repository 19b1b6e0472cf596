"""Run files: one line ``qid Q0 doc rank score tag``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "qid string, q0 string, doc string, rank long, score double, tag string"


def write_run(run: DataFrame, path: str, tag: str) -> None:
    """Write ``run (qid, doc, rank, score)``."""
    run.select("qid", F.lit("Q0").alias("q0"), "doc", "rank", "score", F.lit(tag).alias("tag")).write.option("sep", " ").csv(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).option("sep", " ").csv(path)
