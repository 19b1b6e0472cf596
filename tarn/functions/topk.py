"""Top-k of each group. The limit is put on the row number itself, which lets Spark prune before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(rows: DataFrame, k: int, *order, by: str = "qid", name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every ``by``, numbered from zero in ``name``."""
    n = "row number"
    numbered = rows.withColumn(n, F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return numbered.where(F.col(n) <= k).withColumn(name, (F.col(n) - 1).cast("long")).drop(n)
