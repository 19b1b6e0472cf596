"""The registered queries: each binds an operator to the test tables and names the SQL that checks it.

``query(name, sql)`` registers ``f(spark, sf_dir) -> DataFrame``. Column names and types of both sides agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if the operator can be said in SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from tarn.queries import fusion_queries, joins, lexical_queries, memory_queries, metrics_queries, rank_queries, stats_queries, text_queries, vector_queries  # noqa: F401


#: The given tables.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def derived(spark: SparkSession, sf_dir: str, rows: str) -> DataFrame:
    """What a query in parentheses derives from the given tables; it is written once, in the words that both engines share."""
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", rows)]
    text = rows.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(f"SELECT * FROM {text}", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def fixture(spark: SparkSession, rows: str) -> DataFrame:
    """A small catalogue of literals, written once for both engines: ``(VALUES ...) AS t(a, b)``."""
    return spark.sql(f"SELECT * FROM {rows}")
