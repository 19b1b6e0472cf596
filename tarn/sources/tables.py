"""Bindings of the test tables to the engine's logical tables. Columns are pruned at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.scratch import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, slug, title, heading, content``: a document is a section of the note ``lang-source``."""
    d = table(spark, sf_dir, "documents")
    slug = F.concat_ws("-", "lang", "source")
    return d.select(F.col("doc_id").alias("id"), slug.alias("slug"), F.concat(F.lit("Note "), slug).alias("title"), F.col("lang").alias("heading"), F.col("text").alias("content"))


SECTIONS_SQL = "(SELECT doc_id AS id, lang || '-' || source AS slug, 'Note ' || lang || '-' || source AS title, lang AS heading, text AS content FROM documents)"


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, query``: every benchmark item's whole text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


TEXT_QUERIES_SQL = "(SELECT item_id AS qid, text AS query FROM benchmark)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vector array<double>, label``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


VECTORS_SQL = "(SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings)"


def containment_qrels(spark: SparkSession, sf_dir: str, most: int = 6) -> DataFrame:
    """``qid, doc_id, grade``: documents that hold a benchmark passage whole, as a scratch table.

    A passage is compared only with documents that hold the words after its first in a row, ``most`` of them or as many as it
    has before its last (the outer two may touch other text), so the join is an equi-join on a shingle and no cross product. Passages
    of one or two words are looked for in every document.
    """
    words = lambda c: F.split(c, "[ \n]")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"), words(F.col("text")).alias("w"))
    b = cut(b.withColumn("k", F.least(F.size("w") - 2, F.lit(most))), "passages")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = d.select("doc_id", words(F.col("text")).alias("w"))
    pairs = d.join(F.broadcast(b.where("k < 1")) if b.where("k < 1").count() <= 10_000 else b.where("k < 1"), F.contains("text", F.col("passage"))).select("qid", "doc_id")
    for k in sorted(r["k"] for r in b.where("k >= 1").select("k").distinct().collect()):
        asked = b.where(F.col("k") == k).select("qid", "passage", F.xxhash64(F.slice("w", 2, k)).alias("g"))
        found = split.where(F.size("w") >= k).select("doc_id", F.explode(_grams(k)).alias("g")).join(asked.select("qid", "g"), "g").select("doc_id", "qid").distinct()
        whole = found.join(asked.select("qid", "passage"), "qid").join(d, "doc_id").where(F.contains("text", F.col("passage")))
        pairs = pairs.unionByName(whole.select("qid", "doc_id"))
    return cut(pairs.select("qid", "doc_id", F.lit(1).cast("long").alias("grade")), "qrels")


def _grams(k: int) -> Column:
    """Hashes of each ``k`` words in a row of ``w``."""
    return F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(F.slice("w", i + 1, k)))


QRELS_SQL = "(SELECT item_id AS qid, doc_id, 1::BIGINT AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
