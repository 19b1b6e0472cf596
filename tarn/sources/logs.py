"""Readers of append-only JSON logs. Malformed lines are skipped, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HIT = "ts long, kind string, q string, slug string, slugs array<string>, sid string, preceding_q string, src string"
MESSAGE = "type string, isMeta boolean, isSidechain boolean, message struct<content:string>"


def parse_hit_log(lines: DataFrame, column: str) -> DataFrame:
    """Searches (query and slugs) and reads (slug) among JSON lines, other columns kept."""
    j = F.from_json(F.col(column), HIT, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("hit", j).drop(column).select("*", "hit.*").drop("hit")
    read = F.coalesce(F.col("kind") == "read", F.lit(False))
    fine = (read & F.col("slug").isNotNull()) | (~read & F.col("q").isNotNull() & F.col("slugs").isNotNull())
    return rows.where(fine).withColumn("kind", F.when(read, "read").otherwise("search"))


def read_hit_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_hit_log(spark.read.text(path), "value")


def parse_transcript(lines: DataFrame, column: str, limit: int = 500) -> DataFrame:
    """``role, text`` of user and assistant messages; content is a string or a list of blocks, of which text counts."""
    m = F.from_json(F.col(column), MESSAGE)
    rows = lines.withColumn("m", m).where("m.type IN ('user', 'assistant') AND NOT coalesce(m.isMeta, false) AND NOT coalesce(m.isSidechain, false)")
    blocks = F.from_json("m.message.content", "array<struct<type:string,text:string>>")
    listed = F.col("m.message.content").startswith("[")
    text = F.when(listed, F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.col("m.message.content"))
    return rows.withColumns({"role": F.col("m.type"), "text": F.substring(text, 1, limit)}).drop("m", column)


def append_log(rows: DataFrame, path: str, most: int = 5 << 20, keep: int = 1) -> None:
    """Append JSON lines to the folder ``path``; one that holds ``most`` bytes or more is set aside as ``path.1`` first, older ones move on."""
    spark = rows.sparkSession
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(here) and fs.getContentSummary(here).getLength() >= most:
        at = lambda i: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{i}")
        fs.delete(at(keep), True)
        for i in range(keep - 1, 0, -1):
            if fs.exists(at(i)):
                fs.rename(at(i), at(i + 1))
        fs.rename(here, at(1))
    rows.write.mode("append").json(path)
