"""Tables that cut lineage, written where every executor can read them.

``spark.checkpoint.dir`` names the shared folder. It is read from the session; where it is unset this module falls
back to a folder of its own, in local mode alone: on a cluster no other machine would see it, so that raises.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session, without a trailing slash."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tarn-checkpoints")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tarn/run-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages restart from the files.

    A lost executor costs the tasks that were running, not the lineage above this point.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(table: DataFrame, most: int = 64 << 20) -> DataFrame:
    """``table``, a written one, marked for broadcast if its files hold ``most`` bytes or fewer; it is joined by its keys otherwise."""
    total = 0
    for name in table.inputFiles():
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return F.broadcast(table) if total <= most else table


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Results that still read them must have been written before."""
    remove(spark, _own(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, whatever store it is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
