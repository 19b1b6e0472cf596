"""Standing results in versioned folders: built once for what they derive from, published whole, rebuilt when that changes.

A version is named by a digest of its inputs (files, their lengths and times of change) and parameters. It is written
under a name of its own and renamed when it is complete, so readers see a whole version or none, a builder that dies
leaves nothing that is read, and of two that build at once one wins and the other takes the winner's.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.plans.scratch import remove, shared_dir


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def identity(table: DataFrame, *parameters) -> str:
    """Digest of the files that ``table`` is read from, and of what else a version depends on."""
    seen = hashlib.sha256(repr(parameters).encode())
    for name in sorted(table.inputFiles()):
        fs, path = _files(table.sparkSession, name)
        status = fs.getFileStatus(path)
        seen.update(f"{name}\0{status.getLen()}\0{status.getModificationTime()}\n".encode())
    return seen.hexdigest()[:32]


def versions(spark: SparkSession, name: str) -> list[str]:
    """Complete versions of ``name``, the latest first."""
    fs, root = _files(spark, f"{shared_dir(spark)}/tarn/{name}")
    found = [s for s in (fs.listStatus(root) if fs.exists(root) else []) if not s.getPath().getName().startswith(".")]
    return [s.getPath().toString() for s in sorted(found, key=lambda s: (-s.getModificationTime(), s.getPath().getName()))]


def ensure(spark: SparkSession, name: str, digest: str, build: Callable[[str], None], keep: int = 4) -> str:
    """The folder of version ``digest`` of ``name``; ``build(path)`` makes it if it is not there.

    Versions beyond the ``keep`` latest are deleted once a new one is published.
    """
    root = f"{shared_dir(spark)}/tarn/{name}"
    fs, final = _files(spark, f"{root}/{digest}")
    if not fs.exists(final):
        building = f"{root}/.{uuid.uuid4().hex}"
        build(building)
        _, made = _files(spark, building)
        if fs.exists(final) or not fs.rename(made, final):
            remove(spark, building)
        for old in versions(spark, name)[keep:]:
            if not old.endswith(digest):
                remove(spark, old)
    return f"{root}/{digest}"


def run_blocks(spark: SparkSession, name: str, blocks: dict[str, str], work: Callable[[str], DataFrame]) -> DataFrame:
    """The rows of ``work(block)`` over all ``blocks``, which map their names to digests of what they depend on.

    A block that was finished is read, not run: its version folder is the receipt. After a failure the next call goes on where
    this one stopped. Versions of a block that its digest has left behind go.
    """
    done = [spark.read.parquet(ensure(spark, f"{name}/{b}", digest, lambda path, b=b: work(b).write.parquet(path), keep=1)) for b, digest in blocks.items()]
    return functools.reduce(DataFrame.unionByName, done)
