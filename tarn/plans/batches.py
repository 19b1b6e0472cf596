"""Arrow batches of bounded size on their way to a worker, so that what it holds of them does not grow with a table."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches to these, unless they are lower already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
