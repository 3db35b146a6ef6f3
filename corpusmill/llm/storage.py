"""Where intermediate tables go, and joins whose broadcast side is checked first."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: What goes to Python at once: by bytes, so that long texts don't add up, and an executor's memory outside the JVM stays small.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); set here only where it is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, Python gets at most about BATCH_BYTES of rows at once; the session's own setting is back afterwards."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, is computed once, and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on: list[str] | str | Column, how: str, rows: int | None = None) -> DataFrame:
    """left join right; right is broadcast if its counted rows stay within BROADCAST_ROWS, else both are shuffled.

    right must be cheap to count (a written table). Its rows must be narrow.
    """
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def bucket_count(amount: int, per_bucket: int) -> int:
    """Buckets so that each holds about per_bucket; grows with the input."""
    return max(1, -(-int(amount or 0) // per_bucket))
