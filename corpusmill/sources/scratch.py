"""Where tables go that a job writes for itself: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a local session without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: What goes to Python at once where rows are whole blocks: an executor's memory outside the JVM stays small.
BLOCK_BYTES, _BATCH = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and there if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_blocks(df: DataFrame, name: str) -> DataFrame:
    """`stored`, with BLOCK_BYTES of rows at once to Python; the session's own setting is back afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, BLOCK_BYTES)
    try:
        return stored(df, name)
    finally:
        conf.set(_BATCH, before)
