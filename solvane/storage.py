"""Where intermediate results go when a plan has to be cut.

Everything is kept in the shared folder that the cluster names in
``spark.checkpoint.dir``, so that losing an executor never loses a result.
A private folder is made only for local sessions, where nothing is named.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its rows were counted and take at most this many bytes.
BROADCAST_BYTES = 8 << 20
# Rows that a task is dealt where a table is dealt by key and what follows stays in that deal.
TASK_ROWS = 500_000
# For the writer of a table whose rows take megabytes: a page for each row, else a hundred share one, and a codec that keeps no buffers of a page's size.
WIDE_ROWS = {"parquet.page.row.count.limit": "1", "compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
WIDTHS = {"boolean": 1, "int": 4, "bigint": 8, "double": 8}


def checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="solvane-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For tables that several later steps scan: they read only the columns they
    need and executors can be lost without computing it again. ``options`` are the writer's.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def rows_at_once(spark: SparkSession, read: int | None = None, sent: int | None = None):
    """What is run inside reads ``read`` rows of a Parquet table at once and sends ``sent`` rows at once to Python.

    For rows of megabytes, of which Spark's usual thousands would fill an executor. Only memory depends on these numbers.
    """
    new = {"spark.sql.parquet.columnarReaderBatchSize": read, "spark.sql.execution.arrow.maxRecordsPerBatch": sent}
    old = {k: spark.conf.get(k) for k, v in new.items() if v}
    for k in old:
        spark.conf.set(k, str(new[k]))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def deal(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to tasks of about TASK_ROWS rows each, so that a task's share does not grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), key)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if ``rows`` rows of numbers stay within BROADCAST_BYTES; else leave the join to Spark.

    A column of varying width has no proven size, so such a table gets no hint.
    """
    widths = [WIDTHS.get(field.dataType.simpleString()) for field in df.schema]
    return F.broadcast(df) if None not in widths and rows * sum(widths) <= BROADCAST_BYTES else df
