"""Helpers shared by the corpus operators: table access, the shared folder, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from assurelake.sources.catalog import noted, shuffles_go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir (or the checkpoint folder set on the context).
    Only where neither is set on one machine, as in tests, a folder of our own is set; on a cluster that is
    an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return noted(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends here, its shuffle files go and
    the rows survive a lost executor."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with shuffles_go(spark):
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like `name` that isn't taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(*frames: DataFrame) -> None:
    """Remove the files behind frames made by cut(), once nothing reads them any more."""
    for df in frames:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            drop_path(df.sparkSession, folder)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let tasks hand texts to Python 8 MB at a time, so that memory is bounded whatever their lengths; a
    session that sets a size of its own keeps it."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, size)


def batches(frame: pa.RecordBatch, size: int, column: int = 1):
    """Slices whose texts in `column` hold at most about `size` bytes (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(frame.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < frame.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield frame.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()
