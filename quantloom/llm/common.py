"""Shared helpers: written tables that cut lineage, worker state, Arrow streaming."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where that is unset, a temporary one in local mode and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        found = getattr(df, "written_path", None)
        if found:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Remove the tables that written() has left in the shared folder, once no DataFrame reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quantloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state() -> dict:
    """A dict that lives as long as the Python worker process (functions are pickled by value)."""
    m = sys.modules.get("_quantloom_worker_state")
    if m is None:
        m = types.ModuleType("_quantloom_worker_state")
        m.state = {}
        sys.modules["_quantloom_worker_state"] = m
    return m.state


def column(df: DataFrame, name: str, kind: str):
    """df's column, or typed nulls where a table lacks it."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name)


def text_slices(batch, text_index: int, limit: int = 4 << 20):
    """Split an Arrow batch so that a slice holds about `limit` text bytes at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < n:
        base = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(a, b - a)
        a = b
