"""Sinks: CSV with fixed decimals, Parquet, and the artifact bundle of a feature run."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_run_tag(folder: str, day: str) -> str:
    """day_001, day_002, ... after the tags that the folder's files carry."""
    used = [int(m[1]) for f in (os.listdir(folder) if os.path.isdir(folder) else []) if (m := re.search(rf"{day}_(\d{{3}})", f))]
    return f"{day}_{max(used, default=0) + 1:03d}"


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV part files with a header; doubles with a fixed number of decimals if asked for."""
    if decimals is not None:
        df = df.select(*[F.format_string(f"%.{decimals}f", F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_daily(df: DataFrame, path: str) -> DataFrame:
    """Parquet, clustered by date range; returns the verification row."""
    df.repartitionByRange("date").sortWithinPartitions("ticker", "date").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return verification(df.sparkSession.read.parquet(path))


def verification(df: DataFrame) -> DataFrame:
    """Rows, tickers, first and last date."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def write_bundle(folder: str, tables: dict[str, DataFrame], config: dict) -> None:
    """Each table as Parquet (and small audits as CSV), the configuration as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        if name.endswith(("manifest", "audit")):
            write_csv(df, f"{folder}/{name}.csv")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(config, default=str),)], "value string").write.mode("overwrite").text(f"{folder}/config.json")
