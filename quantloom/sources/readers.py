"""Scans: canonical bars, options, parquet, CSV and JDBC sources, and their configuration."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import null_if_nan

NUMERIC = ("open", "high", "low", "close", "volume", "trades_count", "call_volume", "put_volume", "total_open_interest", "call_iv_mid", "put_iv_mid", "put_call_volume_ratio")
CANONICAL = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.TimestampType()), *(T.StructField(n, T.DoubleType()) for n in NUMERIC)])


@dataclass(frozen=True)
class SourceSpec:
    """One entry of a run's configuration."""

    name: str
    table: str
    symbols: tuple[str, ...]
    kind: str = "minute_bars"
    timezone: str = "America/New_York"
    enabled: bool = True
    primary: bool = False
    lag: str = "0min"
    max_staleness: str = ""
    align: str = "asof"
    join_on_symbol: bool = False
    columns: tuple[str, ...] = ("close",)
    rename: dict = field(default_factory=dict)


def inclusive_to_exclusive(end: str) -> str:
    return (date.fromisoformat(end) + timedelta(days=1)).isoformat()


def analysis_window(start: str, end: str) -> tuple[str, str]:
    """Two ISO dates in order."""
    a, b = date.fromisoformat(str(start).strip()), date.fromisoformat(str(end).strip())
    if a > b:
        raise ValueError(f"start {a} is after end {b}")
    return a.isoformat(), b.isoformat()


def complete(df: DataFrame) -> DataFrame:
    """The canonical columns in order: missing ones are null, bad numbers and NaN become null."""
    have = set(df.columns)
    cols = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in CANONICAL.fields]
    out = df.select(*cols)
    return out.select(*[null_if_nan(n).alias(n) if n in NUMERIC else F.col(n) for n in out.columns])


def minute_bars(table: DataFrame, symbols, start: str, end: str) -> DataFrame:
    """Bars of some symbols on the dates start..end (both included); the filter reaches the scan."""
    if not list(symbols):
        raise ValueError("no symbols")
    return complete(table.where(F.col("symbol").isin(*symbols) & (F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") < F.lit(inclusive_to_exclusive(end)).cast("timestamp"))))


def options_summary(table: DataFrame, symbols=None, start: str | None = None, end: str | None = None, timezone: str = "America/New_York", close_hour: int = 16) -> DataFrame:
    """Daily option totals per symbol, stamped at the market's close."""
    if symbols is not None:
        table = table.where(F.col("symbol").isin(*symbols))
    if start is not None:
        table = table.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    call, put = F.col("option_type") == "c", F.col("option_type") == "p"
    iv = (F.col("bid_iv") + F.col("ask_iv")) / 2
    quoted = (F.col("bid_iv") > 0) & (F.col("ask_iv") > 0)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("volume"))), F.lit(0)).cast("double")
    out = table.groupBy("symbol", "trade_date").agg(
        F.sum("volume").cast("double").alias("volume"),
        total(call).alias("call_volume"),
        total(put).alias("put_volume"),
        F.sum("open_interest").cast("double").alias("total_open_interest"),
        F.avg(F.when(call & quoted, iv)).alias("call_iv_mid"),
        F.avg(F.when(put & quoted, iv)).alias("put_iv_mid"),
    )
    stamp = F.to_utc_timestamp(F.col("trade_date").cast("timestamp_ntz").cast("timestamp") + F.expr(f"interval {close_hour} hours"), timezone)
    return complete(out.withColumn("timestamp", stamp).withColumn("put_call_volume_ratio", F.try_divide("put_volume", "call_volume")))


#: kind: function(table, symbols, start, end)
BUILDERS: dict[str, Callable] = {"minute_bars": minute_bars, "options_summary": options_summary}


def load_source(spark: SparkSession, spec: SourceSpec, catalog: dict[str, DataFrame], start: str, end: str) -> DataFrame:
    """A source by its kind, with audit columns; a disabled source is an empty canonical frame."""
    if not spec.enabled:
        return spark.createDataFrame([], CANONICAL)
    if spec.table not in catalog:
        raise ValueError(f"unknown table {spec.table}")
    if spec.kind not in BUILDERS:
        raise ValueError(f"unknown source kind {spec.kind}")
    out = BUILDERS[spec.kind](catalog[spec.table], spec.symbols, start, end)
    return out.withColumns({"source_name": F.lit(spec.name), "source_table": F.lit(spec.table), "source_kind": F.lit(spec.kind), "source_timezone": F.lit(spec.timezone), "source_symbol_count": F.lit(len(spec.symbols))})


def normalize(df: DataFrame, internal_tz: str = "America/New_York", primary: bool = False, alias: str | None = None) -> DataFrame:
    """UTC instant and the zone's wall clock per row, numbers coerced, audit columns."""
    extra = [n for n in df.columns if n not in CANONICAL.names]
    out = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CANONICAL.fields], *extra)
    return out.withColumns({
        "timestamp_utc": F.col("timestamp"),
        "wall_clock": F.convert_timezone(F.lit("UTC"), F.lit(internal_tz), F.col("timestamp").cast("timestamp_ntz")),
        "feature_timezone": F.lit(internal_tz),
        "is_primary_source": F.lit(primary),
        "source_alias": F.lit(alias),
    })


def select_prices(df: DataFrame, symbols=None, start: str | None = None, end: str | None = None, columns=("ticker", "date", "close_price")) -> DataFrame:
    """The columns of the symbols between both dates, which count; the filters are pushed to the scan."""
    df = df.select(*columns)
    if symbols is not None:
        df = df.where(F.col("ticker").isin(*symbols))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("date") <= F.lit(end).cast("date"))


def read_prices(spark: SparkSession, path: str, symbols=None, start: str | None = None, end: str | None = None, columns=("ticker", "date", "close_price")) -> DataFrame:
    """Column-pruned daily closes from Parquet."""
    return select_prices(spark.read.parquet(path), symbols, start, end, columns)


def database_options(env=os.environ) -> dict | None:
    """JDBC options from DB_URL, DB_USER and DB_PASSWORD, or from the CLICKHOUSE_ variables HOST, PORT, USER, PASSWORD, SECURE and VERIFY; None without them.

    SECURE "true" asks for TLS, VERIFY "true" for a checked certificate; both are off by default.
    """
    if env.get("DB_URL"):
        return {"url": env["DB_URL"], "user": env.get("DB_USER", ""), "password": env.get("DB_PASSWORD", "")}
    need = [f"CLICKHOUSE_{k}" for k in ("HOST", "PORT", "USER", "PASSWORD")]
    if any(k not in env for k in need):
        return None
    host, port, user, password = (env[k] for k in need)
    on = lambda k: env.get(f"CLICKHOUSE_{k}", "false").lower() == "true"
    return {"url": f"jdbc:clickhouse://{host}:{int(port)}", "user": user, "password": password, "ssl": str(on("SECURE")).lower(), "sslmode": "strict" if on("VERIFY") else "none"}


def read_jdbc(spark: SparkSession, table: str, **options) -> DataFrame:
    """A table of the database that the environment names; options override or add to those of the connection."""
    found = database_options()
    if found is None and "url" not in options:
        raise KeyError("no database is named by DB_URL or by CLICKHOUSE_HOST, PORT, USER and PASSWORD")
    return spark.read.format("jdbc").options(**{"dbtable": table, **(found or {}), **options}).load()


def read_prices_or_database(spark: SparkSession, path: str, table: str = "daily_prices", **kw) -> DataFrame:
    """The database where its credentials are set, else Parquet: the same columns, symbols and dates either way."""
    return read_prices(spark, path, **kw) if database_options() is None else select_prices(read_jdbc(spark, table), **kw)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidate table from CSV, dates parsed, plus inception_year."""
    df = spark.read.option("header", True).csv(path)
    num = [n for n in df.columns if n.startswith("vol_")]
    return df.withColumns({n: F.col(n).try_cast("double") for n in num} | {"start_date": F.try_to_date("start_date")}).withColumn("inception_year", F.year("start_date"))


def read_config(path: str, **overrides) -> tuple[dict, list[SourceSpec], list[SourceSpec]]:
    """(run settings, primary sources, context sources) of a TOML file; overrides replace run settings."""
    with open(path, "rb") as f:
        conf = tomllib.load(f)
    run = conf.get("run", {}) | {k: v for k, v in overrides.items() if v is not None}
    specs = []
    for key, primary in (("primary_sources", True), ("context_sources", False)):
        for s in conf.get(key, []):
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in s.items() if k in SourceSpec.__dataclass_fields__}
            specs.append(SourceSpec(**known | {"primary": primary}))
    return run, [s for s in specs if s.primary], [s for s in specs if not s.primary]


def missing_artifacts(paths) -> list[str]:
    return sorted(p for p in paths if not os.path.exists(p))
