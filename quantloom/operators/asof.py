"""Backward as-of joins with an availability lag and a staleness limit.

An as-of join is a union of both sides in one window: the last right row at or before
each left row. It needs one shuffle by the key and no interval join. Without a key the
window runs over the distinct base timestamps cut into day buckets, so no task sees a day of
all symbols; the base rows, dealt by their timestamp, take their row from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import interval_seconds


@dataclass(frozen=True)
class ContextSpec:
    name: str
    columns: tuple[str, ...] = ("close",)
    lag: str = "0min"
    max_staleness: str | None = None
    align: str = "asof"
    join_on_symbol: bool = False
    rename: dict = field(default_factory=dict)


def _last_row(base: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """base plus _row, the right side's struct with the largest _avail at or before timestamp; a null value stays null.

    Base rows travel through the window whole: one shuffle, no join back.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in base.columns])
    none = F.lit(None)
    both = base.select(*keys, F.col("timestamp").alias("_t"), F.lit(1).alias("_side"), whole.alias("_base"), none.cast(right.schema["_row"].dataType).alias("_row"))
    both = both.unionByName(right.select(*keys, F.col("_avail").alias("_t"), F.lit(0).alias("_side"), none.cast(both.schema["_base"].dataType).alias("_base"), "_row"))
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_side = 1").select("_base.*", "_row")


def _last_row_global(base: DataFrame, right: DataFrame) -> DataFrame:
    """The same without a key, for the distinct timestamps: inside each day by a window, before it from the last right row of an earlier day."""
    day = lambda c: F.to_date(c).alias("_day")
    stamps = base.select("timestamp").where("timestamp is not null").distinct().withColumn("_day", day("timestamp"))
    here = _last_row(stamps, right.select("_avail", "_row", day("_avail")), ["_day"])
    ends = right.groupBy(day("_avail")).agg(F.max_by("_row", "_avail").alias("_end"))
    days = stamps.select("_day").distinct().join(ends, "_day", "full_outer")
    # One row per calendar day: the carried row of each day is the last of the days before it.
    carried = days.withColumn("_carry", F.last("_end", ignorenulls=True).over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)))
    found = here.join(carried.select("_day", "_carry"), "_day", "left").select("timestamp", F.coalesce("_row", "_carry").alias("_row"))
    return base.join(found, "timestamp", "left").select(*[F.col(f"`{c}`") for c in base.columns], "_row")


def context_join(base: DataFrame, context: DataFrame, spec: ContextSpec) -> DataFrame:
    """base plus the context's columns, <name>_context_timestamp, <name>_effective_lag_minutes and <name>_is_stale.

    A context row is available at its timestamp plus the lag; of rows with one timestamp the
    one with the largest values counts. Values older than max_staleness (by the row's own
    timestamp, strictly) become null, the lag stays.
    """
    lag = interval_seconds(spec.lag) or 0
    limit = interval_seconds(spec.max_staleness)
    out = [spec.rename.get(c, c) for c in spec.columns]
    row = F.struct(F.col("timestamp").alias("_ts"), *[F.col(c).alias(o) for c, o in zip(spec.columns, out, strict=True)])
    keys = ["symbol"] if spec.join_on_symbol else []
    right = context.select(*keys, (F.col("timestamp") + F.expr(f"interval {int(lag * 1_000_000)} microseconds")).alias("_avail"), row.alias("_row"))
    if spec.align == "asof":
        right = right.groupBy(*keys, "_avail").agg(F.max("_row").alias("_row"))
        joined = _last_row(base, right, keys) if keys else _last_row_global(base, right)
    elif spec.align == "exact":
        joined = base.join(right.withColumnRenamed("_avail", "timestamp"), [*keys, "timestamp"], "left")
    else:
        raise ValueError(f"unknown alignment {spec.align!r}")
    ts = F.col("_row._ts")
    age = (F.unix_micros("timestamp") - F.unix_micros(ts)) / 1e6
    stale = F.coalesce(age > limit, F.lit(False)) if limit is not None else F.lit(False)
    cols = {f"{spec.name}_context_timestamp": ts, f"{spec.name}_effective_lag_minutes": age / 60.0, f"{spec.name}_is_stale": stale}
    cols |= {o: F.when(~stale, F.col(f"_row.{o}")) for o in out}
    return joined.withColumns(cols).drop("_row")


def context_joins(base: DataFrame, contexts: dict[str, DataFrame], specs: list[ContextSpec]) -> DataFrame:
    """Every context in turn."""
    return reduce(lambda df, s: context_join(df, contexts[s.name], s), specs, base)


def context_audit(joined: DataFrame, specs: list[ContextSpec]) -> DataFrame:
    """context_name, n_rows, null_rate (the worst column's), stale_rate, mean and max lag: one pass for all contexts."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, s in enumerate(specs):
        nulls = [F.avg(F.col(s.rename.get(c, c)).isNull().cast("double")) for c in s.columns]
        lag = f"{s.name}_effective_lag_minutes"
        aggs.append(F.struct(F.lit(s.name).alias("context_name"), (F.greatest(*nulls) if len(nulls) > 1 else nulls[0]).alias("null_rate"), F.avg(F.col(f"{s.name}_is_stale").cast("double")).alias("stale_rate"), F.avg(lag).alias("mean_effective_lag_minutes"), F.max(lag).alias("max_effective_lag_minutes")).alias(f"s{i}"))
    one = joined.agg(*aggs)
    return one.select("n", F.explode(F.array(*[f"s{i}" for i in range(len(specs))])).alias("s")).select("s.context_name", F.col("n").alias("n_rows"), "s.null_rate", "s.stale_rate", "s.mean_effective_lag_minutes", "s.max_effective_lag_minutes")


def timeframe_join(base: DataFrame, coarse: DataFrame, *columns: str) -> DataFrame:
    """A coarser timeframe's features on the base's rows: the last finished bucket of the symbol."""
    right = coarse.groupBy("symbol", F.col("timestamp").alias("_avail")).agg(F.max(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])).alias("_row"))
    return _last_row(base, right, ["symbol"]).withColumns({c: F.col(f"_row.v{i}") for i, c in enumerate(columns)}).drop("_row")
