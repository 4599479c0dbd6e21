"""Market sessions on the exchange's wall clock and one row of primitives per symbol and session date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import ratio

# Minutes of the exchange's day at which the sessions begin and end.
PREMARKET, REGULAR, POSTMARKET, NIGHT = 240, 570, 960, 1200
SESSIONS = ("overnight", "premarket", "regular", "postmarket")
FIELDS = ("open", "high", "low", "close", "volume", "trades_count")


def classify(bars: DataFrame, timezone: str = "America/New_York") -> DataFrame:
    """bars plus session_date and market_session; bars from the night's start on belong to the next date."""
    wall = F.convert_timezone(F.lit("UTC"), F.lit(timezone), F.col("timestamp").cast("timestamp_ntz"))
    minute = F.hour("_wall") * 60 + F.minute("_wall")
    session = F.when((minute >= PREMARKET) & (minute < REGULAR), "premarket").when((minute >= REGULAR) & (minute < POSTMARKET), "regular").when((minute >= POSTMARKET) & (minute < NIGHT), "postmarket").otherwise("overnight")
    date = F.to_date("_wall")
    return bars.withColumn("_wall", wall).withColumns({"session_date": F.when(minute >= NIGHT, F.date_add(date, 1)).otherwise(date), "market_session": session}).drop("_wall")


def primitives(classified: DataFrame) -> DataFrame:
    """One conditional aggregate for all four sessions (no chain of outer joins), then neighbours by symbol.

    first and last skip nulls; sums of nothing are 0 for sessions with bars and NULL for
    sessions without. prior and next are the neighbouring rows of the symbol.
    """
    have = set(classified.columns)
    aggs = []
    for s in SESSIONS:
        here = F.col("market_session") == s
        col = lambda n: F.when(here, F.col(n) if n in have else F.lit(None).cast("double"))  # noqa: B023, E731
        seen = lambda n: F.when(col(n).isNotNull(), F.col("timestamp"))  # noqa: B023, E731
        any_bar = F.max(here)
        total = lambda n: F.when(any_bar, F.coalesce(F.sum(col(n)), F.lit(0.0)))  # noqa: B023, E731
        aggs += [
            F.min_by(col("open"), seen("open")).alias(f"{s}_open"), F.max(col("high")).alias(f"{s}_high"), F.min(col("low")).alias(f"{s}_low"),
            F.max_by(col("close"), seen("close")).alias(f"{s}_close"), total("volume").alias(f"{s}_volume"), total("trades_count").alias(f"{s}_trades_count"),
            F.when(any_bar, F.count(F.when(here, 1))).alias(f"{s}_bar_count"), F.min(F.when(here, F.col("timestamp"))).alias(f"{s}_start_timestamp"), F.max(F.when(here, F.col("timestamp"))).alias(f"{s}_end_timestamp"),
        ]
    g = classified.groupBy("symbol", "session_date").agg(*aggs)
    g = g.withColumns({"regular_return": ratio("regular_close", "regular_open") - 1, "premarket_return": ratio("premarket_close", "premarket_open") - 1})
    w = W.partitionBy("symbol").orderBy("session_date")
    g = g.withColumns({f"prior_regular_{n}": F.lag(f"regular_{n}").over(w) for n in ("close", "open", "high", "low", "volume", "return")} | {f"next_regular_{n}": F.lead(f"regular_{n}").over(w) for n in ("close", "open", "volume")} | {"next_regular_close_timestamp": F.lead("regular_end_timestamp").over(w)})
    return g.withColumns({
        "prior_regular_range": ratio(F.col("prior_regular_high") - F.col("prior_regular_low"), "prior_regular_close"),
        "overnight_gap": ratio("regular_open", "prior_regular_close") - 1,
        "asof_timestamp": F.coalesce("regular_end_timestamp", "postmarket_end_timestamp"),
        "has_regular_session": F.coalesce("regular_bar_count", F.lit(0)) > 0,
    })


def attach(classified: DataFrame, prims: DataFrame) -> DataFrame:
    return classified.join(prims.drop("asof_timestamp"), ["symbol", "session_date"], "left")


def regular_bars(df: DataFrame) -> DataFrame:
    return df.where("market_session = 'regular'")
