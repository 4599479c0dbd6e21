"""Rolling features by symbol, resampling, cross-sectional transforms and forward labels, with their registries.

A registry entry is a function from a specification to a Column, so a run is one plan with
shared windows: one shuffle by symbol for the features, one by timestamp for the cross-section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import log_return, null_if_nan, percent_rank_average, ratio, right_bucket, rolling
from .asof import timeframe_join

KEY, ORDER = ["symbol"], ["timestamp"]


def require(df: DataFrame, *columns: str) -> None:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {gone}")


def resample(bars: DataFrame, minutes: int) -> DataFrame:
    """Right-closed, right-labelled OHLCV buckets."""
    have = bars.columns
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("double")
    seen = lambda n: F.when(col(n).isNotNull(), F.col("timestamp"))
    return bars.groupBy("symbol", right_bucket("timestamp", 60 * minutes).alias("bucket")).agg(F.min_by(col("open"), seen("open")).alias("open"), F.max(col("high")).alias("high"), F.min(col("low")).alias("low"), F.max_by(col("close"), seen("close")).alias("close"), F.coalesce(F.sum(col("volume")), F.lit(0.0)).alias("volume")).withColumnRenamed("bucket", "timestamp")


# --- features: function(specification) -> Column ---


def feature_log_return(s: dict) -> Column:
    return log_return(F.col(s.get("column", "close")), KEY, ORDER, int(s.get("window", 1)))


def feature_realized_volatility(s: dict) -> Column:
    return rolling(F.stddev_samp("_r"), "_r", KEY, ORDER, int(s["window"]))


def feature_range(s: dict) -> Column:
    return rolling(F.avg("_range"), "_range", KEY, ORDER, int(s["window"]))


def feature_relative_return(s: dict) -> Column:
    n = int(s.get("window", 1))
    return log_return(F.col("close"), KEY, ORDER, n) - log_return(F.col(s["benchmark"]), KEY, ORDER, n)


def _benchmark_return(s: dict) -> str:
    """The input column with the returns of a specification's own benchmark."""
    return f"`_b {s['benchmark']}`"


def feature_beta_residual(s: dict) -> Column:
    """The return less beta times the benchmark's; beta from the last n pairs of rows."""
    n = int(s["window"])
    w = W.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(-(n - 1), 0)
    b = F.col(_benchmark_return(s))
    pair = F.col("_r").isNotNull() & b.isNotNull()
    full = F.count(F.when(pair, 1)).over(w) == n
    beta = ratio(F.covar_samp(F.when(pair, F.col("_r")), F.when(pair, b)).over(w), F.var_samp(b).over(w))
    return F.when(full, F.col("_r") - beta * b)


def feature_liquidity_surprise(s: dict) -> Column:
    return ratio("volume", rolling(F.avg("volume"), "volume", KEY, ORDER, int(s["window"]))) - 1


def feature_rsi(s: dict) -> Column:
    """Simple-mean relative strength; no losses gives NULL."""
    n = int(s["window"])
    up, down = rolling(F.avg("_up"), "_up", KEY, ORDER, n), rolling(F.avg("_down"), "_down", KEY, ORDER, n)
    return 100 - 100 / (1 + F.try_divide(up, down))


def feature_level(s: dict) -> Column:
    return F.col(s["column"])


def feature_session_return_from_open(s: dict) -> Column:
    return ratio("close", "regular_open") - 1


FEATURES = {
    "log_return": feature_log_return,
    "session_return_from_open": feature_session_return_from_open,
    "overnight_gap": lambda s: F.col("overnight_gap"),
    "prior_session_return": lambda s: F.col("prior_regular_return"),
    "prior_session_range": lambda s: F.col("prior_regular_range"),
    "realized_volatility": feature_realized_volatility,
    "range": feature_range,
    "level": feature_level,
    "relative_return": feature_relative_return,
    "beta_residual": feature_beta_residual,
    "liquidity_surprise": feature_liquidity_surprise,
    "rsi": feature_rsi,
}


def with_inputs(df: DataFrame, specs: list[dict]) -> DataFrame:
    """The derived inputs (leading underscore) the specifications need, computed once."""
    kinds = {s["kind"] for s in specs}
    cols = {}
    if kinds & {"realized_volatility", "beta_residual"}:
        cols["_r"] = log_return(F.col("close"), KEY, ORDER)
    if "range" in kinds:
        cols["_range"] = ratio(F.col("high") - F.col("low"), "close")
    for s in specs:
        if s["kind"] == "beta_residual":
            cols[_benchmark_return(s)[1:-1]] = log_return(F.col(s["benchmark"]), KEY, ORDER)
    if "rsi" in kinds:
        d = F.col("close") - F.lag("close").over(W.partitionBy(*KEY).orderBy(*ORDER))
        cols |= {"_up": F.greatest(d, F.lit(0.0)), "_down": F.greatest(-d, F.lit(0.0))}
        cols = {k: F.when(d.isNotNull(), v) if k in ("_up", "_down") else v for k, v in cols.items()}
    return df.withColumns(cols) if cols else df


def run_features(bars: DataFrame, specs: list[dict]) -> DataFrame:
    """bars plus one column per specification: {name, kind, window?, column?, benchmark?, timeframe? (minutes)}."""
    unknown = sorted({s["kind"] for s in specs} - set(FEATURES))
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    own = [s for s in specs if not s.get("timeframe")]
    out = with_inputs(bars, own)
    out = out.withColumns({s["name"]: FEATURES[s["kind"]](s) for s in own}) if own else out
    out = out.drop("_r", "_range", "_up", "_down", *[_benchmark_return(s)[1:-1] for s in own if s["kind"] == "beta_residual"])
    # One resampling and one join for all features of a timeframe.
    for minutes in dict.fromkeys(int(s["timeframe"]) for s in specs if s.get("timeframe")):
        mine = [s for s in specs if s.get("timeframe") and int(s["timeframe"]) == minutes]
        coarse = with_inputs(resample(bars, minutes), mine)
        out = timeframe_join(out, coarse.select("symbol", "timestamp", *[FEATURES[s["kind"]](s).alias(s["name"]) for s in mine]), *[s["name"] for s in mine])
    return out


# --- cross-section by timestamp: function(specification) -> Column ---

AT = ["timestamp"]


def xs_zscore(s: dict) -> Column:
    w = W.partitionBy(*AT)
    x = F.col(s["column"])
    return ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def xs_percentile_rank(s: dict) -> Column:
    return percent_rank_average(F.col(s["column"]), AT)


def xs_benchmark_residual(s: dict) -> Column:
    x = F.col(s["column"])
    return x - F.max(F.when(F.col("symbol") == s["benchmark"], x)).over(W.partitionBy(*AT))


def xs_peer_group_demean(s: dict) -> Column:
    g, x = F.col(s.get("group", "peer_group")), F.col(s["column"])
    return F.when(g.isNotNull(), x - F.avg(x).over(W.partitionBy(*AT, g)))


CROSS_SECTION = {"zscore": xs_zscore, "percentile_rank": xs_percentile_rank, "benchmark_residual": xs_benchmark_residual, "peer_group_demean": xs_peer_group_demean}


def run_cross_section(df: DataFrame, specs: list[dict]) -> DataFrame:
    unknown = sorted({s["kind"] for s in specs} - set(CROSS_SECTION))
    if unknown:
        raise ValueError(f"unknown transforms: {unknown}")
    require(df, *{s["column"] for s in specs})
    out = df.withColumns({s["name"]: CROSS_SECTION[s["kind"]](s) for s in specs})
    return out.withColumns({s["name"]: null_if_nan(s["name"]) for s in specs})


def attach_metadata(df: DataFrame, meta: DataFrame | None) -> DataFrame:
    """peer_group per symbol (null without metadata); the table has a row per symbol of the run's configuration."""
    return df.withColumn("peer_group", F.lit(None).cast("string")) if meta is None else df.join(meta.select("symbol", "peer_group"), "symbol", "left")


# --- labels ---


def session_volatility(bars: DataFrame) -> DataFrame:
    """symbol, session_date, realized_volatility, next_realized_volatility (of the symbol's next session)."""
    r = bars.withColumn("_r", log_return(F.col("close"), ["symbol", "session_date"], ORDER))
    g = r.groupBy("symbol", "session_date").agg(F.stddev_samp("_r").alias("realized_volatility"))
    return g.withColumn("next_realized_volatility", F.lead("realized_volatility").over(W.partitionBy("symbol").orderBy("session_date")))


def label_next_return(s: dict) -> Column:
    return ratio("next_regular_close", "close") - 1


def label_next_volatility(s: dict) -> Column:
    return F.col("next_realized_volatility")


def label_quantile(s: dict) -> Column:
    n = int(s.get("quantiles", 5))
    return F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(percent_rank_average(F.col(s["column"]), AT) * n).cast("int")))


LABELS = {"next_regular_session_return": label_next_return, "next_regular_session_volatility": label_next_volatility, "quantile": label_quantile}


def run_labels(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Labels in order: a quantile may name an earlier label. Needs next_regular_close and, for volatility, session_date."""
    unknown = sorted({s["kind"] for s in specs} - set(LABELS))
    if unknown:
        raise ValueError(f"unknown labels: {unknown}")
    out = df
    if any(s["kind"] == "next_regular_session_volatility" for s in specs):
        out = out.join(session_volatility(df).select("symbol", "session_date", "next_realized_volatility"), ["symbol", "session_date"], "left")
    for s in specs:
        out = out.withColumn(s["name"], LABELS[s["kind"]](s))
    return out


def manifest(df: DataFrame, specs: list[dict]) -> DataFrame:
    """name, kind, null_rate of every produced column, in one pass."""
    one = df.agg(*[F.avg(F.col(s["name"]).isNull().cast("double")).alias(f"n{i}") for i, s in enumerate(specs)])
    rows = F.array(*[F.struct(F.lit(s["name"]).alias("name"), F.lit(s["kind"]).alias("kind"), F.col(f"n{i}").alias("null_rate")) for i, s in enumerate(specs)])
    return one.select(F.explode(rows).alias("m")).select("m.*")
