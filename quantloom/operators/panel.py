"""Return panels on a date grid, their filters and per-ticker statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import ratio, running_max, safe_log, week_friday

PERIODS = {"daily": 252, "weekly": 52}
RISK_FREE = 0.05


def frequency(name) -> str:
    f = str(getattr(name, "value", name)).strip().lower()
    if f not in PERIODS:
        raise ValueError(f"unknown frequency {name!r}")
    return f


def gridded(prices: DataFrame, freq: str = "daily") -> DataFrame:
    """ticker, date, idx, close_price; idx numbers the panel's distinct dates (weeks). The numbered table has one row per date."""
    if frequency(freq) == "weekly":
        prices = prices.where("close_price is not null").groupBy("ticker", week_friday("date").alias("date")).agg(F.max_by("close_price", "date").alias("close_price"))
    grid = prices.select("date").distinct().withColumn("idx", F.row_number().over(W.orderBy("date")))
    return prices.join(grid, "date").select("ticker", "date", "idx", "close_price")


def coverage(grid: DataFrame) -> DataFrame:
    """ticker, n_observed, n_periods, coverage: observed periods over those of the whole panel."""
    n = grid.agg(F.max("idx").alias("n_periods"))
    g = grid.groupBy("ticker").agg(F.count("close_price").alias("n_observed")).crossJoin(F.broadcast(n))  # one row
    return g.withColumn("coverage", ratio("n_observed", "n_periods"))


def return_panel(prices: DataFrame, freq: str = "daily", min_coverage: float = 0.80) -> DataFrame:
    """ticker, date, idx, log_ret: returns between neighbouring grid periods; a gap on either side gives none."""
    g = gridded(prices, freq)
    w = W.partitionBy("ticker").orderBy("idx")
    near = F.when(F.col("idx") - F.lag("idx").over(w) == 1, F.lag("close_price").over(w))
    # Coverage comes from the window the returns need anyway: no second pass, no join of the panel with itself.
    out = g.select("ticker", "date", "idx", safe_log(ratio("close_price", near)).alias("log_ret"), F.count("close_price").over(W.partitionBy("ticker")).alias("_n"))
    if min_coverage:
        n = prices.select((week_friday("date") if frequency(freq) == "weekly" else F.col("date")).alias("d")).agg(F.countDistinct("d").alias("_periods"))
        out = out.crossJoin(F.broadcast(n)).where(F.col("_n") >= min_coverage * F.col("_periods"))  # one row
    return out.where("log_ret is not null").select("ticker", "date", "idx", "log_ret")


def total_log_return(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ticker").agg(F.coalesce(F.sum("log_ret"), F.lit(0.0)).alias("total_log_return"))


def average_yearly_return(panel: DataFrame) -> DataFrame:
    """Mean over the panel's calendar years of a ticker's yearly sums; a year without rows counts as 0."""
    years = panel.agg(F.countDistinct(F.year("date")).alias("n_years"))
    s = panel.groupBy("ticker").agg(F.coalesce(F.sum("log_ret"), F.lit(0.0)).alias("s")).crossJoin(F.broadcast(years))  # one row
    return s.select("ticker", ratio("s", "n_years").alias("avg_yearly_return"))


def annual_volatility(panel: DataFrame, freq: str = "daily") -> DataFrame:
    return panel.groupBy("ticker").agg((F.stddev_samp("log_ret") * F.sqrt(F.lit(float(PERIODS[frequency(freq)])))).alias("ann_vol"))


def keep(df: DataFrame, tickers: DataFrame) -> DataFrame:
    return df.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def start_date_filter(cands: DataFrame, cutoff: str) -> DataFrame:
    return cands.where(F.col("start_date") <= F.lit(cutoff).cast("date"))


def blacklist_filter(df: DataFrame, blacklist, anchors=()) -> DataFrame:
    both = sorted(set(blacklist) & set(anchors))
    if both:
        raise ValueError(f"anchors are on the blacklist: {both}")
    return df.where(~F.col("ticker").isin(*blacklist)) if blacklist else df


def check_anchors(df: DataFrame, anchors) -> None:
    """Error if an anchor has gone."""
    left = {r[0] for r in df.where(F.col("ticker").isin(*anchors)).select("ticker").distinct().collect()} if anchors else set()
    if set(anchors) - left:
        raise ValueError(f"anchors are missing: {sorted(set(anchors) - left)}")


def hurdle(panel: DataFrame, metric: DataFrame, column: str, least: float, anchors=()) -> DataFrame:
    """Rows of tickers whose metric reaches the hurdle (a missing metric fails); the anchors must be among them."""
    passing = metric.where(F.col(column) >= least).select("ticker")
    check_anchors(passing, anchors)
    return keep(panel, passing)


def volatility_band(panel: DataFrame, low: float = 0.10, high: float = 0.60, freq: str = "daily", anchors=()) -> DataFrame:
    """Rows of tickers inside the band; anchors pass in any case."""
    ok = F.col("ann_vol").between(low, high)
    if anchors:
        ok = ok | F.col("ticker").isin(*anchors)
    return keep(panel, annual_volatility(panel, freq).where(ok))


def filter_audit(stages: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """step, threshold, count_before, count_after, removed_count: one row per stage after the first; stages: (name, threshold, frame with ticker)."""
    counts = None
    for i, (name, threshold, df) in enumerate(stages):
        one = df.agg(F.countDistinct("ticker").alias("n")).select(F.lit(i).alias("i"), F.lit(name).alias("step"), F.lit(threshold).alias("threshold"), "n")
        counts = one if counts is None else counts.unionByName(one)
    before = F.lag("n").over(W.orderBy("i"))
    return counts.select("i", "step", "threshold", before.alias("count_before"), F.col("n").alias("count_after"), (before - F.col("n")).alias("removed_count")).where("i > 0")


def ticker_stats(panel: DataFrame, freq: str = "daily", risk_free: float = RISK_FREE) -> DataFrame:
    """ann_return, ann_vol, sharpe, max_drawdown (positive; the peak starts after the first return)."""
    n = PERIODS[frequency(freq)]
    wealth = F.exp(F.sum("log_ret").over(W.partitionBy("ticker").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)))
    p = panel.withColumn("wealth", wealth).withColumn("dd", 1 - ratio("wealth", running_max("wealth", ["ticker"], ["idx"])))
    g = p.groupBy("ticker").agg((F.avg("log_ret") * n).alias("ann_return"), (F.stddev_samp("log_ret") * F.sqrt(F.lit(float(n)))).alias("ann_vol"), F.max("dd").alias("max_drawdown"))
    return g.withColumn("sharpe", F.when(F.col("ann_vol") > 0, ratio(F.col("ann_return") - risk_free, "ann_vol")))


def aligned_prices(prices: DataFrame, tickers=None) -> DataFrame:
    """ticker, date, close_price: forward-filled on the common grid, from the first date all tickers have a price."""
    if tickers is not None:
        prices = prices.where(F.col("ticker").isin(*tickers))
    grid = prices.select("date").distinct()
    names = prices.select("ticker").distinct()
    every = grid.crossJoin(names if tickers is None else F.broadcast(names))  # the dense price matrix itself; a basket's tickers are few
    fill = W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    full = every.join(prices.select("ticker", "date", "close_price"), ["ticker", "date"], "left").withColumn("close_price", F.last("close_price", ignorenulls=True).over(fill))
    whole = W.partitionBy("date")
    return full.withColumn("have", F.count("close_price").over(whole)).withColumn("all", F.count(F.lit(1)).over(whole)).where("have = all").drop("have", "all")
