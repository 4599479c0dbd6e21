"""Universe screens and the drawdown / yearly return / weekly volatility screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import log_return, ratio, running_max, week_friday

WEEKS = 52


def clean_prices(df: DataFrame, seq: str | None = None) -> DataFrame:
    """ticker (trimmed, upper case), date, close_price > 0; of repeated keys the last by `seq` (else the largest price)."""
    out = df.withColumns({"ticker": F.upper(F.trim("ticker")), "date": F.col("date").try_cast("date"), "close_price": F.col("close_price").try_cast("double")})
    out = out.where("ticker is not null and ticker <> '' and date is not null and close_price > 0").where(~F.isnan("close_price"))
    order = F.struct(F.col(seq), F.col("close_price")) if seq else F.col("close_price")
    return out.groupBy("ticker", "date").agg(F.max_by("close_price", order).alias("close_price"))


def volume_by_year(bars: DataFrame, years) -> DataFrame:
    """symbol, vol_<year>..., vol_combined; a year without rows is 0."""
    years = list(years)
    in_year = F.year("timestamp")
    lo, hi = f"{min(years)}-01-01", f"{max(years) + 1}-01-01"
    bars = bars.where((F.col("timestamp") >= F.lit(lo).cast("timestamp")) & (F.col("timestamp") < F.lit(hi).cast("timestamp")))
    out = bars.groupBy("symbol").agg(*[F.coalesce(F.sum(F.when(in_year == y, F.col("volume"))), F.lit(0.0)).alias(f"vol_{y}") for y in years])
    return out.withColumn("vol_combined", sum((F.col(f"vol_{y}") for y in years[1:]), F.col(f"vol_{years[0]}")))


def first_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min(F.to_date("timestamp")).alias("start_date"))


def candidates(bars: DataFrame, years, top: int = 500) -> DataFrame:
    """ticker, volumes, start_date of the `top` symbols by volume (ties: smaller symbol)."""
    out = volume_by_year(bars, years).orderBy(F.desc("vol_combined"), "symbol").limit(top)
    return out.join(first_dates(bars), "symbol", "left").withColumnRenamed("symbol", "ticker")


def daily_bars(bars: DataFrame) -> DataFrame:
    """ticker, date, close_price (the last non-null close), volume."""
    seen = F.when(F.col("close").isNotNull(), F.col("timestamp"))
    return bars.groupBy(F.col("symbol").alias("ticker"), F.to_date("timestamp").alias("date")).agg(F.max_by("close", seen).alias("close_price"), F.sum("volume").alias("volume"))


def yearly_returns(prices: DataFrame, min_days: int = 200) -> DataFrame:
    """ticker, year, first/last date and price, n_price_days, yearly_return of years with enough days."""
    g = prices.groupBy("ticker", F.year("date").alias("year")).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by("close_price", "date").alias("first_price"), F.max_by("close_price", "date").alias("last_price"),
        F.count("close_price").alias("n_price_days"),
    ).where(F.col("n_price_days") >= min_days)
    return g.withColumn("yearly_return", ratio("last_price", "first_price") - 1)


def yearly_summary(yearly: DataFrame) -> DataFrame:
    return yearly.groupBy("ticker").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("n_years"), F.min("yearly_return").alias("min_yearly_return"), F.avg("yearly_return").alias("avg_yearly_return"))


def weekly_closes(prices: DataFrame) -> DataFrame:
    """ticker, week (its Friday), close_price: the last observed close of each observed week."""
    return prices.where("close_price is not null").groupBy("ticker", week_friday("date").alias("week")).agg(F.max_by("close_price", "date").alias("close_price"))


def weekly_stats(prices: DataFrame) -> DataFrame:
    """weekly_volatility, n_weekly_returns and max_drawdown per ticker, from one window over the weekly closes.

    Returns run between observed weeks (empty weeks are skipped); the drawdown is the largest
    fall below the running maximum, zero or negative.
    """
    w = weekly_closes(prices).withColumns({"r": log_return(F.col("close_price"), ["ticker"], ["week"]), "dd": ratio("close_price", running_max("close_price", ["ticker"], ["week"])) - 1})
    return w.groupBy("ticker").agg((F.stddev_samp("r") * F.sqrt(F.lit(float(WEEKS)))).alias("weekly_volatility"), F.count("r").alias("n_weekly_returns"), F.min("dd").alias("max_drawdown"))


def weekly_volatility(prices: DataFrame) -> DataFrame:
    return weekly_stats(prices).select("ticker", "weekly_volatility", "n_weekly_returns").where("weekly_volatility is not null")


def weekly_drawdown(prices: DataFrame) -> DataFrame:
    return weekly_stats(prices).select("ticker", "max_drawdown")


def drawdown_screen(prices: DataFrame, min_drawdown: float = -0.15, min_average_yearly_return: float = 0.03, min_trading_days_per_year: int = 200, min_years: int = 5, seq: str | None = None) -> DataFrame:
    """Passing tickers ranked by weekly volatility, then average return, then ticker. Prices are cleaned once."""
    if min_years < 1 or min_drawdown > 0:
        raise ValueError("min_years must be 1 at least and min_drawdown zero at most")
    p = clean_prices(prices, seq)
    s = yearly_summary(yearly_returns(p, min_trading_days_per_year)).join(weekly_stats(p).where("weekly_volatility is not null"), "ticker")
    s = s.where((F.col("n_years") >= min_years) & (F.col("max_drawdown") >= min_drawdown) & (F.col("avg_yearly_return") >= min_average_yearly_return))
    # The passing list is a report of at most one row per ticker of the universe.
    return s.withColumn("rank", F.row_number().over(W.orderBy("weekly_volatility", F.desc("avg_yearly_return"), "ticker")))


def inception_summary(cands: DataFrame) -> DataFrame:
    """inception_year, count, cumulative, pct, cumulative_pct."""
    by = cands.where("start_date is not null").groupBy(F.year("start_date").alias("inception_year")).agg(F.count("*").alias("count"))
    every, upto = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy("inception_year").rowsBetween(W.unboundedPreceding, 0)
    out = by.withColumn("cumulative", F.sum("count").over(upto)).withColumn("n", F.sum("count").over(every))
    return out.select("inception_year", "count", "cumulative", F.bround(F.col("count") / F.col("n") * 100, 1).alias("pct"), F.bround(F.col("cumulative") / F.col("n") * 100, 1).alias("cumulative_pct"))


def tickers_by_year(cands: DataFrame, k: int | None = None) -> DataFrame:
    """inception_year, tickers: liquidity first (the first k if asked for)."""
    order = W.partitionBy("inception_year").orderBy(F.desc("vol_combined"), "ticker")
    ranked = cands.where("start_date is not null").withColumn("inception_year", F.year("start_date")).withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.groupBy("inception_year").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda s: s["ticker"]).alias("tickers"))


def cutoff_sensitivity(cands: DataFrame, first: int, last: int) -> DataFrame:
    """cutoff_year, eligible: how many tickers had started by the end of each year. One pass: counts by year, then a running sum."""
    by = cands.where("start_date is not null").groupBy(F.greatest(F.year("start_date"), F.lit(first)).alias("cutoff_year")).agg(F.count("*").alias("n"))
    years = cands.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("cutoff_year"))
    upto = W.partitionBy(F.lit(0)).orderBy("cutoff_year").rowsBetween(W.unboundedPreceding, 0)
    return years.join(by, "cutoff_year", "left").select("cutoff_year", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("eligible"))


def volume_stats(daily: DataFrame, year: int) -> DataFrame:
    """Days, total, average, median, least and most daily volume of a year."""
    d = daily.where(F.year("date") == year)
    return d.groupBy("ticker").agg(F.count("volume").alias("trading_days"), F.sum("volume").alias("total_volume"), F.avg("volume").alias("average_daily_volume"), F.median("volume").alias("median_daily_volume"), F.min("volume").alias("min_daily_volume"), F.max("volume").alias("max_daily_volume"))


def ticker_year_metrics(prices: DataFrame, risk_free: float = 0.05, periods: int = 252) -> DataFrame:
    """Per ticker and year: prices, return, volatility and Sharpe ratio of daily log returns within the year."""
    p = prices.withColumn("year", F.year("date"))
    p = p.withColumn("r", log_return(F.col("close_price"), ["ticker", "year"], ["date"]))
    g = p.groupBy("ticker", "year").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("close_price").alias("n_price_days"), F.count("r").alias("n_return_days"), F.min_by("close_price", "date").alias("start_price"), F.max_by("close_price", "date").alias("end_price"), (F.avg("r") * periods).alias("annualized_return"), (F.stddev_samp("r") * F.sqrt(F.lit(float(periods)))).alias("annualized_volatility"))
    return g.withColumn("total_return", ratio("end_price", "start_price") - 1).withColumn("sharpe_ratio", ratio(F.col("annualized_return") - risk_free, "annualized_volatility"))


def ticker_year_pivot(metrics: DataFrame, value: str, years: list[int]) -> DataFrame:
    """ticker_year_metrics() as a table: a row per ticker, a column per year."""
    return metrics.groupBy("ticker").pivot("year", list(years)).agg(F.first(value))
