"""Fixed-share buy-and-hold valuation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import ratio, safe_log
from .panel import aligned_prices

PERIODS, RISK_FREE = 252, 0.05


def check_weights(weights: dict[str, float], prices: DataFrame) -> None:
    if not math.isclose(sum(weights.values()), 1, abs_tol=1e-4) or any(w < 0 for w in weights.values()):
        raise ValueError("weights must be non-negative and sum to 1")
    have = {r[0] for r in prices.where(F.col("ticker").isin(*weights)).select("ticker").distinct().collect()}
    if set(weights) - have:
        raise ValueError(f"no prices for {sorted(set(weights) - have)}")


def equity_curve(prices: DataFrame, weights: dict[str, float], capital: float = 10_000.0) -> DataFrame:
    """date, portfolio_value, log_return (0 on the first date), drawdown (positive, the entry value counts).

    The dates of one basket are a calendar: the running window over them is small, whatever the universe.
    """
    check_weights(weights, prices)
    p = aligned_prices(prices, list(weights))
    w = prices.sparkSession.createDataFrame(list(weights.items()), "ticker string, weight double")
    entry = p.groupBy("ticker").agg(F.min_by("close_price", "date").alias("entry"))
    shares = entry.join(F.broadcast(w), "ticker").select("ticker", (F.col("weight") * capital / F.col("entry")).alias("shares"))
    v = p.join(F.broadcast(shares), "ticker").groupBy("date").agg(F.sum(F.col("shares") * F.col("close_price")).alias("portfolio_value"))
    order = W.orderBy("date")
    peak = F.max("portfolio_value").over(order.rowsBetween(W.unboundedPreceding, 0))
    return v.select("date", "portfolio_value", F.coalesce(safe_log(ratio("portfolio_value", F.lag("portfolio_value").over(order))), F.lit(0.0)).alias("log_return"), (1 - ratio("portfolio_value", peak)).alias("drawdown"))


def metrics(curve: DataFrame, capital: float = 10_000.0, risk_free: float = RISK_FREE) -> DataFrame:
    """The one-row summary; the first row's zero return is left out of the moments."""
    r = F.when(F.col("i") > 1, F.col("log_return"))
    g = curve.withColumn("i", F.row_number().over(W.orderBy("date"))).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_trading_days"), F.max_by("portfolio_value", "date").alias("final_value"), (F.avg(r) * PERIODS).alias("ann_return"), (F.stddev_samp(r) * F.sqrt(F.lit(float(PERIODS)))).alias("ann_vol"), F.max("drawdown").alias("max_drawdown"))
    return g.withColumns({
        "initial_capital": F.lit(float(capital)),
        "total_log_return": F.ln(F.col("final_value") / capital),
        "sharpe": F.when(F.col("ann_vol") > 1e-12, (F.col("ann_return") - risk_free) / F.col("ann_vol")),
        "calmar": F.when(F.col("max_drawdown") > 1e-12, F.col("ann_return") / F.col("max_drawdown")),
    })


def rounded(m: DataFrame) -> DataFrame:
    """Report rounding, half to even."""
    return m.withColumns({"final_value": F.bround("final_value", 2)} | {n: F.bround(n, 4) for n in ("total_log_return", "ann_return", "ann_vol", "sharpe", "max_drawdown", "calmar")})


def holdings(prices: DataFrame, weights: dict[str, float], capital: float = 10_000.0) -> DataFrame:
    """Per ticker: entry price, shares, first and last value and weight."""
    p = aligned_prices(prices, list(weights))
    w = prices.sparkSession.createDataFrame(list(weights.items()), "ticker string, initial_weight double")
    g = p.groupBy("ticker").agg(F.min_by("close_price", "date").alias("entry_price"), F.max_by("close_price", "date").alias("final_price")).join(F.broadcast(w), "ticker")
    g = g.withColumn("shares", F.col("initial_weight") * capital / F.col("entry_price")).withColumn("final_value", F.col("shares") * F.col("final_price"))
    return g.withColumn("final_weight", ratio("final_value", F.sum("final_value").over(W.partitionBy(F.lit(0)))))


def simple_metrics(curve: DataFrame, n_assets: int, capital: float = 10_000.0, risk_free: float = RISK_FREE) -> DataFrame:
    """The one-row summary by simple returns: total_return, cagr, annualized_return, annualized_volatility, sharpe_ratio, sortino_ratio, max_drawdown (negative), calmar_ratio.

    The downside deviation behind the Sortino ratio is the root mean square of the days'
    returns, gains counted as zero; cagr compounds over the return days at PERIODS a year.
    """
    w = W.orderBy("date")
    r = curve.withColumn("r", ratio("portfolio_value", F.lag("portfolio_value").over(w)) - 1)
    g = r.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_trading_days"), F.max_by("portfolio_value", "date").alias("final_value"), F.count("r").alias("n"), (F.avg("r") * PERIODS).alias("annualized_return"), (F.stddev_samp("r") * F.sqrt(F.lit(float(PERIODS)))).alias("annualized_volatility"), F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least("r", F.lit(0.0)), 2))) * PERIODS).alias("down"), (-F.max("drawdown")).alias("max_drawdown"))
    g = g.withColumns({"total_return": F.col("final_value") / capital - 1, "cagr": F.pow(F.col("final_value") / capital, F.try_divide(F.lit(float(PERIODS)), "n")) - 1})
    excess = F.col("annualized_return") - risk_free
    return g.withColumns({
        "n_assets": F.lit(n_assets),
        "initial_capital": F.lit(float(capital)),
        "sharpe_ratio": F.when(F.col("annualized_volatility") > 1e-12, excess / F.col("annualized_volatility")),
        "sortino_ratio": F.when(F.col("down") > 1e-12, excess / F.col("down")),
        "calmar_ratio": F.when(F.col("max_drawdown") < -1e-12, F.col("cagr") / -F.col("max_drawdown")),
        "risk_free_rate": F.lit(risk_free),
    }).drop("n", "down")


def allocation_summary(prices: DataFrame, weights: DataFrame, capital: float = 10_000.0, risk_free: float = RISK_FREE) -> DataFrame:
    """Per strategy of `weights` (strategy, ticker, weight; one basket): the buy-and-hold figures and the shape of its weights.

    All strategies share one pass over the basket's aligned prices.
    """
    tickers = [r[0] for r in weights.select("ticker").distinct().orderBy("ticker").collect()]  # one basket
    p = aligned_prices(prices, tickers)
    entry = p.groupBy("ticker").agg(F.min_by("close_price", "date").alias("entry"))
    shares = weights.join(entry, "ticker").select("strategy", "ticker", (F.col("weight") * capital / F.col("entry")).alias("shares"))
    v = p.join(F.broadcast(shares), "ticker").groupBy("strategy", "date").agg(F.sum(F.col("shares") * F.col("close_price")).alias("value"))  # a weight per strategy and ticker
    order = W.partitionBy("strategy").orderBy("date")
    r = safe_log(ratio("value", F.lag("value").over(order)))
    peak = F.max("value").over(order.rowsBetween(W.unboundedPreceding, 0))
    g = v.select("strategy", "date", "value", r.alias("r"), (1 - ratio("value", peak)).alias("drawdown")).groupBy("strategy").agg(F.max_by("value", "date").alias("final_value"), F.count("r").alias("n"), (F.avg("r") * PERIODS).alias("ann_return"), (F.stddev_samp("r") * F.sqrt(F.lit(float(PERIODS)))).alias("ann_vol"), F.max("drawdown").alias("max_drawdown"))
    g = g.withColumns({"total_return": F.col("final_value") / capital - 1, "cagr": F.pow(F.col("final_value") / capital, F.try_divide(F.lit(float(PERIODS)), "n")) - 1})
    shape = weights.groupBy("strategy").agg(F.count("*").alias("n_etfs"), F.min("weight").alias("min_weight"), F.sum((F.col("weight") > 1e-12).cast("int")).alias("nonzero_positions"), F.max("weight").alias("top_weight"), F.try_divide(F.lit(1.0), F.sum(F.col("weight") * F.col("weight"))).alias("effective_n"))
    return g.join(shape, "strategy").withColumns({
        "budget": F.lit(float(capital)),
        "sharpe": F.when(F.col("ann_vol") > 1e-12, (F.col("ann_return") - risk_free) / F.col("ann_vol")),
        "calmar_ratio": F.when(F.col("max_drawdown") > 1e-12, F.col("cagr") / F.col("max_drawdown")),
    }).drop("n")
