"""Rank correlation, distance and covariance as edge lists (ticker_i, ticker_j, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import average_rank, ratio, safe_log


def filled(panel: DataFrame) -> DataFrame:
    """The complete panel: every ticker on every date of it, gaps filled with the ticker's median return."""
    dates = panel.select("date").distinct()
    medians = panel.groupBy("ticker").agg(F.median("log_ret").alias("med"))
    every = medians.crossJoin(dates)  # the dense matrix the correlations are defined on
    return every.join(panel.select("ticker", "date", "log_ret"), ["ticker", "date"], "left").select("ticker", "date", F.coalesce("log_ret", "med").alias("x"))


def pairs(values: DataFrame, aggregate) -> DataFrame:
    """aggregate over the dates two tickers share, for i <= j, mirrored. T * N^2 / 2 rows are joined but only partial sums are shuffled."""
    a = values.select("date", F.col("ticker").alias("ticker_i"), F.col("x").alias("xi"))
    b = values.select("date", F.col("ticker").alias("ticker_j"), F.col("x").alias("xj"))
    half = a.join(b, "date").where("ticker_i <= ticker_j").groupBy("ticker_i", "ticker_j").agg(aggregate.alias("value"))
    back = half.where("ticker_i <> ticker_j").select(F.col("ticker_j").alias("ticker_i"), F.col("ticker_i").alias("ticker_j"), "value")
    return half.unionByName(back)


def spearman(panel: DataFrame) -> DataFrame:
    """Rank correlations of the filled panel, ties averaged."""
    return spearman_filled(filled(panel))


def spearman_filled(values: DataFrame) -> DataFrame:
    """Rank correlations of a panel that is filled already."""
    return pairs(values.select("ticker", "date", average_rank("x", ["ticker"]).alias("x")), F.corr("xi", "xj"))


TICKERS = 256  # tickers of a block of vectors


def spearman_vectors(panel: DataFrame) -> DataFrame:
    """The same for many tickers: a standardised rank vector per ticker, blocks of vectors multiplied on the executors, no matrix on the driver."""
    ranks = filled(panel).select("ticker", "date", average_rank("x", ["ticker"]).alias("x"))
    vectors = ranks.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "x"))), lambda s: s["x"].cast("double")).alias("v"))
    blocks = max(1, -(-panel.select("ticker").distinct().count() // TICKERS))
    dealt = vectors.withColumn("b", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "ticker", "v")

    def multiply(table):
        import numpy as np
        import pyarrow as pa

        block, names = table["b"].to_numpy(), np.array(table["ticker"].to_pylist(), object)
        x = np.array(table["v"].to_pylist(), np.float64)
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        scale = norm[a][:, None] * norm[b]
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(scale > 0, x[a] @ x[b].T / scale, np.nan)
        i, j = np.divmod(np.arange(value.size), max(1, len(b)))
        left, right, value = names[a][i], names[b][j], value.ravel()
        if lo != hi:
            left, right, value = np.r_[left, right], np.r_[right, left], np.r_[value, value]
        return pa.table({"ticker_i": pa.array(left, pa.string()), "ticker_j": pa.array(right, pa.string()), "value": pa.array(value, pa.float64(), mask=np.isnan(value))})

    return dealt.groupBy("lo", "hi").applyInArrow(multiply, "ticker_i string, ticker_j string, value double")


def covariance(panel: DataFrame) -> DataFrame:
    return covariance_filled(filled(panel))


def covariance_filled(values: DataFrame) -> DataFrame:
    return pairs(values, F.covar_samp("xi", "xj"))


def distance(corr: DataFrame) -> DataFrame:
    """sqrt((1 - rho) / 2), clipped to 0..1, 0 on the diagonal."""
    d = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("value")) / 2)))
    return corr.select("ticker_i", "ticker_j", F.when(F.col("ticker_i") == F.col("ticker_j"), 0.0).otherwise(d).alias("value"))


def average_abs_correlation(corr: DataFrame) -> DataFrame:
    """Mean |rho| with the other tickers; NULL for a single ticker."""
    others = F.when(F.col("ticker_i") != F.col("ticker_j"), F.abs("value"))
    return corr.groupBy(F.col("ticker_i").alias("ticker")).agg(F.avg(others).alias("avg_abs_corr"))


def weekly_correlation(closes: DataFrame) -> DataFrame:
    """Correlation of weekly log returns over the weeks in which every ticker has one; closes: ticker, week, close_price."""
    w = W.partitionBy("ticker").orderBy("week")
    r = closes.select("ticker", F.col("week").alias("date"), safe_log(ratio("close_price", F.lag("close_price").over(w))).alias("x")).where("x is not null")
    n = closes.select("ticker").distinct().count()
    common = r.withColumn("k", F.count("*").over(W.partitionBy("date"))).where(F.col("k") == n)
    return pairs(common.select("ticker", "date", "x"), F.corr("xi", "xj"))


def pearson_simple(prices: DataFrame) -> DataFrame:
    """Correlation of simple returns over dates on which every ticker has a price."""
    n = prices.select("ticker").distinct().count()
    whole = prices.withColumn("k", F.count("close_price").over(W.partitionBy("date"))).where(F.col("k") == n)
    w = W.partitionBy("ticker").orderBy("date")
    r = whole.withColumn("x", F.try_divide("close_price", F.lag("close_price").over(w)) - 1).where("x is not null")
    return pairs(r.select("ticker", "date", "x"), F.corr("xi", "xj"))


def to_matrix(edges: DataFrame, order: list[str] | None = None):
    """(tickers, numpy matrix): the collect boundary in front of the driver-side selectors, N^2 numbers."""
    import numpy as np

    rows = edges.collect()
    names = order or sorted({r["ticker_i"] for r in rows})
    at = {t: i for i, t in enumerate(names)}
    m = np.full((len(names), len(names)), np.nan)
    for r in rows:
        if r["ticker_i"] in at and r["ticker_j"] in at:
            m[at[r["ticker_i"]], at[r["ticker_j"]]] = r["value"]
    return names, m
