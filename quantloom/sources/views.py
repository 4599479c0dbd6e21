"""The market tables the operators expect, as views over the star-schema tables; SQL beside each for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_prices(spark, sf_dir) -> DataFrame:
    """ticker, date, close_price, volume: a supplier's last line of the day."""
    li = table(spark, sf_dir, "lineitem")
    last = F.max_by(F.lit(450.0) + F.col("l_extendedprice") / 1000, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return li.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(last.alias("close_price"), F.sum("l_quantity").alias("volume"))


def dense_prices(spark, sf_dir) -> DataFrame:
    """ticker, date, close_price: five tickers, nearly every day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close_price"))


def minute_bars(spark, sf_dir) -> DataFrame:
    """symbol, timestamp, open, high, low, close, volume: one bar per event of a positive value."""
    e = table(spark, sf_dir, "events").where("value > 0")
    v = F.col("value")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), v.alias("open"), (v * 1.01).alias("high"), (v * 0.99).alias("low"), v.alias("close"), F.lit(1.0).alias("volume"))


def hourly_bars(spark, sf_dir) -> DataFrame:
    """minute_bars on the clock's hours, so that symbols share timestamps."""
    b = minute_bars(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "timestamp"))
    return b.groupBy("symbol", F.col("hour").alias("timestamp")).agg(F.max_by("close", "timestamp").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))


def universe_rows(spark, sf_dir) -> DataFrame:
    """symbol, timestamp, volume: bars for the screen of the universe."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("timestamp"), F.col("l_quantity").alias("volume"))


def options_rows(spark, sf_dir) -> DataFrame:
    """symbol, trade_date, option_type, bid_iv, ask_iv, open_interest, volume."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "c").when(F.col("l_returnflag") == "N", "p").otherwise("x")
    return li.select((F.col("l_suppkey") % 10).cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("trade_date"), kind.alias("option_type"), F.col("l_discount").alias("bid_iv"), F.col("l_tax").alias("ask_iv"), F.col("l_linenumber").cast("long").alias("open_interest"), F.col("l_quantity").cast("long").alias("volume"))


def cands(spark, sf_dir) -> DataFrame:
    """The candidate table of the universe, 1996 to 2001, the 60 largest."""
    from ..operators.screen import candidates

    return candidates(universe_rows(spark, sf_dir), range(1996, 2002), 60)


def wpanel(spark, sf_dir) -> DataFrame:
    """Weekly return panel of daily_prices."""
    from ..operators.panel import return_panel

    return return_panel(daily_prices(spark, sf_dir), "weekly")


def dpanel(spark, sf_dir) -> DataFrame:
    """Daily return panel of dense_prices."""
    from ..operators.panel import return_panel

    return return_panel(dense_prices(spark, sf_dir), "daily", 0.2)


def sessions_bars(spark, sf_dir) -> DataFrame:
    """minute_bars with session date and session."""
    from ..operators.sessions import classify

    return classify(minute_bars(spark, sf_dir))


#: The same views in SQL.
SQL = {
    "daily_prices": "select cast(l_suppkey as varchar) ticker, cast(l_shipdate as date) date, arg_max(450.0 + l_extendedprice / 1000, l_orderkey * 10 + l_linenumber) close_price, sum(l_quantity) volume from lineitem group by 1, 2",
    "dense_prices": "select o_orderpriority ticker, cast(o_orderdate as date) date, arg_max(o_totalprice, o_orderkey) close_price from orders group by 1, 2",
    "minute_bars": "select event_type symbol, cast(ts as timestamp) \"timestamp\", value open, value * 1.01 high, value * 0.99 low, value \"close\", 1.0::double volume from events where value > 0",
    "hourly_bars": "select symbol, date_trunc('hour', \"timestamp\") \"timestamp\", arg_max(\"close\", \"timestamp\") \"close\", max(high) high, min(low) low, sum(volume) volume from minute_bars group by 1, 2",
    "universe_rows": "select cast(l_suppkey as varchar) symbol, cast(l_shipdate as timestamp) \"timestamp\", l_quantity volume from lineitem",
    "options_rows": "select cast(l_suppkey % 10 as varchar) symbol, cast(l_shipdate as date) trade_date, case l_returnflag when 'A' then 'c' when 'N' then 'p' else 'x' end option_type, l_discount bid_iv, l_tax ask_iv, l_linenumber open_interest, cast(l_quantity as bigint) volume from lineitem",
    "cands": "select symbol ticker, sum(case when year(\"timestamp\") = 1996 then volume else 0 end) vol_1996, sum(case when year(\"timestamp\") between 1996 and 2001 then volume else 0 end) vol_combined, min(cast(\"timestamp\" as date)) start_date from universe_rows group by 1 having count(case when year(\"timestamp\") between 1996 and 2001 then 1 end) > 0 order by vol_combined desc, symbol limit 60",
    "weekly_closes": "select ticker, date + cast((12 - dayofweek(date)) % 7 as integer) as week, arg_max(close_price, date) close_price from daily_prices group by 1, 2",
    "weekly_grid": "select week, row_number() over (order by week) idx from (select distinct week from weekly_closes)",
    "weekly_cov": "select ticker, count(close_price) n_observed, (select max(idx) from weekly_grid) n_periods, count(close_price) / (select max(idx) from weekly_grid)::double coverage from weekly_closes group by 1",
    "wpanel": "select ticker, date, idx, log_ret from (select ticker, week date, idx, case when idx - lag(idx) over w = 1 then ln(close_price / lag(close_price) over w) end log_ret from weekly_closes join weekly_grid using (week) where ticker in (select ticker from weekly_cov where coverage >= 0.8) window w as (partition by ticker order by idx)) where log_ret is not null",
    "dense_grid": "select date, row_number() over (order by date) idx from (select distinct date from dense_prices)",
    "dpanel": "select ticker, date, idx, log_ret from (select ticker, date, idx, case when idx - lag(idx) over w = 1 then ln(close_price / lag(close_price) over w) end log_ret from dense_prices join dense_grid using (date) where ticker in (select ticker from dense_prices group by 1 having count(close_price) >= 0.2 * (select max(idx) from dense_grid)) window w as (partition by ticker order by idx)) where log_ret is not null",
    "dfilled": "select t.ticker, d.date, coalesce(p.log_ret, t.med) x from (select ticker, median(log_ret) med from dpanel group by 1) t cross join (select distinct date from dpanel) d left join dpanel p on p.ticker = t.ticker and p.date = d.date",
    "dranks": "select ticker, date, rank() over (partition by ticker order by x) + (count(*) over (partition by ticker, x) - 1) / 2.0 x from dfilled",
    "sessions_wall": "select *, timezone('America/New_York', timezone('UTC', \"timestamp\")) wall from minute_bars",
    "sessions_bars": "select symbol, \"timestamp\", open, high, low, \"close\", volume, cast(wall as date) + case when hour(wall) * 60 + minute(wall) >= 1200 then 1 else 0 end session_date, case when hour(wall) * 60 + minute(wall) between 240 and 569 then 'premarket' when hour(wall) * 60 + minute(wall) between 570 and 959 then 'regular' when hour(wall) * 60 + minute(wall) between 960 and 1199 then 'postmarket' else 'overnight' end market_session from sessions_wall",
}
