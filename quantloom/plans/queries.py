"""One query per operator of the inventory (the name starts with its id), each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import allocation, asof, backtest, features, matrices, panel, screen, selection, sessions
from ..sources import readers, sinks, views
from .registry import Registry

QUERIES = Registry()
add = QUERIES.add

# --- sources ---


@add("s2_minute_scan", "symbol s, timestamp t, close n, volume n, trades_count n", ["minute_bars"], """
select *, null::double trades_count from minute_bars where symbol in ('view', 'click') and "timestamp" >= '2024-01-05' and "timestamp" < '2024-01-08'""")
def _(spark, sf):
    return readers.minute_bars(views.minute_bars(spark, sf), ["view", "click"], "2024-01-05", "2024-01-07")


OPTIONS_SQL = """
select symbol, trade_date, timezone('UTC', timezone('America/New_York', cast(trade_date as timestamp) + interval 16 hour)) "timestamp", sum(volume)::double volume,
 coalesce(sum(volume) filter (option_type = 'c'), 0)::double call_volume, coalesce(sum(volume) filter (option_type = 'p'), 0)::double put_volume, sum(open_interest)::double total_open_interest,
 avg((bid_iv + ask_iv) / 2) filter (option_type = 'c' and bid_iv > 0 and ask_iv > 0) call_iv_mid, avg((bid_iv + ask_iv) / 2) filter (option_type = 'p' and bid_iv > 0 and ask_iv > 0) put_iv_mid,
 coalesce(sum(volume) filter (option_type = 'p'), 0) / nullif(coalesce(sum(volume) filter (option_type = 'c'), 0)::double, 0) put_call_volume_ratio
from options_rows group by 1, 2"""


@add("s3_a4_options_summary", "symbol s, timestamp t, volume n, call_volume n, put_volume n, total_open_interest n, call_iv_mid n, put_iv_mid n, put_call_volume_ratio n", ["options_rows"], OPTIONS_SQL)
def _(spark, sf):
    return readers.options_summary(views.options_rows(spark, sf))


@add("s4_s5_load_source", "symbol s, source_name s, source_kind s, source_symbol_count i, n_rows i, n_open i, n_call i", ["minute_bars"], """
select symbol, 'bars' source_name, 'minute_bars' source_kind, 3 source_symbol_count, count(*) n_rows, count(open) n_open, 0 n_call from minute_bars where symbol in ('view', 'click', 'error') and "timestamp" >= '2024-01-02' and "timestamp" < '2024-01-21' group by 1""")
def _(spark, sf):
    spec = readers.SourceSpec("bars", "minute", ("view", "click", "error"))
    out = readers.load_source(spark, spec, {"minute": views.minute_bars(spark, sf)}, "2024-01-02", "2024-01-20")
    return out.groupBy("symbol", "source_name", "source_kind", "source_symbol_count").agg(F.count("*").alias("n_rows"), F.count("open").alias("n_open"), F.count("call_volume").alias("n_call"))


@add("s6_price_scan", "ticker s, date d, close_price n", ["daily_prices"], "select * from daily_prices where ticker in ('1', '2', '3') and date between '1996-01-01' and '1996-12-31'")
def _(spark, sf):
    return views.daily_prices(spark, sf).where(F.col("ticker").isin("1", "2", "3") & F.col("date").between("1996-01-01", "1996-12-31"))


# The same scans over all symbols and dates of the tables.

EVER = ("1900-01-01", "2199-12-31")


def symbols(bars):
    return sorted(r.symbol for r in bars.where("symbol is not null").select("symbol").distinct().collect())


@add("s2_minute_scan_all", "symbol s, timestamp t, close n, volume n, trades_count n", ["minute_bars"], "select *, null::double trades_count from minute_bars where symbol is not null")
def _(spark, sf):
    bars = views.minute_bars(spark, sf)
    return readers.minute_bars(bars, symbols(bars), *EVER)


@add("s4_s5_load_source_all", "symbol s, source_name s, source_kind s, source_symbol_count i, n_rows i, n_open i, n_call i", ["minute_bars"], """
select symbol, 'bars' source_name, 'minute_bars' source_kind, (select count(distinct symbol) from minute_bars)::int source_symbol_count, count(*) n_rows, count(open) n_open, 0 n_call from minute_bars where symbol is not null group by 1""")
def _(spark, sf):
    bars = views.minute_bars(spark, sf)
    out = readers.load_source(spark, readers.SourceSpec("bars", "minute", tuple(symbols(bars))), {"minute": bars}, *EVER)
    return out.groupBy("symbol", "source_name", "source_kind", "source_symbol_count").agg(F.count("*").alias("n_rows"), F.count("open").alias("n_open"), F.count("call_volume").alias("n_call"))


@add("s6_price_scan_all", "ticker s, date d, close_price n", ["daily_prices"], "select * from daily_prices")
def _(spark, sf):
    return views.daily_prices(spark, sf)


@add("s10_verification", "n_rows i, n_tickers i, first_date d, last_date d", ["daily_prices"], "select count(*) n_rows, count(distinct ticker) n_tickers, min(date) first_date, max(date) last_date from daily_prices")
def _(spark, sf):
    return sinks.verification(views.daily_prices(spark, sf))


# --- cleaning and filters ---


@add("p1_clean_prices", "ticker s, date d, close_price n", [], """
select upper(trim(ticker)) ticker, date, arg_max(close_price, seq) close_price from (select ' ' || lower(o_orderpriority) || ' ' ticker, cast(o_orderdate as date) date, case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then -1 else o_totalprice end close_price, o_orderkey seq from orders) where close_price > 0 group by 1, 2""")
def _(spark, sf):
    o = views.table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 11 == 0, -1.0).otherwise(F.col("o_totalprice"))
    raw = o.select(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")).alias("ticker"), F.col("o_orderdate").alias("date"), price.alias("close_price"), F.col("o_orderkey").alias("seq"))
    return screen.clean_prices(raw, "seq")


@add("p3_start_date_filter", "ticker s, start_date d, vol_combined n", ["cands"], "select * from cands where start_date <= '1995-02-01'")
def _(spark, sf):
    return panel.start_date_filter(views.cands(spark, sf), "1995-02-01")


@add("p4_coverage", "ticker s, n_observed i, n_periods i, coverage n", ["weekly_cov"], "select * from weekly_cov where coverage >= 0.8")
def _(spark, sf):
    return panel.coverage(panel.gridded(views.daily_prices(spark, sf), "weekly")).where("coverage >= 0.8")


@add("p5_blacklist", "ticker s, n i", ["wpanel"], "select ticker, count(*) n from wpanel where ticker not in ('1', '2', '5') group by 1")
def _(spark, sf):
    return panel.blacklist_filter(views.wpanel(spark, sf), ["1", "2", "5"]).groupBy("ticker").agg(F.count("*").alias("n"))


@add("p6_p7_total_return_hurdle", "ticker s, n i", ["wpanel"], "select ticker, count(*) n from wpanel group by 1 having coalesce(sum(log_ret), 0) >= 0.01")
def _(spark, sf):
    p = views.wpanel(spark, sf)
    return panel.hurdle(p, panel.total_log_return(p), "total_log_return", 0.01).groupBy("ticker").agg(F.count("*").alias("n"))


@add("p8_yearly_return_hurdle", "ticker s, n i", ["wpanel"], "select ticker, count(*) n from wpanel group by 1 having coalesce(sum(log_ret), 0) / (select count(distinct year(date)) from wpanel) >= 0.0")
def _(spark, sf):
    p = views.wpanel(spark, sf)
    return panel.hurdle(p, panel.average_yearly_return(p), "avg_yearly_return", 0.0).groupBy("ticker").agg(F.count("*").alias("n"))


@add("p9_volatility_band", "ticker s, n i", ["wpanel"], "select ticker, count(*) n from wpanel group by 1 having stddev_samp(log_ret) * sqrt(52.0) between 0.10 and 0.60 or ticker = '1'")
def _(spark, sf):
    return panel.volatility_band(views.wpanel(spark, sf), freq="weekly", anchors=["1"]).groupBy("ticker").agg(F.count("*").alias("n"))


@add("p10_selection_universe", "ticker s, vol_combined n, position i", ["cands", "wpanel"], "select ticker, vol_combined, row_number() over (order by vol_combined desc, ticker) position from cands where ticker in (select ticker from wpanel)")
def _(spark, sf):
    kept = panel.keep(views.cands(spark, sf), views.wpanel(spark, sf))
    return kept.withColumn("position", F.row_number().over(W.orderBy(F.desc("vol_combined"), "ticker")))


@add("p11_filter_audit", "step s, threshold s, count_before i, count_after i, removed_count i", ["wpanel"], """
with v as (select ticker, stddev_samp(log_ret) * sqrt(52.0) vol, sum(log_ret) total from wpanel group by 1), c as (select count(*) n0, count(*) filter (ticker not in ('1', '2')) n1, count(*) filter (ticker not in ('1', '2') and vol >= 0.1) n2, count(*) filter (ticker not in ('1', '2') and vol >= 0.1 and vol <= 0.6) n3 from v)
;
select 'blacklist' step, '1, 2' threshold, n0 count_before, n1 count_after, n0 - n1 removed_count from c union all select 'min_vol', '>= 0.10', n1, n2, n1 - n2 from c union all select 'max_vol', '<= 0.60', n2, n3, n2 - n3 from c""")
def _(spark, sf):
    p = views.wpanel(spark, sf)
    a = panel.blacklist_filter(p, ["1", "2"])
    b = panel.volatility_band(a, 0.10, float("inf"), "weekly")
    return panel.filter_audit([("all", "", p), ("blacklist", "1, 2", a), ("min_vol", ">= 0.10", b), ("max_vol", "<= 0.60", panel.volatility_band(b, 0.10, 0.60, "weekly"))])


@add("p13_p14_normalize", "symbol s, wall_hour i, n i, n_bad i", ["minute_bars"], """
select symbol, hour(timezone('America/New_York', timezone('UTC', "timestamp"))) wall_hour, count(*) n, count(*) filter (volume is null) n_bad from minute_bars group by 1, 2""")
def _(spark, sf):
    out = readers.normalize(views.minute_bars(spark, sf).withColumn("volume", F.col("volume").cast("string")), primary=True)
    return out.groupBy("symbol", F.hour("wall_clock").alias("wall_hour")).agg(F.count("*").alias("n"), F.sum(F.col("volume").isNull().cast("int")).alias("n_bad"))


@add("p15_regular_bars", "symbol s, session_date d, n i", ["sessions_bars"], "select symbol, session_date, count(*) n from sessions_bars where market_session = 'regular' group by 1, 2")
def _(spark, sf):
    return sessions.regular_bars(views.sessions_bars(spark, sf)).groupBy("symbol", "session_date").agg(F.count("*").alias("n"))


SCREEN = {"min_drawdown": -0.1865, "min_average_yearly_return": 0.0, "min_trading_days_per_year": 60, "min_years": 5}
SCREEN_SQL = """
with yr as (select ticker, year(date) y, arg_max(close_price, date) / arg_min(close_price, date) - 1 r from daily_prices group by 1, 2 having count(*) >= 60),
ys as (select ticker, min(y) first_year, max(y) last_year, count(*) n_years, min(r) min_yearly_return, avg(r) avg_yearly_return from yr group by 1),
wr as (select ticker, ln(close_price / lag(close_price) over w) r, close_price / max(close_price) over (w rows unbounded preceding) - 1 dd from weekly_closes window w as (partition by ticker order by week)),
wv as (select ticker, stddev_samp(r) * sqrt(52.0) weekly_volatility, count(r) n_weekly_returns, min(dd) max_drawdown from wr group by 1)
;
select *, row_number() over (order by weekly_volatility, avg_yearly_return desc, ticker) rank from ys join wv using (ticker) where n_years >= 5 and max_drawdown >= -0.1865 and avg_yearly_return >= 0 and weekly_volatility is not null"""
SCREEN_COLS = "rank i, ticker s, first_year i, last_year i, n_years i, min_yearly_return n, avg_yearly_return n, max_drawdown n, weekly_volatility n, n_weekly_returns i"


@add("p17_w24_drawdown_screen", SCREEN_COLS, ["daily_prices", "weekly_closes"], SCREEN_SQL)
def drawdown_screen(spark, sf):
    return screen.drawdown_screen(views.daily_prices(spark, sf), **SCREEN)


# --- joins ---


@add("j1_j15_metadata_join", "ticker s, ann_vol n, vol_combined n, start_date d", ["wpanel", "cands"], "select v.ticker, ann_vol, vol_combined, start_date from (select ticker, stddev_samp(log_ret) * sqrt(52.0) ann_vol from wpanel group by 1) v left join cands c on c.ticker = v.ticker")
def _(spark, sf):
    return panel.annual_volatility(views.wpanel(spark, sf), "weekly").join(views.cands(spark, sf), "ticker", "left")


@add("j4_attach_sessions", "symbol s, timestamp t, market_session s, regular_open n, prior_regular_close n, overnight_gap n", ["sessions_bars"], """
with g as (select symbol, session_date, arg_min(open, "timestamp") filter (market_session = 'regular') regular_open, arg_max("close", "timestamp") filter (market_session = 'regular') regular_close from sessions_bars group by 1, 2),
h as (select *, lag(regular_close) over (partition by symbol order by session_date) prior_regular_close from g)
;
select b.symbol, b."timestamp", market_session, regular_open, prior_regular_close, regular_open / prior_regular_close - 1 overnight_gap from sessions_bars b left join h on h.symbol = b.symbol and h.session_date = b.session_date""")
def _(spark, sf):
    b = views.sessions_bars(spark, sf)
    return sessions.attach(b, sessions.primitives(b))


ASOF_SQL = """
select b.symbol, b."timestamp", c."timestamp" ctx_ts, case when epoch_us(b."timestamp") - epoch_us(c."timestamp") <= {limit} then c."close" end ctx_close, coalesce(epoch_us(b."timestamp") - epoch_us(c."timestamp") > {limit}, false)::int is_stale, epoch_us(b."timestamp") - epoch_us(c."timestamp") lag_us
from minute_bars b asof left join (select *, "timestamp" + interval 5 minute avail from minute_bars where symbol = 'error') c on {on} b."timestamp" >= c.avail"""


def _asof_out(df, name):
    return df.select("symbol", "timestamp", F.col(f"{name}_context_timestamp").alias("ctx_ts"), "ctx_close", F.col(f"{name}_is_stale").cast("int").alias("is_stale"), F.round(F.col(f"{name}_effective_lag_minutes") * 60e6).alias("lag_us"))


@add("j5_j8_asof_global", "symbol s, timestamp t, ctx_ts t, ctx_close n, is_stale i, lag_us i", ["minute_bars"], ASOF_SQL.format(limit=1800 * 1000000, on=""))
def _(spark, sf):
    b = views.minute_bars(spark, sf)
    spec = asof.ContextSpec("err", lag="5min", max_staleness="30min", rename={"close": "ctx_close"})
    return _asof_out(asof.context_join(b, b.where("symbol = 'error'"), spec), "err")


@add("j6_asof_by_symbol", "symbol s, timestamp t, ctx_ts t, ctx_close n, is_stale i, lag_us i", ["minute_bars"], ASOF_SQL.format(limit=7200 * 1000000, on="b.symbol = c.symbol and").replace("where symbol = 'error'", "where hour(\"timestamp\") % 2 = 0"))
def _(spark, sf):
    b = views.minute_bars(spark, sf)
    spec = asof.ContextSpec("even", lag="5min", max_staleness="2h", join_on_symbol=True, rename={"close": "ctx_close"})
    return _asof_out(asof.context_join(b, b.where("hour(timestamp) % 2 = 0"), spec), "even")


@add("j7_exact_join", "symbol s, timestamp t, ctx_close n", ["hourly_bars"], """
select b.symbol, b."timestamp", c."close" ctx_close from hourly_bars b left join (select * from hourly_bars where symbol = 'view') c on c."timestamp" + interval 1 hour = b."timestamp" """)
def _(spark, sf):
    b = views.hourly_bars(spark, sf)
    return asof.context_join(b, b.where("symbol = 'view'"), asof.ContextSpec("view", lag="1h", align="exact", rename={"close": "ctx_close"}))


@add("j9_a22_context_audit", "context_name s, n_rows i, null_rate n, stale_rate n, mean_effective_lag_minutes n4, max_effective_lag_minutes n4", ["minute_bars"], """
with e as (select b."timestamp" t, c."timestamp" ct from minute_bars b asof left join (select * from minute_bars where symbol = 'error') c on b."timestamp" >= c."timestamp"),
v as (select b."timestamp" t, c."timestamp" ct from minute_bars b asof left join (select *, "timestamp" + interval 1 minute avail from minute_bars where symbol = 'view') c on b."timestamp" >= c.avail),
u as (select 'err' context_name, *, 1800 lim from e union all select 'view', *, 1e15 lim from v), a as (select *, (epoch_us(t) - epoch_us(ct)) / 1e6 age from u)
;
select context_name, count(*) n_rows, avg(case when ct is null or age > lim then 1.0 else 0 end) null_rate, avg(case when age > lim then 1.0 else 0 end) stale_rate, avg(age) / 60 mean_effective_lag_minutes, max(age) / 60 max_effective_lag_minutes from a group by 1""")
def _(spark, sf):
    b = views.minute_bars(spark, sf)
    specs = [asof.ContextSpec("err", max_staleness="30min", rename={"close": "c1"}), asof.ContextSpec("view", lag="1min", rename={"close": "c2"})]
    return asof.context_audit(asof.context_joins(b, {"err": b.where("symbol = 'error'"), "view": b.where("symbol = 'view'")}, specs), specs)


BUCKET = "make_timestamp(cast(ceil(epoch_us(\"timestamp\") / {s}e6) * {s} as bigint) * 1000000)"


@add("j10_timeframe_feature", "symbol s, timestamp t, r15 n", ["minute_bars"], f"""
with c as (select symbol, {BUCKET.format(s=900)} bucket, arg_max("close", "timestamp") "close" from minute_bars group by 1, 2), f as (select symbol, bucket, ln("close" / lag("close") over (partition by symbol order by bucket)) r15 from c)
;
select b.symbol, b."timestamp", f.r15 from minute_bars b asof left join f on f.symbol = b.symbol and b."timestamp" >= f.bucket""")
def _(spark, sf):
    return features.run_features(views.minute_bars(spark, sf), [{"name": "r15", "kind": "log_return", "timeframe": 15}])


@add("j12_symbol_metadata", "symbol s, peer_group s, n i", ["minute_bars"], "select symbol, case when symbol in ('view', 'click') then 'web' when symbol = 'error' then 'ops' end peer_group, count(*) n from minute_bars group by 1, 2")
def _(spark, sf):
    meta = spark.createDataFrame([("view", "web"), ("click", "web"), ("error", "ops")], "symbol string, peer_group string")
    return features.attach_metadata(views.minute_bars(spark, sf), meta).groupBy("symbol", "peer_group").agg(F.count("*").alias("n"))


@add("j17_cutoff_sensitivity", "cutoff_year i, eligible i", ["cands"], "select y cutoff_year, (select count(*) from cands where year(start_date) <= y) eligible from range(1994, 2003) r(y)")
def _(spark, sf):
    return screen.cutoff_sensitivity(views.cands(spark, sf), 1994, 2002)


# --- aggregates ---


@add("a1_t1_volume_by_year", "ticker s, vol_1996 n, vol_combined n, start_date d", ["cands"], "select * from cands")
def _(spark, sf):
    return views.cands(spark, sf)


@add("a2_first_dates", "symbol s, start_date d", ["universe_rows"], "select symbol, min(cast(\"timestamp\" as date)) start_date from universe_rows group by 1")
def _(spark, sf):
    return screen.first_dates(views.universe_rows(spark, sf))


@add("a3_s9_daily_bars", "ticker s, date d, close_price n, volume n", ["minute_bars"], "select symbol ticker, cast(\"timestamp\" as date) date, arg_max(\"close\", \"timestamp\") close_price, sum(volume) volume from minute_bars group by 1, 2")
def _(spark, sf):
    return screen.daily_bars(views.minute_bars(spark, sf))


STATS_SQL = """
with w as (select *, exp(sum(log_ret) over (partition by ticker order by idx)) wealth from wpanel), d as (select *, 1 - wealth / max(wealth) over (partition by ticker order by idx) dd from w)
;
select ticker, avg(log_ret) * 52 ann_return, stddev_samp(log_ret) * sqrt(52.0) ann_vol, (avg(log_ret) * 52 - 0.05) / (stddev_samp(log_ret) * sqrt(52.0)) sharpe, max(dd) max_drawdown from d group by 1"""


@add("a5_w6_w7_ticker_stats", "ticker s, ann_return n, ann_vol n, sharpe n, max_drawdown n", ["wpanel"], STATS_SQL)
def _(spark, sf):
    return panel.ticker_stats(views.wpanel(spark, sf), "weekly")


@add("a6_total_log_return", "ticker s, total_log_return n", ["wpanel"], "select ticker, coalesce(sum(log_ret), 0) total_log_return from wpanel group by 1")
def _(spark, sf):
    return panel.total_log_return(views.wpanel(spark, sf))


@add("a7_average_yearly_return", "ticker s, avg_yearly_return n", ["wpanel"], "select ticker, coalesce(sum(log_ret), 0) / (select count(distinct year(date)) from wpanel) avg_yearly_return from wpanel group by 1")
def _(spark, sf):
    return panel.average_yearly_return(views.wpanel(spark, sf))


SESSION_COLS = "symbol s, session_date d, overnight_open n, premarket_high n, regular_open n, regular_close n, regular_low n, regular_volume n, regular_bar_count i, postmarket_end_timestamp t, regular_return n, premarket_return n, prior_regular_close n, prior_regular_range n, overnight_gap n, next_regular_close n, next_regular_close_timestamp t, asof_timestamp t"
SESSION_SQL = """
with g as (select symbol, session_date, arg_min(open, "timestamp") filter (market_session = 'overnight') overnight_open, max(high) filter (market_session = 'premarket') premarket_high, arg_min(open, "timestamp") filter (market_session = 'premarket') po, arg_max("close", "timestamp") filter (market_session = 'premarket') pc,
 arg_min(open, "timestamp") filter (market_session = 'regular') regular_open, arg_max("close", "timestamp") filter (market_session = 'regular') regular_close, min(low) filter (market_session = 'regular') regular_low, max(high) filter (market_session = 'regular') rh, sum(volume) filter (market_session = 'regular') regular_volume,
 nullif(count(*) filter (market_session = 'regular'), 0) regular_bar_count, max("timestamp") filter (market_session = 'postmarket') postmarket_end_timestamp, max("timestamp") filter (market_session = 'regular') ret from sessions_bars group by 1, 2)
;
select *, regular_close / regular_open - 1 regular_return, pc / po - 1 premarket_return, lag(regular_close) over w prior_regular_close, (lag(rh) over w - lag(regular_low) over w) / lag(regular_close) over w prior_regular_range, regular_open / lag(regular_close) over w - 1 overnight_gap, lead(regular_close) over w next_regular_close, lead(ret) over w next_regular_close_timestamp, coalesce(ret, postmarket_end_timestamp) asof_timestamp from g window w as (partition by symbol order by session_date)"""


@add("a8_j3_w8_w9_w18_session_primitives", SESSION_COLS, ["sessions_bars"], SESSION_SQL)
def _(spark, sf):
    return sessions.primitives(views.sessions_bars(spark, sf))


@add("a9_annual_volatility", "ticker s, ann_vol n", ["wpanel"], "select ticker, stddev_samp(log_ret) * sqrt(52.0) ann_vol from wpanel group by 1")
def _(spark, sf):
    return panel.annual_volatility(views.wpanel(spark, sf), "weekly")


@add("a10_yearly_returns", "ticker s, year i, first_date d, last_date d, first_price n, last_price n, n_price_days i, yearly_return n", ["daily_prices"], """
select ticker, year(date) "year", min(date) first_date, max(date) last_date, arg_min(close_price, date) first_price, arg_max(close_price, date) last_price, count(*) n_price_days, arg_max(close_price, date) / arg_min(close_price, date) - 1 yearly_return from daily_prices group by 1, 2 having count(*) >= 60""")
def _(spark, sf):
    return screen.yearly_returns(views.daily_prices(spark, sf), 60)


@add("a11_yearly_summary", "ticker s, first_year i, last_year i, n_years i, min_yearly_return n, avg_yearly_return n", ["daily_prices"], """
with yr as (select ticker, year(date) y, arg_max(close_price, date) / arg_min(close_price, date) - 1 r from daily_prices group by 1, 2 having count(*) >= 60)
;
select ticker, min(y) first_year, max(y) last_year, count(*) n_years, min(r) min_yearly_return, avg(r) avg_yearly_return from yr group by 1""")
def _(spark, sf):
    return screen.yearly_summary(screen.yearly_returns(views.daily_prices(spark, sf), 60))


PAIR_SQL = "select a.ticker ticker_i, b.ticker ticker_j, {f} value from {v} a join {v} b using (date) group by 1, 2"
CORR = PAIR_SQL.format(f="corr(a.x, b.x)", v="dranks")


@add("a12_average_abs_correlation", "ticker s, avg_abs_corr n", ["dranks"], f"select ticker_i ticker, avg(abs(value)) filter (ticker_i <> ticker_j) avg_abs_corr from ({CORR}) group by 1")
def _(spark, sf):
    return matrices.average_abs_correlation(matrices.spearman(views.dpanel(spark, sf)))


@add("a13_j16_spearman", "ticker_i s, ticker_j s, value n", ["dranks"], CORR)
def _(spark, sf):
    return matrices.spearman(views.dpanel(spark, sf))


@add("a13_spearman_vectors", "ticker_i s, ticker_j s, value n", ["dranks"], CORR)
def _(spark, sf):
    return matrices.spearman_vectors(views.dpanel(spark, sf))


DISTANCE = f"select ticker_i, ticker_j, case when ticker_i = ticker_j then 0 else sqrt(greatest(0, least(1, (1 - value) / 2))) end value from ({CORR})"


@add("a14_distance", "ticker_i s, ticker_j s, value n", ["dranks"], DISTANCE)
def _(spark, sf):
    return matrices.distance(matrices.spearman(views.dpanel(spark, sf)))


@add("a15_covariance", "ticker_i s, ticker_j s, value n", ["dfilled"], PAIR_SQL.format(f="covar_samp(a.x, b.x)", v="dfilled"))
def _(spark, sf):
    return matrices.covariance(views.dpanel(spark, sf))


WEEK_SQL = "select ticker, ln(close_price / lag(close_price) over w) r, close_price / max(close_price) over (w rows unbounded preceding) - 1 dd from weekly_closes window w as (partition by ticker order by week)"


@add("a16_w2_weekly_volatility", "ticker s, weekly_volatility n, n_weekly_returns i", ["weekly_closes"], f"select ticker, stddev_samp(r) * sqrt(52.0) weekly_volatility, count(r) n_weekly_returns from ({WEEK_SQL}) group by 1 having stddev_samp(r) is not null")
def _(spark, sf):
    return screen.weekly_volatility(views.daily_prices(spark, sf))


@add("a17_weekly_drawdown", "ticker s, max_drawdown n", ["weekly_closes"], f"select ticker, min(dd) max_drawdown from ({WEEK_SQL}) group by 1")
def _(spark, sf):
    return screen.weekly_drawdown(views.daily_prices(spark, sf))


RV_SQL = """
with r as (select symbol, session_date, ln("close" / lag("close") over (partition by symbol, session_date order by "timestamp")) r from sessions_bars), g as (select symbol, session_date, stddev_samp(r) realized_volatility from r group by 1, 2)
;
select *, lead(realized_volatility) over (partition by symbol order by session_date) next_realized_volatility from g"""


@add("a18_w10_session_volatility", "symbol s, session_date d, realized_volatility n, next_realized_volatility n", ["sessions_bars"], RV_SQL)
def _(spark, sf):
    return features.session_volatility(views.sessions_bars(spark, sf))


@add("a19_inception_summary", "inception_year i, count i, cumulative i, pct n1, cumulative_pct n1", ["cands"], """
with b as (select year(start_date) inception_year, count(*) "count" from cands group by 1), s as (select *, sum("count") over (order by inception_year) cumulative, sum("count") over () total from b)
;
select inception_year, "count", cumulative, round_even("count" / total::double * 100, 1) pct, round_even(cumulative / total::double * 100, 1) cumulative_pct from s""")
def _(spark, sf):
    return screen.inception_summary(views.cands(spark, sf))


@add("a20_t5_tickers_by_year", "inception_year i, tickers s", ["cands"], "select year(start_date) inception_year, array_to_string(list(ticker order by vol_combined desc, ticker)[1:10], ',') tickers from cands group by 1")
def _(spark, sf):
    return screen.tickers_by_year(views.cands(spark, sf), 10).withColumn("tickers", F.concat_ws(",", "tickers"))


WEIGHTS = {"1-URGENT": 0.4, "2-HIGH": 0.3, "5-LOW": 0.3}
CURVE = """
with p0 as (select * from dense_prices where ticker in ('1-URGENT', '2-HIGH', '5-LOW')), g as (select d.date, t.ticker, last_value(p.close_price ignore nulls) over (partition by t.ticker order by d.date) px from (select distinct date from p0) d cross join (select distinct ticker from p0) t left join p0 p on p.date = d.date and p.ticker = t.ticker),
al as (select *, count(px) over (partition by date) k from g), a as (select * from al where k = 3),
sh as (select ticker, (case ticker when '1-URGENT' then 0.4 else 0.3 end) * 10000.0 / arg_min(px, date) shares from a group by 1), v as (select date, sum(shares * px) portfolio_value from a join sh using (ticker) group by 1),
c as (select date, portfolio_value, coalesce(ln(portfolio_value / lag(portfolio_value) over (order by date)), 0) log_return, 1 - portfolio_value / max(portfolio_value) over (order by date) drawdown, row_number() over (order by date) i from v)
;
"""


@add("w5_w25_equity_curve", "date d, portfolio_value n3, log_return n, drawdown n", ["dense_prices"], CURVE + "select * from c")
def _(spark, sf):
    return backtest.equity_curve(views.dense_prices(spark, sf), WEIGHTS)


@add("a21_backtest_metrics", "start_date d, end_date d, n_trading_days i, final_value n2, total_log_return n4, ann_return n4, ann_vol n4, sharpe n4, max_drawdown n4, calmar n4", ["dense_prices"], CURVE + """
select min(date) start_date, max(date) end_date, count(*) n_trading_days, arg_max(portfolio_value, date) final_value, ln(arg_max(portfolio_value, date) / 10000.0) total_log_return, avg(log_return) filter (i > 1) * 252 ann_return, stddev_samp(log_return) filter (i > 1) * sqrt(252.0) ann_vol, (avg(log_return) filter (i > 1) * 252 - 0.05) / (stddev_samp(log_return) filter (i > 1) * sqrt(252.0)) sharpe, max(drawdown) max_drawdown, avg(log_return) filter (i > 1) * 252 / max(drawdown) calmar from c""")
def _(spark, sf):
    return backtest.metrics(backtest.equity_curve(views.dense_prices(spark, sf), WEIGHTS))


@add("x_simple_metrics", "start_date d, end_date d, n_assets i, n_trading_days i, final_value n2, total_return n, cagr n, annualized_return n, annualized_volatility n, sharpe_ratio n, sortino_ratio n, max_drawdown n, calmar_ratio n", ["dense_prices"], CURVE.replace("\n;", ",\nr as (select *, portfolio_value / lag(portfolio_value) over (order by date) - 1 r from c),\nm as (select min(date) start_date, max(date) end_date, 3 n_assets, count(*) n_trading_days, arg_max(portfolio_value, date) final_value, pow(arg_max(portfolio_value, date) / 10000.0, 252.0 / count(r)) - 1 cagr, avg(r) * 252 annualized_return, stddev_samp(r) * sqrt(252.0) annualized_volatility, sqrt(avg(pow(least(r, 0), 2)) filter (r is not null) * 252) down, -max(drawdown) max_drawdown from r)\n;") + """
select *, final_value / 10000.0 - 1 total_return, (annualized_return - 0.05) / annualized_volatility sharpe_ratio, (annualized_return - 0.05) / down sortino_ratio, cagr / -max_drawdown calmar_ratio from m""")
def _(spark, sf):
    return backtest.simple_metrics(backtest.equity_curve(views.dense_prices(spark, sf), WEIGHTS), len(WEIGHTS))


@add("x_allocation_summary", "strategy s, ann_return n, total_return n, cagr n, ann_vol n, sharpe n, max_drawdown n, calmar_ratio n, final_value n2, n_etfs i, min_weight n, nonzero_positions i, top_weight n, effective_n n", ["dense_prices"], CURVE.replace("\n;", ",\nm as (select avg(log_return) filter (i > 1) * 252 ann_return, stddev_samp(log_return) filter (i > 1) * sqrt(252.0) ann_vol, max(drawdown) max_drawdown, arg_max(portfolio_value, date) final_value, pow(arg_max(portfolio_value, date) / 10000.0, 252.0 / (count(*) - 1)) - 1 cagr from c)\n;") + """
select 'tilted' strategy, *, final_value / 10000.0 - 1 total_return, (ann_return - 0.05) / ann_vol sharpe, cagr / max_drawdown calmar_ratio, 3 n_etfs, 0.3 min_weight, 3 nonzero_positions, 0.4 top_weight, 1 / (0.16 + 0.09 + 0.09) effective_n from m""")
def _(spark, sf):
    w = spark.createDataFrame([("tilted", t, x) for t, x in WEIGHTS.items()], "strategy string, ticker string, weight double")
    return backtest.allocation_summary(views.dense_prices(spark, sf), w)


@add("x_holdings", "ticker s, entry_price n3, shares n, final_value n3, initial_weight n, final_weight n", ["dense_prices"], CURVE + """
select ticker, arg_min(px, date) entry_price, max(shares) shares, max(shares) * arg_max(px, date) final_value, case ticker when '1-URGENT' then 0.4 else 0.3 end initial_weight, max(shares) * arg_max(px, date) / sum(max(shares) * arg_max(px, date)) over () final_weight from a join sh using (ticker) group by 1""")
def _(spark, sf):
    return backtest.holdings(views.dense_prices(spark, sf), WEIGHTS)


BASKETS = [("m1", ["a", "b", "c"]), ("m2", ["b", "d"]), ("m3", ["c", "b", "e", "f"])]
BASKET_SQL = "values " + ", ".join(f"('{m}', {i}, '{t}')" for m, ts in BASKETS for i, t in enumerate(ts, 1))


def _baskets(spark):
    return spark.createDataFrame([(m, i, t) for m, ts in BASKETS for i, t in enumerate(ts, 1)], "method string, rank int, ticker string")


@add("a24_membership", "ticker s, selection_count i, missing_rank_count i, average_rank_selected_only n, average_rank n", [], f"""
with b as (select * from ({BASKET_SQL}) t(method, rank, ticker)), s as (select method, max(rank) + 1 penalty from b group by 1), f as (select t.ticker, s.method, b.rank, penalty from (select distinct ticker from b) t cross join s left join b on b.method = s.method and b.ticker = t.ticker)
;
select ticker, count(rank) selection_count, count(*) - count(rank) missing_rank_count, avg(rank) average_rank_selected_only, avg(coalesce(rank, penalty)) average_rank from f group by 1""")
def _(spark, sf):
    return selection.membership(_baskets(spark))


@add("t6_consensus", "ticker s, selection_count i, m1_rank i, m2_rank i, m3_rank i", [], f"""
with b as (select * from ({BASKET_SQL}) t(method, rank, ticker)), s as (select method, max(rank) + 1 penalty from b group by 1), f as (select t.ticker, s.method, b.rank, penalty from (select distinct ticker from b) t cross join s left join b on b.method = s.method and b.ticker = t.ticker)
;
select ticker, count(rank) selection_count, max(rank) filter (method = 'm1') m1_rank, max(rank) filter (method = 'm2') m2_rank, max(rank) filter (method = 'm3') m3_rank from f group by 1 order by avg(coalesce(rank, penalty)), avg(rank), count(*) - count(rank), ticker limit 4""")
def _(spark, sf):
    return selection.consensus(_baskets(spark), 4)


MERGED_STATS = [("a", 0.5), ("b", -0.25), ("c", 1.0), ("d", None)]


@add("x_merged_membership", "ticker s, m1 i, m2 i, m3 i, method_count i, is_anchor i, sharpe n, avg_method_sharpe n", [], f"""
with b as (select * from ({BASKET_SQL}) t(method, rank, ticker)), s as (select * from (values {", ".join(f"('{t}', cast({'null' if v is None else v} as double))" for t, v in MERGED_STATS)}) t(ticker, sharpe))
;
select ticker, max(cast(method = 'm1' as int)) m1, max(cast(method = 'm2' as int)) m2, max(cast(method = 'm3' as int)) m3, count(*) method_count, cast(ticker = 'b' as int) is_anchor, max(sharpe) sharpe, max(sharpe) avg_method_sharpe from b left join s using (ticker) group by 1""")
def _(spark, sf):
    return selection.merged(_baskets(spark), spark.createDataFrame(MERGED_STATS, "ticker string, sharpe double"), ["b"])


@add("a25_overlap", "method_a s, method_b s, n_common i", [], f"""
with b as (select * from ({BASKET_SQL}) t(method, rank, ticker))
;
select x.method method_a, y.method method_b, (select count(*) from b p join b q on p.ticker = q.ticker where p.method = x.method and q.method = y.method) n_common from (select distinct method from b) x cross join (select distinct method from b) y""")
def _(spark, sf):
    return selection.overlap(_baskets(spark))


@add("u2_u4_basket_sets", "kind s, ticker s", [], f"""
with b as (select * from ({BASKET_SQL}) t(method, rank, ticker))
;
select distinct 'union' kind, ticker from b union all select 'common', ticker from b where method = 'm1' and ticker in (select ticker from b where method = 'm3') union all select 'missing', ticker from b where method = 'm3' and ticker not in (select ticker from b where method = 'm1')""")
def _(spark, sf):
    b = _baskets(spark)
    one = {m: b.where(F.col("method") == m).select("ticker") for m, _ in BASKETS}
    tag = lambda k, df: df.select(F.lit(k).alias("kind"), "ticker")
    return tag("union", b.select("ticker").distinct()).unionByName(tag("common", one["m1"].intersect(one["m3"]))).unionByName(tag("missing", one["m3"].exceptAll(one["m1"])))


@add("a26_portfolio_stats", "strategy s, ann_return n, ann_vol n, sharpe n, div_ratio n, eff_n n", ["dpanel", "dfilled"], f"""
with w as (select ticker, case when ticker = '1-URGENT' then 0.4 else 0.15 end w from (select distinct ticker from dpanel)), m as (select ticker, avg(x) mu from dfilled group by 1), c as ({PAIR_SQL.format(f="covar_samp(a.x, b.x)", v="dfilled")}),
pv as (select sum(wi.w * wj.w * value) v from c join w wi on wi.ticker = ticker_i join w wj on wj.ticker = ticker_j), t as (select sum(w.w * mu) mu, sum(w.w * sqrt(value)) sd, sum(w.w * w.w) ww from w join m using (ticker) join c on ticker_i = w.ticker and ticker_j = w.ticker)
;
select 'tilted' strategy, mu * 252 ann_return, sqrt(v * 252) ann_vol, (mu * 252 - 0.05) / sqrt(v * 252) sharpe, sd / sqrt(v) div_ratio, 1 / ww eff_n from t, pv""")
def _(spark, sf):
    p = views.dpanel(spark, sf)
    x = matrices.filled(p)
    w = p.select("ticker").distinct().select(F.lit("tilted").alias("strategy"), "ticker", F.when(F.col("ticker") == "1-URGENT", 0.4).otherwise(0.15).alias("weight"))
    return allocation.portfolio_stats(w, x.groupBy("ticker").agg(F.avg("x").alias("mean_ret")), matrices.covariance(p))


@add("a27_pearson_simple", "ticker_i s, ticker_j s, value n", ["dense_prices"], """
with k as (select *, count(*) over (partition by date) n from dense_prices), r as (select ticker, date, close_price / lag(close_price) over (partition by ticker order by date) - 1 x from k where n = (select count(distinct ticker) from dense_prices))
;
select a.ticker ticker_i, b.ticker ticker_j, corr(a.x, b.x) value from (select * from r where x is not null) a join (select * from r where x is not null) b using (date) group by 1, 2""")
def _(spark, sf):
    return matrices.pearson_simple(views.dense_prices(spark, sf))


@add("a23_method_summary", "method s, n i, avg_volume n", ["cands"], """
with r as (select *, row_number() over (order by vol_combined desc, ticker) k from cands)
;
select case when k <= 20 then 'top' when k <= 40 then 'mid' else 'low' end "method", count(*) n, avg(vol_combined) avg_volume from r group by 1""")
def _(spark, sf):
    k = F.row_number().over(W.orderBy(F.desc("vol_combined"), "ticker"))
    r = views.cands(spark, sf).withColumn("k", k)
    return r.groupBy(F.when(F.col("k") <= 20, "top").when(F.col("k") <= 40, "mid").otherwise("low").alias("method")).agg(F.count("*").alias("n"), F.avg("vol_combined").alias("avg_volume"))


# --- windows ---


@add("w1_return_panel", "ticker s, date d, idx i, log_ret n", ["wpanel"], "select * from wpanel")
def _(spark, sf):
    return views.wpanel(spark, sf)


@add("w3_weekly_closes", "ticker s, week d, close_price n", ["weekly_closes"], "select * from weekly_closes")
def _(spark, sf):
    return screen.weekly_closes(views.daily_prices(spark, sf))


def _bars_sql(seconds):
    return f"""select symbol, {BUCKET.format(s=seconds)} "timestamp", arg_min(open, "timestamp") open, max(high) high, min(low) low, arg_max("close", "timestamp") "close", sum(volume) volume from minute_bars group by 1, {BUCKET.format(s=seconds)}"""


@add("w4_resample_5min", "symbol s, timestamp t, open n, high n, low n, close n, volume n", ["minute_bars"], _bars_sql(300))
def _(spark, sf):
    return features.resample(views.minute_bars(spark, sf), 5)


@add("w4_resample_15min", "symbol s, timestamp t, open n, high n, low n, close n, volume n", ["minute_bars"], _bars_sql(900))
def _(spark, sf):
    return features.resample(views.minute_bars(spark, sf), 15)


FEATURE_SPECS = [
    {"name": "r1", "kind": "log_return", "window": 1},
    {"name": "r3", "kind": "log_return", "window": 3},
    {"name": "rv30", "kind": "realized_volatility", "window": 30},
    {"name": "range30", "kind": "range", "window": 30},
    {"name": "lvl", "kind": "level", "column": "volume"},
    {"name": "rel", "kind": "relative_return", "benchmark": "bench"},
    {"name": "beta60", "kind": "beta_residual", "window": 60, "benchmark": "bench"},
    {"name": "liq60", "kind": "liquidity_surprise", "window": 60},
    {"name": "rsi14", "kind": "rsi", "window": 14},
]
FEATURE_SQL = """
with j as (select b.*, c."close" bench from minute_bars b asof left join (select * from minute_bars where symbol = 'view') c on b."timestamp" >= c."timestamp"),
i as (select *, ln("close" / lag("close") over w) r, ln(bench / lag(bench) over w) b, (high - low) / nullif("close", 0) rg, "close" - lag("close") over w d from j window w as (partition by symbol order by "timestamp")),
f as (select *, r r1, ln("close" / lag("close", 3) over w) r3, case when count(r) over w30 = 30 then stddev_samp(r) over w30 end rv30, case when count(rg) over w30 = 30 then avg(rg) over w30 end range30, volume lvl, r - b rel,
 case when count(case when r is not null and b is not null then 1 end) over w60 = 60 then r - covar_samp(r, b) over w60 / nullif(var_samp(b) over w60, 0) * b end beta60,
 case when count(volume) over w60 = 60 then volume / avg(volume) over w60 - 1 end liq60,
 case when count(d) over w14 = 14 then 100 - 100 / (1 + avg(greatest(d, 0)) over w14 / nullif(avg(greatest(-d, 0)) over w14, 0)) end rsi14
 from i window w as (partition by symbol order by "timestamp"), w30 as (partition by symbol order by "timestamp" rows 29 preceding), w60 as (partition by symbol order by "timestamp" rows 59 preceding), w14 as (partition by symbol order by "timestamp" rows 13 preceding))
;
"""


def _features(spark, sf):
    b = views.minute_bars(spark, sf)
    j = asof.context_join(b, b.where("symbol = 'view'"), asof.ContextSpec("view", rename={"close": "bench"}))
    return features.run_features(j, FEATURE_SPECS)


@add("w11_w17_features", "symbol s, timestamp t, r1 n, r3 n, rv30 n, range30 n, lvl n, rel n, beta60 n5, liq60 n, rsi14 n4", ["minute_bars"], FEATURE_SQL + "select * from f")
def _(spark, sf):
    return _features(spark, sf)


BENCH_SPECS = [{"name": f"beta_{b}", "kind": "beta_residual", "window": n, "benchmark": b} for b, n in (("b1", 60), ("b2", 60), ("b1x", 20))]


@add("w15_two_benchmarks", "symbol s, timestamp t, beta_b1 n5, beta_b2 n5, beta_b1x n5", ["minute_bars"], """
with j as (select b.*, c."close" b1 from minute_bars b asof left join (select * from minute_bars where symbol = 'view') c on b."timestamp" >= c."timestamp"),
j2 as (select j.*, c."close" b2 from j asof left join (select * from minute_bars where symbol = 'click') c on j."timestamp" >= c."timestamp"),
i as (select *, ln("close" / lag("close") over w) r, ln(b1 / lag(b1) over w) x, ln(b2 / lag(b2) over w) y from j2 window w as (partition by symbol order by "timestamp"))
;
select symbol, "timestamp", case when count(case when r is not null and x is not null then 1 end) over w60 = 60 then r - covar_samp(r, x) over w60 / nullif(var_samp(x) over w60, 0) * x end beta_b1,
 case when count(case when r is not null and y is not null then 1 end) over w60 = 60 then r - covar_samp(r, y) over w60 / nullif(var_samp(y) over w60, 0) * y end beta_b2,
 case when count(case when r is not null and x is not null then 1 end) over w20 = 20 then r - covar_samp(r, x) over w20 / nullif(var_samp(x) over w20, 0) * x end beta_b1x
from i window w60 as (partition by symbol order by "timestamp" rows 59 preceding), w20 as (partition by symbol order by "timestamp" rows 19 preceding)""")
def _(spark, sf):
    b = views.minute_bars(spark, sf)
    j = asof.context_join(b, b.where("symbol = 'view'"), asof.ContextSpec("view", rename={"close": "b1"}))
    j = asof.context_join(j, b.where("symbol = 'click'"), asof.ContextSpec("click", rename={"close": "b2"}))
    return features.run_features(j.withColumn("b1x", F.col("b1")), BENCH_SPECS)


@add("a22_feature_manifest", "name s, kind s, null_rate n", ["minute_bars"], FEATURE_SQL + " union all ".join(f"select '{s['name']}' name, '{s['kind']}' kind, avg(case when {s['name']} is null then 1.0 else 0 end) null_rate from f" for s in FEATURE_SPECS))
def _(spark, sf):
    return features.manifest(_features(spark, sf), FEATURE_SPECS)


@add("w18_session_features", "symbol s, timestamp t, from_open n, gap n, prior_ret n, prior_range n", ["sessions_bars"], """
with g as (select symbol, session_date, arg_min(open, "timestamp") filter (market_session = 'regular') ro, arg_max("close", "timestamp") filter (market_session = 'regular') rc, max(high) filter (market_session = 'regular') rh, min(low) filter (market_session = 'regular') rl from sessions_bars group by 1, 2),
h as (select *, lag(rc) over w prc, lag(rc / ro - 1) over w prr, (lag(rh) over w - lag(rl) over w) / lag(rc) over w prg from g window w as (partition by symbol order by session_date))
;
select b.symbol, b."timestamp", b."close" / ro - 1 from_open, ro / prc - 1 gap, prr prior_ret, prg prior_range from sessions_bars b left join h on h.symbol = b.symbol and h.session_date = b.session_date where market_session = 'regular'""")
def _(spark, sf):
    b = views.sessions_bars(spark, sf)
    full = sessions.regular_bars(sessions.attach(b, sessions.primitives(b)))
    return features.run_features(full, [{"name": "from_open", "kind": "session_return_from_open"}, {"name": "gap", "kind": "overnight_gap"}, {"name": "prior_ret", "kind": "prior_session_return"}, {"name": "prior_range", "kind": "prior_session_range"}])


XS_SPECS = [
    {"name": "z", "kind": "zscore", "column": "close"},
    {"name": "pr", "kind": "percentile_rank", "column": "close"},
    {"name": "resid", "kind": "benchmark_residual", "column": "close", "benchmark": "view"},
    {"name": "dm", "kind": "peer_group_demean", "column": "close"},
]


@add("w19_w22_j11_p18_cross_section", "symbol s, timestamp t, z n, pr n, resid n, dm n, q i", ["hourly_bars"], """
with m as (select *, case when symbol in ('view', 'click') then 'web' when symbol = 'error' then 'ops' end peer_group from hourly_bars),
p as (select *, (rank() over (partition by "timestamp" order by "close") + (count(*) over (partition by "timestamp", "close") - 1) / 2.0) / count("close") over (partition by "timestamp") pr from m)
;
select symbol, "timestamp", ("close" - avg("close") over t) / nullif(stddev_samp("close") over t, 0) z, pr, "close" - max("close") filter (symbol = 'view') over t resid, case when peer_group is not null then "close" - avg("close") over (partition by "timestamp", peer_group) end dm, greatest(1, least(5, ceil(pr * 5))) q from p window t as (partition by "timestamp")""")
def _(spark, sf):
    meta = spark.createDataFrame([("view", "web"), ("click", "web"), ("error", "ops")], "symbol string, peer_group string")
    x = features.run_cross_section(features.attach_metadata(views.hourly_bars(spark, sf), meta), XS_SPECS)
    return features.run_labels(x, [{"name": "q", "kind": "quantile", "column": "close", "quantiles": 5}])


@add("w23_j13_labels", "symbol s, timestamp t, next_ret n, next_vol n", ["sessions_bars"], """
with g as (select symbol, session_date, arg_max("close", "timestamp") filter (market_session = 'regular') rc from sessions_bars group by 1, 2), h as (select *, lead(rc) over (partition by symbol order by session_date) nrc from g),
rb as (select * from sessions_bars where market_session = 'regular'), r as (select symbol, session_date, ln("close" / lag("close") over (partition by symbol, session_date order by "timestamp")) r from rb), v as (select symbol, session_date, stddev_samp(r) rv from r group by 1, 2), nv as (select *, lead(rv) over (partition by symbol order by session_date) nrv from v)
;
select b.symbol, b."timestamp", nrc / b."close" - 1 next_ret, nrv next_vol from rb b left join h on h.symbol = b.symbol and h.session_date = b.session_date left join nv on nv.symbol = b.symbol and nv.session_date = b.session_date""")
def _(spark, sf):
    b = views.sessions_bars(spark, sf)
    full = sessions.regular_bars(sessions.attach(b, sessions.primitives(b)))
    return features.run_labels(full, [{"name": "next_ret", "kind": "next_regular_session_return"}, {"name": "next_vol", "kind": "next_regular_session_volatility"}])


# --- sorts, unions, artifacts ---


@add("t2_by_sharpe", "position i, ticker s, sharpe n", ["wpanel"], "select row_number() over (order by (avg(log_ret) * 52 - 0.05) / (stddev_samp(log_ret) * sqrt(52.0)) desc, ticker) position, ticker, (avg(log_ret) * 52 - 0.05) / (stddev_samp(log_ret) * sqrt(52.0)) sharpe from wpanel group by ticker")
def _(spark, sf):
    s = panel.ticker_stats(views.wpanel(spark, sf), "weekly")
    return s.withColumn("position", F.row_number().over(W.orderBy(F.desc("sharpe"), "ticker")))


@add("t3_first_dropped", "ticker s, coverage n", ["weekly_cov"], "select * from weekly_cov where coverage < 0.8 order by ticker limit 15")
def _(spark, sf):
    return panel.coverage(panel.gridded(views.daily_prices(spark, sf), "weekly")).where("coverage < 0.8").orderBy("ticker").limit(15)


@add("u1_union_sources", "source_alias s, symbol s, n i", ["minute_bars", "hourly_bars"], "select 'minute' source_alias, symbol, count(*) n from minute_bars group by 2 union all select 'hour', symbol, count(*) from hourly_bars group by 2")
def _(spark, sf):
    a = readers.normalize(views.minute_bars(spark, sf), alias="minute")
    return a.unionByName(readers.normalize(views.hourly_bars(spark, sf), alias="hour")).groupBy("source_alias", "symbol").agg(F.count("*").alias("n"))


@add("x_ticker_year_metrics", "ticker s, year i, n_price_days i, n_return_days i, total_return n, annualized_return n, annualized_volatility n, sharpe_ratio n", ["daily_prices"], """
with p as (select *, year(date) y, ln(close_price / lag(close_price) over (partition by ticker, year(date) order by date)) r from daily_prices)
;
select ticker, y "year", count(*) n_price_days, count(r) n_return_days, arg_max(close_price, date) / arg_min(close_price, date) - 1 total_return, avg(r) * 252 annualized_return, stddev_samp(r) * sqrt(252.0) annualized_volatility, (avg(r) * 252 - 0.05) / (stddev_samp(r) * sqrt(252.0)) sharpe_ratio from p group by 1, 2""")
def _(spark, sf):
    return screen.ticker_year_metrics(views.daily_prices(spark, sf))


@add("x_ticker_year_pivot", "ticker s, 1996 n, 1997 n", ["daily_prices"], """
with r as (select ticker, year(date) y, arg_max(close_price, date) / arg_min(close_price, date) - 1 t from daily_prices group by 1, 2)
;
select ticker, max(t) filter (y = 1996) "1996", max(t) filter (y = 1997) "1997" from r group by 1""")
def _(spark, sf):
    return screen.ticker_year_pivot(screen.ticker_year_metrics(views.daily_prices(spark, sf)), "total_return", [1996, 1997])


@add("x_weekly_correlation", "ticker_i s, ticker_j s, value n", ["dense_prices"], """
with k as (select ticker, date + cast((12 - dayofweek(date)) % 7 as integer) w, arg_max(close_price, date) px from dense_prices where close_price is not null group by 1, 2), r as (select ticker, w, ln(px / lag(px) over (partition by ticker order by w)) x from k), c as (select *, count(*) over (partition by w) n from r where x is not null), f as (select * from c where n = (select count(distinct ticker) from k))
;
select a.ticker ticker_i, b.ticker ticker_j, corr(a.x, b.x) value from f a join f b using (w) group by 1, 2""")
def _(spark, sf):
    return matrices.weekly_correlation(screen.weekly_closes(views.dense_prices(spark, sf)))


@add("x_volume_stats", "ticker s, trading_days i, total_volume n, average_daily_volume n, median_daily_volume n, min_daily_volume n, max_daily_volume n", ["daily_prices"], "select ticker, count(volume) trading_days, sum(volume) total_volume, avg(volume) average_daily_volume, median(volume) median_daily_volume, min(volume) min_daily_volume, max(volume) max_daily_volume from daily_prices where year(date) = 1998 group by 1")
def _(spark, sf):
    return screen.volume_stats(views.daily_prices(spark, sf), 1998)


# --- driver-side selectors and solvers: their inputs have SQL above; here their results ---


def _matrices(spark, sf, filled=None):
    import numpy as np

    x = matrices.filled(views.dpanel(spark, sf)).cache() if filled is None else filled  # one dense panel behind both matrices
    names, corr = matrices.to_matrix(matrices.spearman_filled(x))
    _, cov = matrices.to_matrix(matrices.covariance_filled(x), names)
    if filled is None:
        x.unpersist()
    d = np.sqrt(np.clip((1 - corr) / 2, 0, 1))
    np.fill_diagonal(d, 0)
    return names, corr, cov, d


def _volume(spark, sf):
    return {r["ticker"]: float(r["n"]) for r in views.dense_prices(spark, sf).groupBy("ticker").agg(F.sum("close_price").alias("n")).collect()}


#: A basket grown from its anchor by one ticker a step: `steps` tickers, `best` the value of a candidate over the rows
#: `rows` that join it with the basket, ties to the larger volume. Baskets are lists, so this suits few tickers only.
GROWN_SQL = """
pick(rank, ticker, marginal, chosen) as (
    select 1, '1-URGENT', cast(null as double), ['1-URGENT']
    union all
    select rank, ticker, best, list_append(chosen, ticker)
    from (select *, row_number() over (order by round(best, 12) desc, n desc, ticker) place
        from (select p.rank + 1 rank, p.chosen, v.ticker, v.n, {best} best from pick p join volume v on not list_contains(p.chosen, v.ticker) join {rows}
            where p.rank < {steps} group by all) candidates) ranked
    where place = 1)"""
VOLUME_SQL = "volume as materialized (select ticker, sum(close_price) n from dense_prices group by 1)"
MAXIMIN_SQL = f"with recursive d as materialized ({DISTANCE}), {VOLUME_SQL}, " + GROWN_SQL.replace("{best}", "min(d.value)").replace("{rows}", "d on d.ticker_i = v.ticker and list_contains(p.chosen, d.ticker_j)")
MAX_DR_SQL = f"with recursive c as materialized ({PAIR_SQL.format(f='covar_samp(a.x, b.x)', v='dfilled')}), {VOLUME_SQL}, " + GROWN_SQL.replace("{best}", "sum(case when c.ticker_i = c.ticker_j then sqrt(c.value) end) / sqrt(sum(c.value))").replace("{rows}", "c on list_contains(list_append(p.chosen, v.ticker), c.ticker_i) and list_contains(list_append(p.chosen, v.ticker), c.ticker_j)")
#: Medoids from the furthest points on: each round every ticker goes to its nearest medoid and every cluster but the anchor's to its central member, until nothing moves.
MEDOIDS_SQL = MAXIMIN_SQL.replace("{steps}", "3") + """,
moved(round, m, stable) as (
    select 0, chosen, false from pick where rank = 3
    union all
    select round + 1, new, new = m
    from (select round, m, list(ticker order by pos) new
        from (select *, row_number() over (partition by pos order by round(total, 12), n desc, ticker) place
            from (select o.round, o.m, o.pos, v.ticker, v.n, case when o.pos = 1 and v.ticker = o.m[1] then -1 else sum(d.value) end total
                from (select round, m, pos, list(ticker) members
                    from (select s.round, s.m, d.ticker_i ticker, list_position(s.m, d.ticker_j) pos
                        from moved s join d on list_contains(s.m, d.ticker_j) where not s.stable and s.round < 25
                        qualify row_number() over (partition by d.ticker_i order by d.value, list_position(s.m, d.ticker_j)) = 1) owned
                    group by all) o
                join volume v on list_contains(o.members, v.ticker) join d on d.ticker_i = v.ticker and list_contains(o.members, d.ticker_j)
                group by o.round, o.m, o.pos, v.ticker, v.n) totals) central
        where place = 1 group by round, m) one_round),
last as (select m from moved order by round desc limit 1),
owned as (select d.ticker_j ticker, d.value from last join d on list_contains(m, d.ticker_j) qualify row_number() over (partition by d.ticker_i order by d.value, list_position(m, d.ticker_j)) = 1)
select row_number() over (order by ticker <> '1-URGENT', count(*) desc, avg(value), ticker) selection_rank, ticker, count(*) cluster_size, avg(value) avg_cluster_distance, cast(ticker = '1-URGENT' as int) is_anchor_medoid from owned group by ticker"""


@add("o1_o2_greedy_maximin", "rank i, ticker s, marginal n", ["dranks", "dense_prices"], f"select * from ({MAXIMIN_SQL.replace('{steps}', '4')} select rank, ticker, marginal from pick) q")
def _(spark, sf):
    names, _, _, d = _matrices(spark, sf)
    return selection.basket(spark, selection.greedy_maximin(names, d, _volume(spark, sf), 4, ["1-URGENT"]))


@add("o3_k_medoids", "selection_rank i, ticker s, cluster_size i, avg_cluster_distance n, is_anchor_medoid i", ["dranks", "dense_prices"], f"select * from ({MEDOIDS_SQL}) q")
def _(spark, sf):
    names, _, _, d = _matrices(spark, sf)
    return spark.createDataFrame(selection.k_medoids(names, d, _volume(spark, sf), 3, ["1-URGENT"]), "selection_rank int, ticker string, cluster_size int, avg_cluster_distance double, is_anchor_medoid int")


@add("o4_greedy_max_dr", "rank i, ticker s, marginal n", ["dfilled", "dense_prices"], f"select * from ({MAX_DR_SQL.replace('{steps}', '4')} select rank, ticker, marginal from pick) q")
def _(spark, sf):
    names, _, cov, _ = _matrices(spark, sf)
    return selection.basket(spark, selection.greedy_max_dr(names, cov, _volume(spark, sf), 4, ["1-URGENT"]))


@add("o4_equal_weight_dr", "div_ratio n", ["dfilled"], f"select (select avg(sqrt(value)) from ({PAIR_SQL.format(f='covar_samp(a.x, b.x)', v='dfilled')}) where ticker_i = ticker_j) / sqrt((select sum(value) / (count(distinct ticker_i) * count(distinct ticker_i)) from ({PAIR_SQL.format(f='covar_samp(a.x, b.x)', v='dfilled')}))) div_ratio")
def _(spark, sf):
    _, _, cov, _ = _matrices(spark, sf)
    return spark.createDataFrame([(selection.equal_weight_dr(cov),)], "div_ratio double")


@add("u5_anchor_first", "rank i, ticker s, marginal n", ["dense_prices"], "select row_number() over (order by case ticker when '2-HIGH' then 0 when '5-LOW' then 1 else 2 end, ticker) rank, ticker, cast(null as double) marginal from (select distinct ticker from dense_prices) qualify rank <= 4")
def _(spark, sf):
    names = _matrices(spark, sf)[0]
    return selection.basket(spark, [(t, None) for t in selection.anchor_first(["5-LOW"], names, 4, ["2-HIGH"])])


@add("x_ward_selection", "ticker s, cluster_size i")
def _(spark, sf):
    names, _, _, d = _matrices(spark, sf)
    return spark.createDataFrame(selection.ward_selection(names, d, _volume(spark, sf), 3, ["1-URGENT"]), "ticker string, cluster_size int")


@add("x_pca_loadings", "pc_rank i, variance_explained n, ticker s, loading n")
def _(spark, sf):
    names, corr, _, _ = _matrices(spark, sf)
    return spark.createDataFrame(selection.pca_loadings(names, corr, 3), "pc_rank int, variance_explained double, ticker string, loading double")


@add("o5_o14_allocations", "strategy s, n i, total n, feasible i", [], """
select unnest(['equal_weight', 'min_variance', 'max_sharpe', 'risk_parity', 'max_diversification', 'min_cvar', 'hrp', 'shrinkage_sharpe', 'black_litterman', 'bl_momentum', 'kelly_half', 'robust_mv']) strategy, (select count(distinct o_orderpriority) from orders) n, 1.0 total, 1 feasible""")
def _(spark, sf):
    w = _allocations(spark, sf)
    return w.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.min(F.col("weight").between(0.05 - 1e-9, 0.5 + 1e-9).cast("int")).alias("feasible"))


@add("o6_o11_allocation_weights", "strategy s, ticker s, weight n4")
def _allocations(spark, sf):
    import numpy as np

    panel_ = matrices.filled(views.dpanel(spark, sf)).cache()
    names, _, cov, d = _matrices(spark, sf, panel_)
    x = panel_.collect()  # dates x tickers of one basket
    panel_.unpersist()
    at = {t: i for i, t in enumerate(names)}
    days = {t: i for i, t in enumerate(sorted({r["date"] for r in x}))}
    r = np.zeros((len(days), len(names)))
    for row in x:
        r[days[row["date"]], at[row["ticker"]]] = row["x"]
    return allocation.allocate(spark, names, r.mean(axis=0), cov, r, d, 0.05, 0.5)


@add("o12_equal_weight", "ticker s, weight n", ["dense_prices"], "select ticker, 1.0 / count(*) over () weight from (select distinct ticker from dense_prices)")
def _(spark, sf):
    return views.dense_prices(spark, sf).select("ticker").distinct().withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))


