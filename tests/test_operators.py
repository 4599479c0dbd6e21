"""Toy cases worked by hand, invariants of the driver-side solvers, sources, sinks and streaming."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import series
from quantloom.operators import allocation, asof, backtest, features, matrices, panel, screen, selection, sessions
from quantloom.sources import readers, sinks
from quantloom.streaming import bars as streaming

UTC = dt.timezone.utc


def day(s):
    return dt.date.fromisoformat(s)


def ts(s):
    return dt.datetime.fromisoformat(s).replace(tzinfo=UTC)


def prices(spark, rows):
    return spark.createDataFrame([(t, day(d), float(p)) for t, d, p in rows], "ticker string, date date, close_price double")


def years(ticker, start, *ends, first=100.0):
    out = []
    for i, e in enumerate(ends):
        out += [(ticker, f"{start + i}-01-02", first), (ticker, f"{start + i}-12-31", e)]
    return out


# --- screen ---


def test_weekly_volatility(spark):
    p = prices(spark, [("A", d, x) for d, x in (("2024-01-02", 100), ("2024-01-05", 110), ("2024-01-08", 120), ("2024-01-12", 121), ("2024-01-16", 130), ("2024-01-19", 133.1))])
    r = screen.weekly_volatility(p).first()
    want = np.std([math.log(121 / 110), math.log(133.1 / 121)], ddof=1) * math.sqrt(52)
    assert r.n_weekly_returns == 2 and r.weekly_volatility == pytest.approx(want, abs=1e-12)


def test_weekly_drawdown(spark):
    p = prices(spark, [("A", d, x) for d, x in (("2024-01-05", 100), ("2024-01-12", 120), ("2024-01-19", 90), ("2024-01-26", 108))])
    assert screen.weekly_drawdown(p).first().max_drawdown == pytest.approx(-0.25)


def test_two_hurdles(spark):
    rows = years("LOWVOL", 2020, 105, 104) + years("HIGHVOL", 2020, 106, 105) + years("BIG", 2020, 120, 90) + years("BADAVG", 2020, 102, 103)
    got = screen.drawdown_screen(prices(spark, rows), -0.20, 0.04, 2, 2).orderBy("rank").collect()
    assert [r.ticker for r in got] == ["LOWVOL", "HIGHVOL"]
    assert got[0].min_yearly_return == pytest.approx(0.04) and got[0].avg_yearly_return == pytest.approx(0.045)


def test_minimum_history(spark):
    rows = years("MATURE", 2020, 110, 101, 115, 101, 120) + years("FLAT", 2020, 101, 101, 101, 101, 101) + years("YOUNG", 2023, 110, 120)
    got = screen.drawdown_screen(prices(spark, rows), -0.50, 0.04, 2, 5).collect()
    assert [(r.ticker, round(r.min_yearly_return, 9)) for r in got] == [("MATURE", 0.01)]
    with pytest.raises(ValueError):
        screen.drawdown_screen(prices(spark, rows), min_years=0)
    with pytest.raises(ValueError):
        screen.drawdown_screen(prices(spark, rows), min_drawdown=0.1)


def test_full_history(spark):
    rows = years("PASS", 2019, 104, 105, 104, 105, 106, 107, 108) + years("OLD", 2019, 50, 50, 104, 105, 106, 107, 108) + years("RECENT", 2019, 120, 120, 104, 105, 98, 107, 108)
    got = screen.drawdown_screen(prices(spark, rows), -0.15, 0.03, 2, 5).collect()
    assert [(r.ticker, r.first_year, r.last_year, r.n_years) for r in got] == [("PASS", 2019, 2025, 7)]


def test_clean_prices_odd_rows(spark):
    rows = [(" a ", "2024-01-02", "1.5", 1), ("A", "2024-01-02", "2.5", 2), ("A", "bad", "1", 3), ("", "2024-01-02", "1", 4), (None, "2024-01-02", "1", 5), ("B", "2024-01-02", "x", 6), ("B", "2024-01-03", "-1", 7), ("B", "2024-01-04", "NaN", 8), ("C", None, None, 9)]
    d = spark.createDataFrame(rows, "ticker string, date string, close_price string, seq long")
    assert [(r.ticker, r.close_price) for r in screen.clean_prices(d, "seq").collect()] == [("A", 2.5)]


# --- panel ---


def test_total_return_hurdle(spark):
    p = spark.createDataFrame([("ALMOST", day("2020-01-03"), 1, 0.10), ("ALMOST", day("2020-01-10"), 2, 0.09), ("PASS", day("2020-01-03"), 1, 0.10), ("PASS", day("2020-01-10"), 2, 0.11)], "ticker string, date date, idx int, log_ret double")
    kept = panel.hurdle(p, panel.total_log_return(p), "total_log_return", 0.20)
    assert {r.ticker for r in kept.collect()} == {"PASS"}
    with pytest.raises(ValueError):
        panel.hurdle(p, panel.total_log_return(p), "total_log_return", 0.20, ["ALMOST"])


def test_average_yearly_return(spark):
    rows = [("E", "2020-01-31", math.log(1.1)), ("E", "2020-12-31", 0.0), ("E", "2021-01-31", math.log(1.1)), ("E", "2021-12-31", 0.0), ("H", "2021-01-31", 0.5)]
    p = spark.createDataFrame([(t, day(d), i, r) for i, (t, d, r) in enumerate(rows)], "ticker string, date date, idx int, log_ret double")
    got = {r.ticker: r.avg_yearly_return for r in panel.average_yearly_return(p).collect()}
    assert got == pytest.approx({"E": math.log(1.1), "H": 0.25})


def test_gaps_give_no_return(spark):
    rows = [("A", f"2024-01-0{i}", 100 + i) for i in range(1, 6)] + [("B", f"2024-01-0{i}", 50 + i) for i in (1, 2, 4, 5)]
    got = panel.return_panel(prices(spark, rows)).collect()
    assert sorted(r.idx for r in got if r.ticker == "B") == [2, 5] and len([r for r in got if r.ticker == "A"]) == 4
    assert {r.ticker for r in panel.return_panel(prices(spark, rows), min_coverage=0.81).collect()} == {"A"}
    assert panel.frequency(" Weekly ") == "weekly"
    with pytest.raises(ValueError):
        panel.frequency("hourly")


def test_blacklist_and_band(spark):
    p = spark.createDataFrame([("A", day("2024-01-01"), i, 0.001 * (-1) ** i) for i in range(5)] + [("B", day("2024-01-01"), i, 0.02 * (-1) ** i) for i in range(5)], "ticker string, date date, idx int, log_ret double")
    assert {r.ticker for r in panel.volatility_band(p).collect()} == {"B"}
    assert {r.ticker for r in panel.volatility_band(p, anchors=["A"]).collect()} == {"A", "B"}
    with pytest.raises(ValueError):
        panel.blacklist_filter(p, ["A"], ["A"])


# --- backtest ---


def test_backtest(spark):
    p = prices(spark, [("AAA", f"2020-01-0{i}", x) for i, x in ((1, 100), (2, 110), (3, 121))] + [("BBB", f"2020-01-0{i}", x) for i, x in ((1, 100), (2, 90), (3, 81))])
    curve = backtest.equity_curve(p, {"AAA": 0.5, "BBB": 0.5}, 100.0)
    got = curve.orderBy("date").collect()
    assert [r.portfolio_value for r in got] == pytest.approx([100, 100, 101]) and [r.drawdown for r in got] == [0, 0, 0]
    assert got[-1].log_return == pytest.approx(math.log(1.01))
    m = backtest.rounded(backtest.metrics(curve, 100.0)).first()
    assert m.total_log_return == round(math.log(1.01), 4) and m.final_value == 101.0 and m.calmar is None
    for bad in ({"AAA": 0.6}, {"AAA": 0.5, "ZZZ": 0.5}, {"AAA": 1.5, "BBB": -0.5}):
        with pytest.raises(ValueError):
            backtest.equity_curve(p, bad)


# --- sessions and labels ---


def test_session_classification(spark):
    rows = [("S", ts(t)) for t in ("2025-10-01 07:59", "2025-10-01 08:00", "2025-10-01 13:30", "2025-10-01 20:00", "2025-10-02 00:01", "2025-11-03 14:29", "2025-11-03 14:30")]
    got = sessions.classify(spark.createDataFrame(rows, "symbol string, timestamp timestamp")).orderBy("timestamp").collect()
    assert [r.market_session for r in got] == ["overnight", "premarket", "regular", "postmarket", "overnight", "premarket", "regular"]
    assert got[4].session_date == day("2025-10-02")  # and the clock change of 2 November is followed


def bars(spark, rows):
    return spark.createDataFrame([(s, ts(t), o, c) for s, t, o, c in rows], "symbol string, timestamp timestamp, open double, close double").withColumns({"high": F.col("close"), "low": F.col("open"), "volume": F.lit(1.0)})


def test_prior_session(spark):
    b = bars(spark, [("SPY", "2025-10-01 13:30", 100.0, 101.0), ("SPY", "2025-10-01 19:59", 101.0, 101.5), ("SPY", "2025-10-02 13:30", 102.0, 103.0), ("SPY", "2025-10-02 19:59", 103.0, 104.0)])
    r = sessions.primitives(sessions.classify(b)).orderBy("session_date").collect()[1]
    assert r.prior_regular_return == pytest.approx(101.5 / 100 - 1) and r.overnight_gap == pytest.approx(102 / 101.5 - 1) and r.prior_regular_close == 101.5
    assert r.has_regular_session and r.premarket_bar_count is None and r.regular_volume == 2


def test_labels(spark):
    b = bars(spark, [("SPY", "2025-10-01 13:30", 1.0, 100.0), ("SPY", "2025-10-01 13:31", 1.0, 101.0), ("SPY", "2025-10-02 13:30", 1.0, 110.0), ("SPY", "2025-10-02 13:31", 1.0, 115.5), ("SPY", "2025-10-02 13:32", 1.0, 121.0)])
    c = sessions.classify(b)
    out = features.run_labels(sessions.attach(c, sessions.primitives(c)), [{"name": "r", "kind": "next_regular_session_return"}, {"name": "v", "kind": "next_regular_session_volatility"}])
    first = out.orderBy("timestamp").first()
    assert first.r == pytest.approx(0.21) and first.v == pytest.approx(np.std([math.log(115.5 / 110), math.log(121 / 115.5)], ddof=1))
    with pytest.raises(ValueError):
        features.run_labels(out, [{"name": "x", "kind": "nope"}])


def test_no_leak_from_the_future(spark):
    rows = [("A", f"2025-10-01 13:{30 + i}", 1.0, 100.0 + i * i % 7) for i in range(20)]
    changed = rows[:15] + [(s, t, o, c * 3) for s, t, o, c in rows[15:]]
    specs = [{"name": "r", "kind": "log_return"}, {"name": "v", "kind": "realized_volatility", "window": 4}, {"name": "rsi", "kind": "rsi", "window": 4}, {"name": "c5", "kind": "log_return", "timeframe": 5}]
    out = [features.run_features(bars(spark, r), specs).orderBy("timestamp").select("r", "v", "rsi", "c5").collect()[:15] for r in (rows, changed)]
    assert out[0] == out[1]


# --- as-of ---


@pytest.mark.parametrize("limit, want, stale", [("1min", [20.0, 21.0], 0.0), ("30s", [20.0, None], 0.5)])
def test_asof_staleness(spark, limit, want, stale):
    base = bars(spark, [("SPY", "2025-10-01 14:00", 1.0, 1.0), ("QQQ", "2025-10-01 14:02", 1.0, 1.0)])
    vix = bars(spark, [("VIX", "2025-10-01 14:00", 20.0, 20.0), ("VIX", "2025-10-01 14:01", 21.0, 21.0)])
    spec = asof.ContextSpec("vix", max_staleness=limit, rename={"close": "vix"})
    out = asof.context_join(base, vix, spec)
    assert [r.vix for r in out.orderBy("timestamp").collect()] == want and out.columns.count("symbol") == 1
    assert asof.context_audit(out, [spec]).first().stale_rate == stale


def test_asof_against_a_plain_version(spark):
    r = np.random.default_rng(0)
    t0 = ts("2025-03-01 00:00")
    at = lambda n: [t0 + dt.timedelta(seconds=int(x)) for x in r.integers(0, 6 * 86400, n)]
    base = [("AB"[i % 2], t) for i, t in enumerate(at(150))]
    ctx = [("AB"[i % 2], t, None if i % 9 == 0 else float(i)) for i, t in enumerate(at(60))]
    ctx += [(s, t, -1.0) for s, t, _ in ctx[:10]]  # repeated timestamps: the larger value counts
    bdf = spark.createDataFrame(base, "symbol string, timestamp timestamp")
    cdf = spark.createDataFrame(ctx, "symbol string, timestamp timestamp, close double")
    for keyed in (True, False):
        spec = asof.ContextSpec("c", lag="2h", join_on_symbol=keyed, rename={"close": "x"})
        got = {(x.symbol, x.timestamp.replace(tzinfo=UTC)): x.x for x in asof.context_join(bdf, cdf, spec).collect()}
        for s, t in base:
            rows = [(u, v) for z, u, v in ctx if u + dt.timedelta(hours=2) <= t and (z == s or not keyed)]
            best = max(rows, key=lambda p: (p[0], p[1] is not None, p[1] or 0), default=(None, None))[1]
            assert got[s, t] == best
    assert asof.context_join(bdf, cdf.limit(0), asof.ContextSpec("c", rename={"close": "x"})).where("x is not null").count() == 0
    with pytest.raises(ValueError):
        asof.context_join(bdf, cdf, asof.ContextSpec("c", align="nearest"))


# --- features on nulls and ties ---


def test_cross_section_ties_and_zero_spread(spark):
    d = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 1.0), ("C", 1, 2.0), ("D", 1, None), ("A", 2, 5.0)], "symbol string, timestamp long, x double")
    out = features.run_cross_section(d, [{"name": "p", "kind": "percentile_rank", "column": "x"}, {"name": "z", "kind": "zscore", "column": "x"}])
    got = {(r.symbol, r.timestamp): (r.p, r.z) for r in out.collect()}
    assert got["A", 1][0] == pytest.approx(1.5 / 3) and got["C", 1][0] == 1 and got["D", 1] == (None, None) and got["A", 2] == (1.0, None)
    with pytest.raises(ValueError):
        features.run_cross_section(d, [{"name": "p", "kind": "percentile_rank", "column": "missing"}])


def test_rsi_without_losses_is_null(spark):
    b = bars(spark, [("A", f"2025-10-01 13:{30 + i}", 1.0, 100.0 + i) for i in range(6)])
    assert features.run_features(b, [{"name": "rsi", "kind": "rsi", "window": 3}]).where("rsi is not null").count() == 0


def test_intervals():
    assert [series.interval_seconds(x) for x in ("30s", "5min", "1D", "2h", "", None)] == [30, 300, 86400, 7200, None, None]
    with pytest.raises(ValueError):
        series.interval_seconds("soon")


# --- selection and allocation ---


def random_problem(seed, n=8, t=400):
    r = np.random.default_rng(seed)
    x = r.normal(size=(t, n)) @ (np.eye(n) + 0.3 * r.normal(size=(n, n))) * 0.01 + r.normal(size=n) * 5e-4
    cov, corr = np.cov(x.T), np.corrcoef(x.T)
    d = np.sqrt(np.clip((1 - corr) / 2, 0, 1))
    np.fill_diagonal(d, 0)
    return [f"T{i}" for i in range(n)], x, cov, corr, d


def test_selectors():
    for seed in range(5):
        names, _, cov, corr, d = random_problem(seed)
        vol = {t: float(i) for i, t in enumerate(names)}
        for n in (1, 2, 5, 20):
            for picks in ([t for t, _ in selection.greedy_maximin(names, d, vol, n, ["T3"])], [t for t, _ in selection.greedy_max_dr(names, cov, vol, n, ["T3"])], [r["ticker"] for r in selection.k_medoids(names, d, vol, n, ["T3"])]):
                assert len(picks) == len(set(picks)) == min(n, 8) and picks[0] == "T3"
        rows = selection.k_medoids(names, d, vol, 3, ["T3"])
        assert sum(r["cluster_size"] for r in rows) == 8
        dr = selection.greedy_max_dr(names, cov, vol, 4, ["T3"])
        idx = [names.index(t) for t, _ in dr]
        assert dr[-1][1] == pytest.approx(selection.equal_weight_dr(cov[np.ix_(idx, idx)]))
        assert sum(r["cluster_size"] for r in selection.ward_selection(names, d, vol, 3)) == 8
        assert len({r["ticker"] for r in selection.pca_loadings(names, corr, 4)}) == 4
    tie = np.array([[0, 1, 1.0], [1, 0, 1], [1, 1, 0]])
    assert selection.greedy_maximin(["A", "B", "C"], tie, {"B": 1, "C": 5}, 2, ["A"])[1] == ("C", 1.0)
    assert selection.anchor_first(["X", "B"], ["A", "B", "C"], 3, ["C"]) == ["C", "B", "A"]
    assert selection.first_weak_step([None, 1.0, 1.2, 1.205]) == 4


def test_ward_heights():
    d = np.array([[0, 1, 4, 5.0], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]])
    m = selection.ward_linkage(d)
    assert [(a, b) for a, b, _, _ in m] == [(0, 1), (2, 3), (4, 5)] and m[0][2] == 1 and m[1][2] == 2
    assert selection.leaf_order(m, 4) == [0, 1, 2, 3] and selection.leaf_order([], 1) == [0]


@pytest.mark.parametrize("low, high", [(0.0, 1.0), (0.05, 0.3)])
def test_solvers(low, high):
    for seed in range(4):
        names, x, cov, _, d = random_problem(seed)
        mean, even = x.mean(axis=0), np.full(8, 1 / 8)
        r = np.random.default_rng(seed)
        tries = [allocation.bound_weights(r.dirichlet(np.full(8, 0.4)), low, high) for _ in range(300)] + [even]
        goals = {
            "min_variance": lambda w: w @ cov @ w,
            "max_sharpe": lambda w: -(mean @ w * 252 - 0.05) / math.sqrt(w @ cov @ w * 252),
            "max_diversification": lambda w: -(np.sqrt(np.diag(cov)) @ w) / math.sqrt(w @ cov @ w),
            "min_cvar": lambda w: allocation.cvar(x, w),
            "risk_parity": lambda w: (((w * (cov @ w)) / math.sqrt(w @ cov @ w) - math.sqrt(w @ cov @ w) / 8) ** 2).sum(),
        }
        for name, f in allocation.STRATEGIES.items():
            w = f(mean, cov, x, d, low, high)
            assert w.sum() == pytest.approx(1, abs=1e-8) and w.min() >= low - 1e-9 and w.max() <= high + 1e-9
            if name in goals:
                best = min(goals[name](t) for t in tries)
                assert goals[name](w) <= best + abs(best) * 2e-3 + 1e-12, (name, seed)
    w = allocation.risk_parity(cov)
    rc = w * (cov @ w)
    assert rc.max() / rc.min() == pytest.approx(1, abs=1e-6)


def test_bounds():
    assert allocation.bound_weights([5, 1, 1, 1], 0.1, 0.4) == pytest.approx([0.4, 0.2, 0.2, 0.2])
    assert allocation.bound_weights([np.nan, -1, 0]) == pytest.approx([1 / 3] * 3)
    for bad in ((3, 0.5, 1.0), (3, 0.0, 0.3), (0, 0, 1)):
        with pytest.raises(ValueError):
            allocation.check_bounds(*bad)


def test_spearman_median_fill_and_ties(spark):
    rows = [("A", i, v) for i, v in enumerate([0.1, 0.2, 0.2, -0.1, 0.3])] + [("B", i, v) for i, v in enumerate([0.3, 0.1, None, 0.0, 0.2]) if v is not None]
    p = spark.createDataFrame([(t, day(f"2024-01-{i + 1:02d}"), i, v) for t, i, v in rows], "ticker string, date date, idx int, log_ret double")
    import pandas as pd

    wide = pd.DataFrame({"A": [0.1, 0.2, 0.2, -0.1, 0.3], "B": [0.3, 0.1, None, 0.0, 0.2]})
    want = wide.fillna(wide.median()).rank().corr()
    for got in (matrices.spearman(p), matrices.spearman_vectors(p)):
        assert {(r.ticker_i, r.ticker_j): r.value for r in got.collect()} == pytest.approx({(a, b): want[a][b] for a in "AB" for b in "AB"})
    one = matrices.average_abs_correlation(matrices.spearman(p.where("ticker = 'A'"))).first()
    assert one.avg_abs_corr is None


# --- sources, sinks, streaming ---


def test_sources(spark, tmp_path):
    b = bars(spark, [("A", "2025-10-01 13:30", 1.0, float("nan")), ("B", "2025-10-02 23:59", 1.0, 2.0), ("A", "2025-10-03 00:00", 1.0, 2.0)])
    out = readers.load_source(spark, readers.SourceSpec("s", "t", ("A", "B")), {"t": b}, "2025-10-01", "2025-10-02")
    assert out.count() == 2 and out.where("symbol = 'A'").first().close is None and out.columns[:14] == readers.CANONICAL.names
    assert readers.load_source(spark, readers.SourceSpec("s", "t", ("A",), enabled=False), {}, "2025-10-01", "2025-10-02").count() == 0
    for bad in (readers.SourceSpec("s", "u", ("A",)), readers.SourceSpec("s", "t", ("A",), kind="z"), readers.SourceSpec("s", "t", ())):
        with pytest.raises(ValueError):
            readers.load_source(spark, bad, {"t": b}, "2025-10-01", "2025-10-02")
    p = prices(spark, [("A", "2024-01-02", 1), ("A", "2024-01-03", 2), ("B", "2024-01-03", 3)])
    assert sinks.write_daily(p, f"{tmp_path}/daily").first().n_rows == 3
    got = readers.read_prices_or_database(spark, f"{tmp_path}/daily", symbols=["A"], start="2024-01-03", end="2024-01-03")
    assert got.count() == 1 and "PushedFilters: [" in got._jdf.queryExecution().toString()
    sinks.write_csv(p.withColumn("start_date", F.lit("2020-05-01")).withColumn("vol_2020", F.lit(1.23456)), f"{tmp_path}/c", 3)
    c = readers.read_candidates(spark, f"{tmp_path}/c").first()
    assert c.vol_2020 == 1.235 and c.inception_year == 2020
    (tmp_path / "x_2024-01-01_007.csv").write_text("")
    assert sinks.next_run_tag(str(tmp_path), "2024-01-01") == "2024-01-01_008"
    (tmp_path / "c.toml").write_text('[run]\nstart="2025-01-01"\n[[primary_sources]]\nname="p"\ntable="t"\nsymbols=["A"]\n[[context_sources]]\nname="v"\ntable="t"\nsymbols=["V"]\nlag="1D"\n')
    run, primary, context = readers.read_config(str(tmp_path / "c.toml"), start="2025-02-01")
    assert run["start"] == "2025-02-01" and primary[0].primary and context[0].lag == "1D"
    assert readers.missing_artifacts([str(tmp_path), "/nope"]) == ["/nope"]
    with pytest.raises(ValueError):
        readers.analysis_window("2025-02-01", "2025-01-01")
    sinks.write_bundle(str(tmp_path / "run"), {"matrix": p, "manifest": p}, {"a": 1})
    assert spark.read.parquet(f"{tmp_path}/run/matrix.parquet").count() == 3


def test_database_path(spark, tmp_path, monkeypatch):
    """The database answers with the same columns, symbols and dates as Parquet, and gets the filters pushed down."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [("A", "2024-01-02", 1.0, 5), ("A", "2024-01-03", 2.0, 5), ("B", "2024-01-03", 3.0, 5), ("A", "2024-01-04", 4.0, 5)]
    d = spark.createDataFrame(rows, "ticker string, date string, close_price double, volume long").withColumn("date", F.to_date("date"))
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    d.write.format("jdbc").options(url=url, dbtable="daily_prices", driver=driver, createTableColumnTypes="ticker varchar(8)").save()
    monkeypatch.setenv("DB_URL", url)
    got = readers.read_prices_or_database(spark, "nowhere", symbols=["A"], start="2024-01-03", end="2024-01-03")
    assert got.columns == ["ticker", "date", "close_price"] and [tuple(r)[::2] for r in got.collect()] == [("A", 2.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ticker" in plan.split("PushedFilters")[1]


def test_database_options():
    assert readers.database_options({}) is None and readers.database_options({"CLICKHOUSE_HOST": "h"}) is None
    env = {"CLICKHOUSE_HOST": "h", "CLICKHOUSE_PORT": "8443", "CLICKHOUSE_USER": "u", "CLICKHOUSE_PASSWORD": "p"}
    assert readers.database_options(env) == {"url": "jdbc:clickhouse://h:8443", "user": "u", "password": "p", "ssl": "false", "sslmode": "none"}
    got = readers.database_options(env | {"CLICKHOUSE_SECURE": "True", "CLICKHOUSE_VERIFY": "true"})
    assert got["ssl"] == "true" and got["sslmode"] == "strict"


def test_streaming_equals_batch(spark, tmp_path):
    rows = [("A", f"2025-10-01 13:{30 + i}", float(i), 100.0 + i) for i in range(25)] + [("A", "2025-10-03 00:00", 0.0, 1.0)]
    b = bars(spark, rows)
    b.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(b.schema).parquet(f"{tmp_path}/in")
    q = streaming.streaming_bars(stream, 5).writeStream.format("memory").queryName("bars5").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("bars5").select("symbol", "timestamp", "close", "volume").collect()))
    want = sorted(tuple(r) for r in features.resample(b, 5).select("symbol", "timestamp", "close", "volume").collect() if r.timestamp < dt.datetime(2025, 10, 2))
    assert got == want and len(got) > 3
    q = streaming.streaming_daily(stream).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.awaitTermination()
    assert [(r.ticker, str(r.date), r.close_price) for r in spark.table("days").collect()] == [("A", "2025-10-01", 124.0)]


def test_empty_tables(spark):
    p = prices(spark, [])
    assert screen.drawdown_screen(p).count() == 0 and panel.return_panel(p).count() == 0
    b = bars(spark, [])
    assert sessions.primitives(sessions.classify(b)).count() == 0 and features.resample(b, 5).count() == 0


def test_black_litterman():
    r = np.random.default_rng(4)
    x = r.normal(0.0004, 0.01, (500, 4)) * np.array([1, 1.5, 0.7, 2])
    cov = np.cov(x.T)
    market = np.array([0.4, 0.3, 0.2, 0.1])
    assert allocation.black_litterman(cov, market) == pytest.approx(market, abs=1e-4)  # no views: the market itself
    implied = allocation.AVERSION * cov * 252 @ market
    # Views that agree leave the means, but the combined covariance is no longer a multiple of the market's.
    assert allocation.black_litterman(cov, market, (np.eye(4), implied)) == pytest.approx(market, abs=5e-3)
    up = allocation.black_litterman(cov, market, (np.eye(4)[:1], implied[:1] + 0.05))
    assert up[0] > 0.41
    # The update against its form with inverses.
    prior, p = 0.05 * cov * 252, np.eye(4)
    unsure, q = np.diag(np.diag(prior)), implied + [0.02, -0.01, 0.0, 0.03]
    left = np.linalg.inv(np.linalg.inv(prior) + p.T @ np.linalg.inv(unsure) @ p)
    mean = left @ (np.linalg.inv(prior) @ implied + p.T @ np.linalg.inv(unsure) @ q)
    assert allocation.black_litterman(cov, market, (p, q)) == pytest.approx(allocation._ratio(mean, cov * 252 + left, 0, 1), abs=1e-3)
    picks, q = allocation.momentum_views(x, 100)
    assert q == pytest.approx(x[-100:].mean(axis=0) * 252 - 0.05)


def test_kelly_and_robust_on_a_grid():
    r = np.random.default_rng(6)
    x = r.normal([0.0006, 0.0003, 0.0001], [0.02, 0.01, 0.004], (750, 3))
    mean, cov = x.mean(axis=0), np.cov(x.T)
    grid = np.array([(a, b, 200 - a - b) for a in range(201) for b in range(201 - a)]) / 200
    m, var = grid @ mean * 252, np.einsum("ij,jk,ik->i", grid, cov, grid) * 252

    def near(w, value):
        return np.abs(w - grid[value.argmax()]).max() < 0.011

    assert near(allocation.fractional_kelly(mean, cov), 0.5 * m - 0.125 * var)
    assert near(allocation.fractional_kelly(mean, cov, fraction=3.0), 3 * m - 4.5 * var)
    assert [allocation.chi_square_quantile(0.95, n) for n in (1, 2, 3, 8)] == pytest.approx([3.841, 5.991, 7.815, 15.507], abs=1e-3)
    # The worst mean of the ellipsoid lies sqrt(quantile * w' C w) below, C the covariance of the yearly means.
    worst = np.sqrt(allocation.chi_square_quantile(0.95, 3) * var * 252 / 750)
    assert near(allocation.robust_mean_variance(mean, cov, 750), m - worst - 1.25 * var)
    assert allocation.robust_mean_variance(mean, cov, 750).sum() == pytest.approx(1)


def test_singular_covariance_keeps_bounds():
    x = np.random.default_rng(1).normal(0, 0.01, (60, 2))
    x = np.c_[x, x[:, 0], np.zeros(60)]
    cov, mean = np.cov(x.T), x.mean(axis=0)
    for name in ("black_litterman", "bl_momentum", "kelly_half", "robust_mv"):
        w = allocation.STRATEGIES[name](mean, cov, x, None, 0.05, 0.5)
        assert np.isfinite(w).all() and w.sum() == pytest.approx(1), name
        assert w.min() >= 0.05 - 1e-9 and w.max() <= 0.5 + 1e-9, name
