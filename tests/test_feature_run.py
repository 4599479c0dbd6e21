import json

from quantloom.plans import feature_run
from quantloom.sources import readers, views

SF = "/root/testdata/sf0.001"


def test_run_and_bundle(spark, tmp_path):
    catalog = {"minute": views.minute_bars(spark, SF)}
    primary = [readers.SourceSpec("p", "minute", ("view", "click", "error"), primary=True)]
    contexts = [readers.SourceSpec("vix", "minute", ("signup",), lag="1min", max_staleness="2h"), readers.SourceSpec("off", "minute", ("signup",), enabled=False)]
    conf = {"start": "2024-01-01", "end": "2024-01-25"}
    specs = [{"name": "r", "kind": "log_return"}, {"name": "lvl", "kind": "level", "column": "vix_close"}, {"name": "gap", "kind": "overnight_gap"}, {"name": "rsi5", "kind": "rsi", "window": 3, "timeframe": 5}]
    out = feature_run.run(spark, conf, primary, contexts, catalog, specs, [{"name": "z", "kind": "zscore", "column": "r"}], [{"name": "y", "kind": "next_regular_session_return"}, {"name": "q", "kind": "quantile", "column": "y"}])
    m = out["feature_matrix"]
    assert {"r", "lvl", "gap", "rsi5", "z", "y", "q", "vix_is_stale"} <= set(m.columns)
    assert m.where("market_session <> 'regular'").count() == 0 and m.count() > 0
    assert m.groupBy("symbol", "timestamp").count().where("count > 1").count() == 0
    audit = {(r.section, r.name, r.metric): r.value for r in out["run_audit"].collect()}
    assert audit["matrix", "feature_matrix", "rows"] == m.count() and audit["source", "off", "rows"] == 0
    assert 0 <= audit["context", "vix", "stale_rate"] <= 1 and ("feature", "q", "null_rate") in audit
    feature_run.write(str(tmp_path / "run"), out, conf)
    assert spark.read.parquet(f"{tmp_path}/run/feature_matrix.parquet").count() == m.count()
    assert json.loads(spark.read.text(f"{tmp_path}/run/config.json").first()[0]) == conf
