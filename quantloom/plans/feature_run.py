"""A whole feature run from a configuration: sources, sessions, contexts, features, cross-section, labels, audits.

Everything up to the sinks is one lazy plan. write() makes the matrix once and takes the audits from the written copy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, features, sessions
from ..sources import readers, sinks


def run_audit(matrix: DataFrame, sources: dict[str, DataFrame], context: DataFrame, manifest: DataFrame) -> DataFrame:
    """section, name, metric, value: the audits of a run in one long table."""
    long = lambda section, df, name, metrics: df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "value"))
    parts = [long("source", df.agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols")).withColumn("n", F.lit(k)), "n", ["rows", "symbols"]) for k, df in sources.items()]
    parts.append(long("matrix", matrix.agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols")).withColumn("n", F.lit("feature_matrix")), "n", ["rows", "symbols"]))
    parts.append(long("context", context, "context_name", ["n_rows", "null_rate", "stale_rate", "mean_effective_lag_minutes", "max_effective_lag_minutes"]))
    parts.append(long("feature", manifest, "name", ["null_rate"]))
    return reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, run_conf: dict, primary: list, contexts: list, catalog: dict[str, DataFrame], feature_specs: list[dict], cross_specs: list[dict] = (), label_specs: list[dict] = (), metadata: DataFrame | None = None) -> dict:
    """{feature_matrix, session_primitives, context_audit, feature_manifest, run_audit}, and under audits the function that makes the last three from a copy of the matrix."""
    start, end = readers.analysis_window(run_conf["start"], run_conf["end"])
    tz = run_conf.get("timezone", "America/New_York")
    frames = {s.name: readers.normalize(readers.load_source(spark, s, catalog, start, end), tz, s.primary, s.name) for s in [*primary, *contexts]}
    base = reduce(DataFrame.unionByName, [frames[s.name] for s in primary])
    classified = sessions.classify(features.attach_metadata(base, metadata), tz)
    prims = sessions.primitives(classified)
    bars = sessions.regular_bars(sessions.attach(classified, prims))
    specs = [asof.ContextSpec(s.name, s.columns, s.lag, s.max_staleness, s.align, s.join_on_symbol, s.rename or {c: f"{s.name}_{c}" for c in s.columns}) for s in contexts if s.enabled]
    matrix = asof.context_joins(bars, frames, specs)
    matrix = features.run_features(matrix, list(feature_specs))
    if cross_specs:
        matrix = features.run_cross_section(matrix, list(cross_specs))
    if label_specs:
        matrix = features.run_labels(matrix, list(label_specs))
    audits = lambda m: matrix_audits(m, specs, [*feature_specs, *cross_specs, *label_specs], frames)
    return {"feature_matrix": matrix, "session_primitives": prims, **audits(matrix), "audits": audits}


def matrix_audits(matrix: DataFrame, specs: list, produced: list[dict], sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """{context_audit, feature_manifest, run_audit} of a feature matrix."""
    none = "context_name string, n_rows long, null_rate double, stale_rate double, mean_effective_lag_minutes double, max_effective_lag_minutes double"
    context = asof.context_audit(matrix, specs) if specs else matrix.sparkSession.createDataFrame([], none)
    manifest = features.manifest(matrix, produced)
    return {"context_audit": context, "feature_manifest": manifest, "run_audit": run_audit(matrix, sources, context, manifest)}


def write(folder: str, tables: dict[str, DataFrame], config: dict) -> None:
    """The artifact bundle of run(): the matrix is computed and written once, the audits read the written copy."""
    audits = tables["audits"]
    tables = {k: v for k, v in tables.items() if isinstance(v, DataFrame)}
    path = f"{folder}/feature_matrix.parquet"
    matrix = tables.pop("feature_matrix")
    matrix.write.mode("overwrite").parquet(path)
    sinks.write_bundle(folder, tables | audits(matrix.sparkSession.read.parquet(path)), config)
