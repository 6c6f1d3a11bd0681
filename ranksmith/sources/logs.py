"""JSON-lines sources and sinks: the pipeline audit log and experiment runs.

Both are append-only folders of JSON lines in the shared checkpoint
folder (or any path the caller gives); reads use an explicit schema and
drop malformed lines, so one corrupt record never fails a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("retrieved_tables", T.ArrayType(T.StringType())),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("sql_generated", T.StringType()),
    T.StructField("is_valid", T.BooleanType()),
    T.StructField("parsing_errors", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("latency_breakdown", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("error", T.StringType()),
    T.StructField("top_feature_importances", T.MapType(T.StringType(), T.DoubleType())),
])

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("num_training_samples", T.IntegerType()),
    T.StructField("num_features", T.IntegerType()),
    T.StructField("cv_folds", T.IntegerType()),
    T.StructField("train_test_split_ratio", T.DoubleType()),
    T.StructField("training_duration_seconds", T.DoubleType()),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("train_metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("val_metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("test_metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("feature_importances", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("cv_fold_metrics", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("model_path", T.StringType()),
    T.StructField("notes", T.StringType()),
])


def map_top(m: Column, n: int = 5) -> Column:
    """The n largest entries of a map (by value, then key)."""
    entries = F.array_sort(F.map_entries(m), lambda a, b: F.when(a["value"] > b["value"], -1)
                           .when(a["value"] < b["value"], 1)
                           .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.map_from_entries(F.slice(entries, 1, n))


def audit_records(rows: DataFrame) -> DataFrame:
    """Shape rows into audit records: latency and its breakdown rounded to
    2 d.p., only the top five feature importances kept."""
    out = rows
    for f in AUDIT_SCHEMA.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = (out.withColumn("latency_ms", F.round("latency_ms", 2))
           .withColumn("latency_breakdown", F.transform_values("latency_breakdown", lambda k, v: F.round(v, 2)))
           .withColumn("top_feature_importances", map_top(F.col("top_feature_importances"), 5)))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in AUDIT_SCHEMA.fields])


def audit_log_write(records: DataFrame, path: str) -> None:
    """Append audit records as JSON lines."""
    audit_records(records).write.mode("append").json(path)


def audit_log_recent(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """The newest n records, newest first; malformed lines are dropped."""
    df = spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return df.orderBy(F.col("timestamp").desc()).limit(n)


def experiment_write(runs: DataFrame, path: str) -> None:
    """Append experiment runs; a missing run id becomes
    ``<model_type>_<yyyyMMdd_HHmmss>`` and a missing timestamp the current
    UTC time in ISO form."""
    now = F.current_timestamp()
    out = runs
    for f in RUN_SCHEMA.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = (out.withColumn("timestamp", F.coalesce("timestamp", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
           .withColumn("run_id", F.coalesce("run_id", F.concat_ws("_", "model_type",
                                                                  F.date_format(now, "yyyyMMdd_HHmmss")))))
    out.select(*[F.col(f.name).cast(f.dataType) for f in RUN_SCHEMA.fields]).write.mode("append").json(path)


def experiment_list(spark: SparkSession, path: str, model_type: str | None = None) -> DataFrame:
    """All runs (malformed records skipped), optionally of one model type,
    newest first (timestamp, then run id)."""
    df = spark.read.schema(RUN_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter(F.col("run_id").isNotNull())
    if model_type:
        df = df.filter(F.col("model_type") == model_type)
    return df.orderBy(F.col("timestamp").desc(), F.col("run_id").desc())


def metric_of(metric: str) -> Column:
    """A metric looked up in validation, then test, then train metrics."""
    return F.coalesce(F.col("val_metrics")[metric], F.col("test_metrics")[metric], F.col("train_metrics")[metric])


def best_run(runs: DataFrame, metric: str = "val_recall_at_5", higher_is_better: bool = True) -> DataFrame:
    """The best run by a metric; a run without the metric counts as worst."""
    worst = float("-inf") if higher_is_better else float("inf")
    m = F.coalesce(metric_of(metric), F.lit(worst))
    r = runs.withColumn("_m", m)
    order = [F.col("_m").desc() if higher_is_better else F.col("_m").asc(), F.col("run_id")]
    return r.orderBy(*order).limit(1).select("run_id", "model_type", metric_of(metric).alias("metric_value"))


def run_comparison(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run with the chosen metrics (validation overlaid by test
    metrics; missing = 0.0; 4 d.p.) and the duration (1 d.p.)."""
    empty = F.create_map().cast("map<string,double>")
    test = F.coalesce("test_metrics", empty)
    # test overrides validation: drop overridden keys first, so the merge
    # never depends on the session's duplicate-key policy
    val = F.map_filter(F.coalesce("val_metrics", empty), lambda k, v: ~F.array_contains(F.map_keys(test), k))
    merged = F.map_concat(val, test)
    r = runs.withColumn("_m", merged)
    return r.select("run_id", "model_type", "timestamp",
                    *[F.round(F.coalesce(F.col("_m")[m], F.lit(0.0)), 4).alias(m) for m in metrics],
                    F.round(F.coalesce("training_duration_seconds", F.lit(0.0)), 1).alias("training_duration_seconds"))


def log_search(log: DataFrame, term: str = "", valid: bool | None = None) -> DataFrame:
    """Records whose question, generated SQL or model contains ``term``
    (case-insensitive), optionally only valid / invalid ones."""
    t = term.lower()
    hit = (F.instr(F.lower(F.coalesce("question", F.lit(""))), t) > 0) | \
          (F.instr(F.lower(F.coalesce("sql_generated", F.lit(""))), t) > 0) | \
          (F.instr(F.lower(F.coalesce("model_used", F.lit(""))), t) > 0)
    out = log.filter(hit)
    if valid is not None:
        out = out.filter(F.col("is_valid") == F.lit(valid))
    return out
