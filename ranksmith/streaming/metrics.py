"""Structured Streaming versions of the telemetry and the audit log.

The reference keeps the last 1000 requests in memory; a Spark user
instead streams request records through event-time windows with a
watermark, so state stays bounded however long the stream runs and late
records beyond the watermark are dropped by the aggregate.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import requests_from_events
from ..session import checkpoint_dir
from .first import first_per_key


def _run_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """Streaming read of parquet event files (schema taken from the data)."""
    schema = spark.read.parquet(path).schema
    if not os.path.isdir(path):
        # the file source lists directories; a single file is read through
        # a glob that matches exactly that file
        path = path.rstrip("/")
        path = path[:-1] + "[" + path[-1] + "]"
    return spark.readStream.schema(schema).parquet(path)


def windowed_endpoint_metrics(req: DataFrame, size: str = "1 hour", slide: str | None = None,
                              delay: str = "10 minutes") -> DataFrame:
    """Per event-time window and endpoint: request count, mean latency and
    error count.  Tumbling when ``slide`` is None, else sliding."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (req.withWatermark("ts", delay)
            .groupBy(w.alias("w"), "endpoint")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms"),
                 F.sum((~F.col("success")).cast("long")).alias("errors")))


def run_to_table(spark: SparkSession, stream_df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over everything available now (checkpointed in
    the shared checkpoint folder, so a restarted job resumes where it
    stopped) and read back what the parquet sink committed."""
    base = _run_dir(spark, name)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    q = (stream_df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.schema(stream_df.schema).parquet(out)


def stream_metrics(spark: SparkSession, events_path: str, size: str = "1 hour",
                   slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Windowed endpoint metrics computed by a streaming query; the result
    holds the windows the watermark has closed."""
    req = requests_from_events(events_stream(spark, events_path))
    agg = windowed_endpoint_metrics(req, size, slide, delay)
    res = run_to_table(spark, agg, "stream_metrics")
    return res.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                      "endpoint", "n", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "errors")


def stream_dedup(spark: SparkSession, events_path: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First record per key within the watermark (``dropDuplicatesWithinWatermark``)."""
    ev = events_stream(spark, events_path).withColumn("ts", F.col("ts").cast("timestamp"))
    d = ev.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return run_to_table(spark, d, "stream_dedup")


def stream_first(spark: SparkSession, events_path: str, keys: list[str], order: str, delay: str = "1 hour",
                 expiry: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """First record per key in event time, again after each ``expiry``
    (``first_per_key``); the result holds those the watermark has reached."""
    ev = events_stream(spark, events_path)
    return run_to_table(spark, first_per_key(ev, keys, order, "ts", delay, expiry), "stream_first")


def stream_audit_log(spark: SparkSession, records: DataFrame, name: str = "audit") -> DataFrame:
    """Append audit records (a streaming DataFrame) to a JSON-lines sink
    with a checkpoint; returns the sink read back as a batch table."""
    base = _run_dir(spark, name)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    q = (records.writeStream.format("json").outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.schema(records.schema).json(out)
