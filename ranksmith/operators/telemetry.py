"""Request telemetry: per-endpoint latency percentiles, error rates,
confidence and stage summaries over request records.

A request record is (request_id, endpoint, ts, timestamp, latency_ms,
success, error_type, top_confidence, used_learned_ranker, expansion_ms,
retrieval_ms, reranking_ms, generation_ms, validation_ms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: endpoints of the service and which ones are retrievals
ENDPOINTS = ["/retrieve", "/generate-sql", "/benchmark", "/execute-sql", "/health"]
RETRIEVAL_ENDPOINTS = ["/retrieve", "/generate-sql"]
STAGES = ["expansion_ms", "retrieval_ms", "reranking_ms", "generation_ms", "validation_ms"]
# --- end of fixed values ----------------------------------------------------


def round_half_up(x, d: int):
    """Round half up on the binary value, identically in every engine."""
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c * (10 ** d) + 0.5) / (10 ** d)


def requests_from_events(events: DataFrame) -> DataFrame:
    """Stand-in request records built from the ``events`` table: endpoint
    from the user id, latency = value, failure = an 'error' event,
    confidence and ranker flag from the JSON ``k`` property, stage times as
    fixed shares of the latency.  The expansion stage is never filled by
    callers, so it stays 0."""
    k = F.get_json_object("props", "$.k").cast("int")
    eps = F.array(*[F.lit(e) for e in ENDPOINTS])
    lat = F.col("value")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.element_at(eps, (F.pmod(F.col("user_id"), F.lit(len(ENDPOINTS))) + 1).cast("int")).alias("endpoint"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        lat.alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.lit("error")).alias("error_type"),
        (k / 100.0).alias("top_confidence"),
        (F.pmod(k, F.lit(2)) == 0).alias("used_learned_ranker"),
        F.lit(0.0).alias("expansion_ms"),
        (lat * 0.2).alias("retrieval_ms"), (lat * 0.3).alias("reranking_ms"),
        (lat * 0.4).alias("generation_ms"), (lat * 0.1).alias("validation_ms"),
    )


def exact_percentiles(df: DataFrame, group: str, value: str, ps: list[float],
                      buckets: int = 256) -> DataFrame:
    """Exact percentiles with linear interpolation between order
    statistics (the default of numpy and of DuckDB ``quantile_cont``), per
    group, without holding a whole group in one task.

    Equal values are counted first (map-side), so a value that makes up
    most of a group is one row.  Approximate quantiles then cut each group's
    distinct values into ``buckets``; bucket counts and their running
    offsets locate the bucket(s) holding the two order statistics each
    percentile needs; only those buckets are cumulated.  The cut points
    affect balance, never the result.
    Output: group, n, p<100p> for each p (e.g. p50)."""
    probs = [i / buckets for i in range(1, buckets)]
    base = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counted = base.groupBy("g", "v").agg(F.count(F.lit(1)).alias("m"))
    cuts = counted.groupBy("g").agg(F.percentile_approx("v", probs, 10000).alias("cuts"), F.sum("m").alias("n"))
    b = counted.join(cuts, "g")
    b = b.withColumn("b", F.array_position(F.sort_array(F.concat(F.col("cuts"), F.array("v"))), F.col("v")) - 1) \
        .drop("cuts")
    cnt = b.groupBy("g", "b").agg(F.sum("m").alias("c"), F.first("n").alias("n"))
    wo = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("off", F.coalesce(F.sum("c").over(wo), F.lit(0)))
    # the 0-based order statistics each percentile needs
    need = []
    for p in ps:
        r = F.lit(p / 100.0) * (F.col("n") - 1)
        need.append(F.struct(F.lit(p).alias("p"), F.floor(r).cast("long").alias("k"), r.alias("r"), F.lit(0).alias("hi")))
        need.append(F.struct(F.lit(p).alias("p"), F.ceil(r).cast("long").alias("k"), r.alias("r"), F.lit(1).alias("hi")))
    targets = cnt.select("g", "b", "off", "c", F.explode(F.array(*need)).alias("t")) \
        .filter((F.col("t.k") >= F.col("off")) & (F.col("t.k") < F.col("off") + F.col("c"))) \
        .select("g", "b", "off", "t.p", "t.k", "t.r", "t.hi")
    wanted = targets.select("g", "b", "off").distinct()
    rows = b.join(wanted, ["g", "b"])
    upto = Window.partitionBy("g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.col("off") + F.sum("m").over(upto)).select("g", "b", "m", "end", "v")
    hit = targets.join(rows, ["g", "b"]).filter((F.col("k") < F.col("end")) & (F.col("k") >= F.col("end") - F.col("m")))
    per = hit.groupBy("g", "p").agg(
        F.max(F.when(F.col("hi") == 0, F.col("v"))).alias("lo_v"),
        F.max(F.when(F.col("hi") == 1, F.col("v"))).alias("hi_v"),
        F.first("r").alias("r"))
    per = per.withColumn("val", F.col("lo_v") + (F.col("hi_v") - F.col("lo_v")) * (F.col("r") - F.floor("r")))
    wide = per.groupBy("g").pivot("p", ps).agg(F.first("val"))
    for p in ps:
        wide = wide.withColumnRenamed(str(p), f"p{int(p) if float(p).is_integer() else p}")
    return wide.withColumnRenamed("g", group)


def endpoint_latency(req: DataFrame) -> DataFrame:
    """Per endpoint: count, p50/p95/p99 latency (exact, linear
    interpolation), mean latency and error count; latencies to 1 d.p."""
    base = req.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("count"),
        round_half_up(F.avg("latency_ms"), 1).alias("latency_avg_ms"),
        F.sum((~F.col("success")).cast("long")).alias("error_count"))
    pct = exact_percentiles(req, "endpoint", "latency_ms", [50, 95, 99])
    out = base.join(pct, "endpoint")
    return out.select("endpoint", "count",
                      round_half_up("p50", 1).alias("latency_p50_ms"), round_half_up("p95", 1).alias("latency_p95_ms"),
                      round_half_up("p99", 1).alias("latency_p99_ms"), "latency_avg_ms", "error_count")


def error_rate(req: DataFrame) -> DataFrame:
    """Lifetime totals: requests, errors and error rate (4 d.p.)."""
    return req.agg(F.count(F.lit(1)).alias("total_requests"),
                   F.sum((~F.col("success")).cast("long")).alias("total_errors")) \
        .select("total_requests", F.coalesce("total_errors", F.lit(0)).alias("total_errors"),
                F.round(F.coalesce(F.try_divide(F.col("total_errors").cast("double"), F.col("total_requests")),
                                   F.lit(0.0)), 4).alias("error_rate"))


def _retrievals(req: DataFrame) -> DataFrame:
    return req.filter(F.col("endpoint").isin(RETRIEVAL_ENDPOINTS) & F.col("success"))


def confidence_and_usage(req: DataFrame) -> DataFrame:
    """Mean top confidence and learned-ranker share over successful
    retrieval requests (4 d.p.; 0.0 when there are none)."""
    r = _retrievals(req)
    return r.agg(F.round(F.coalesce(F.avg("top_confidence"), F.lit(0.0)), 4).alias("avg_confidence"),
                 F.round(F.coalesce(F.avg(F.col("used_learned_ranker").cast("double")), F.lit(0.0)), 4)
                 .alias("learned_ranker_usage_pct"))


def stage_breakdown(req: DataFrame) -> DataFrame:
    """Mean milliseconds of each pipeline stage over successful retrieval
    requests (1 d.p.), one row per stage with its share of the total."""
    r = _retrievals(req)
    means = r.agg(*[F.avg(s).alias(s) for s in STAGES])
    stacked = means.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("ms"))
                                               for s in STAGES])).alias("x")).select("x.stage", "x.ms")
    total = F.sum("ms").over(Window.partitionBy())  # five rows
    return stacked.select("stage", round_half_up("ms", 1).alias("avg_ms"),
                          F.round(F.coalesce(F.try_divide(F.col("ms"), total), F.lit(0.0)), 4).alias("share"))


def metrics_summary(req: DataFrame) -> DataFrame:
    """The whole summary in one row (zeros and empty lists when there are no
    requests): totals, stage means, and the per-endpoint figures as lists in
    order of ``endpoints``.

    One aggregation per endpoint holds the sums that the totals need; a total
    is a sum of a few endpoint rows, next to their exact percentiles."""
    ret = F.col("endpoint").isin(RETRIEVAL_ENDPOINTS) & F.col("success")
    means = {"top_confidence": F.col("top_confidence"), "used_learned_ranker": F.col("used_learned_ranker").cast("double"),
             **{s: F.col(s) for s in STAGES}}
    sums = [x for name, c in means.items()
            for x in (F.sum(F.when(ret, c)).alias(f"s_{name}"), F.count(F.when(ret, c)).alias(f"n_{name}"))]
    per = req.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("count"), F.sum((~F.col("success")).cast("long")).alias("error_count"),
        round_half_up(F.avg("latency_ms"), 1).alias("avg"), *sums)
    pct = exact_percentiles(req, "endpoint", "latency_ms", [50, 95, 99])
    per = per.join(pct.withColumnRenamed("endpoint", "_e"), F.col("endpoint").eqNullSafe(F.col("_e")), "left").drop("_e")
    z = F.lit(0.0)
    mean = {name: F.coalesce(F.try_divide(F.sum(f"s_{name}"), F.sum(f"n_{name}")), z) for name in means}
    total, errors = F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("error_count"), F.lit(0))
    rows = F.array_sort(F.collect_list(F.struct(
        "endpoint", "count", round_half_up("p50", 1).alias("p50"), round_half_up("p95", 1).alias("p95"),
        round_half_up("p99", 1).alias("p99"), "avg", "error_count")))
    out = per.agg(total.alias("total_requests"), errors.alias("total_errors"),
                  F.round(F.coalesce(F.try_divide(errors.cast("double"), total), z), 4).alias("error_rate"),
                  F.round(mean["top_confidence"], 4).alias("avg_confidence"),
                  F.round(mean["used_learned_ranker"], 4).alias("learned_ranker_usage_pct"),
                  F.count(F.lit(1)).alias("n_endpoints"), *(round_half_up(mean[s], 1).alias(s) for s in STAGES), rows.alias("_rows"))
    lists = {"endpoints": "endpoint", "counts": "count", "latency_p50_ms": "p50", "latency_p95_ms": "p95",
             "latency_p99_ms": "p99", "latency_avg_ms": "avg", "error_counts": "error_count"}
    return out.select(*[c for c in out.columns if c != "_rows"], *(F.col(f"_rows.{f}").alias(c) for c, f in lists.items()))


def recent_buffer(req: DataFrame, n: int = 1000) -> DataFrame:
    """The last ``n`` requests, newest first (top-n, not a global window)."""
    return req.orderBy(F.col("timestamp").desc(), F.col("request_id").desc()).limit(n)


def latency_history(req: DataFrame, endpoint: str | None = None, n: int = 100) -> DataFrame:
    """Last ``n`` points of one endpoint (or all), returned oldest first."""
    r = req if endpoint is None else req.filter(F.col("endpoint") == endpoint)
    last = r.orderBy(F.col("timestamp").desc(), F.col("request_id").desc()).limit(n)
    return last.select("request_id", "timestamp", "latency_ms", F.col("top_confidence").alias("confidence"),
                       "success").orderBy("timestamp", "request_id")
