import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from ranksmith.streaming import metrics as sm


def test_late_event_dropped_by_watermark(spark):
    src = tempfile.mkdtemp(prefix="rs-stream-src-")
    ckpt = tempfile.mkdtemp(prefix="rs-stream-ckpt-")
    out = os.path.join(ckpt, "out")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t0 = dt.datetime(2024, 1, 1, 0, 0)

    def batch(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, name))

    batch("b1", [(1, t0 + dt.timedelta(minutes=5), 0, "view", 10.0, '{"k": 1}'),
                 (2, t0 + dt.timedelta(hours=3), 0, "view", 20.0, '{"k": 2}')])
    stream_path = os.path.join(src, "*")
    schema_df = spark.read.parquet(os.path.join(src, "b1")).schema

    def run():
        ev = spark.readStream.schema(schema_df).parquet(stream_path)
        from ranksmith.operators.telemetry import requests_from_events
        agg = sm.windowed_endpoint_metrics(requests_from_events(ev), "1 hour", None, "10 minutes")
        q = (agg.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", os.path.join(ckpt, "c")).trigger(availableNow=True).start(out))
        q.awaitTermination()

    run()
    # second batch: one event far behind the watermark (late) and one new
    batch("b2", [(3, t0 + dt.timedelta(minutes=20), 0, "view", 99.0, '{"k": 3}'),
                 (4, t0 + dt.timedelta(hours=6), 0, "view", 30.0, '{"k": 4}')])
    run()
    res = spark.read.parquet(out)
    first = res.filter(F.col("w.start") == F.lit(t0).cast("timestamp")).collect()
    assert len(first) == 1 and first[0].n == 1  # the late event did not join its window


def _first_by_brute_force(batches, delay_us, expiry_us):
    """Records of the batches that open a span: late ones are dropped by the
    watermark of the batches before, then the rest in order of time."""
    mark, kept = None, []
    for rows in batches:
        kept += [r for r in rows if r[1] is not None and (mark is None or r[1] > mark)]
        top = max((r[1] for r in kept), default=None)
        if top is not None:
            mark = max(mark or 0, top // 1000 * 1000 - delay_us)
    out, until = [], {}
    for eid, us, key, value in sorted(kept, key=lambda r: (r[1], r[0])):
        if us <= mark and (key not in until or us >= until[key]):
            out.append((eid, us, key, value))
            until[key] = us + expiry_us
    return out


def test_first_per_key_in_event_time(spark):
    """Out-of-order and late events over several batches, ties, null keys and
    times, a hot key: equal to a brute force."""
    import random
    from ranksmith.streaming.first import first_per_key
    rng = random.Random(7)
    minute = 60_000_000
    start = 1_704_067_200_000_000
    batches, eid = [], 0
    for b in range(4):
        rows = []
        for _ in range(60):
            eid += 1
            us = start + b * 60 * minute + rng.randrange(-90, 60) * minute + rng.randrange(3)
            rows.append((eid, us, rng.choice(["a", "a", "a", "b", "c", None]), rng.random()))
        rows += [(eid + 1, rows[0][1], rows[0][2], 0.5), (eid + 2, None, "a", 0.5)]  # a tie and a null time
        eid += 2
        batches.append(rows)
    src, ckpt = tempfile.mkdtemp(prefix="rs-first-src-"), tempfile.mkdtemp(prefix="rs-first-ckpt-")
    schema = "event_id long, ts timestamp_ntz, k string, value double"
    epoch = dt.datetime(1970, 1, 1)
    for i, rows in enumerate(batches):
        data = [(e, None if us is None else epoch + dt.timedelta(microseconds=us), k, v) for e, us, k, v in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
        stream = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
        first = first_per_key(stream, ["k"], "event_id", "ts", "60 minutes", dt.timedelta(minutes=45))
        q = (first.writeStream.format("parquet").option("checkpointLocation", os.path.join(ckpt, "c"))
             .trigger(availableNow=True).start(os.path.join(ckpt, "out")))
        q.awaitTermination()
    got = spark.read.parquet(os.path.join(ckpt, "out")).select(
        "event_id", F.unix_micros("ts").alias("us"), "k", "value").collect()
    want = _first_by_brute_force(batches, 60 * minute, 45 * minute)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 8
