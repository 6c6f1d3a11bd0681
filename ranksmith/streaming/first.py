"""First record per key of a stream, in event time, with expiry.

A key's first record opens a span of length ``expiry``; later records of the
key inside the span are repetitions, the next one after it opens another span.
Which record comes first is told by event time (equal times: the smallest
``order``), not by arrival: a record is given out only when the watermark has
reached its time, so that no earlier one can follow.  Records that the
watermark has already passed when they arrive are late and dropped, as in
every event-time operator of Spark.

State per key: the end of the open span, and the list of records above the
watermark that may still become a first one, written with one call per batch.  Records inside the open span are
never kept, and the end of the span is removed when the watermark passes it, so
state stays bounded by the keys and times within ``delay`` and ``expiry``.
State lives in RocksDB, beside the checkpoint; a lost executor restores it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # all of a timestamp's digits
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstPerKey(StatefulProcessor):
    """State machine of one key: ``us`` = event time, ``ord`` = tie-break,
    ``record`` = the record as JSON."""

    def __init__(self, expiry_us: int):
        self.expiry = expiry_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "us long")
        self.waiting = handle.getListState("waiting", "us long, ord long, record string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        first: dict[int, tuple[int, str]] = {}
        for pdf in rows:
            for us, order, record in zip(pdf["us"].tolist(), pdf["ord"].tolist(), pdf["record"].tolist()):
                if (until is None or us >= until) and (us not in first or (order, record) < first[us]):
                    first[us] = (order, record)
        if first:
            self.waiting.appendList([(us, *first[us]) for us in sorted(first)])
            self.handle.registerTimer(-(-min(first) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        until = self.until.get()[0] if self.until.exists() else None
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        out = []
        for us, _, record in waiting:
            if us > now:
                break
            if until is None or us >= until:
                out.append(record)
                until = us + self.expiry
        # one timer is set per key: for its next waiting record, else for the end of its span
        rest = [w for w in waiting if w[0] > now and (until is None or w[0] >= until)]
        if len(rest) < len(waiting):
            self.waiting.put(rest) if rest else self.waiting.clear()
        if until is not None and until <= now:
            self.until.clear()
        elif out:
            self.until.update((until,))
        if rest and waiting[0][0] <= now:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        elif until is not None and until > now:
            self.handle.registerTimer(-(-until // 1000))
        if out:
            yield pd.DataFrame({"record": out})

    def close(self) -> None:
        pass


def first_per_key(events: DataFrame, keys: list[str], order: str, time: str = "ts", delay: str = "1 hour",
                  expiry: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """Streaming rows of ``events`` (all its columns) that open a span of their
    ``keys``.  Rows whose time is null are dropped; a null key is a key; a null
    ``order`` comes first."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ev = events.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    names = [f.name for f in ev.schema.fields]
    # one text as key, so that null keys of any type meet
    rows = ev.withWatermark(time, delay).select(
        F.col(time).alias("event_time"), F.unix_micros(time).alias("us"),
        F.coalesce(F.col(order).cast("long"), F.lit(-1 << 63)).alias("ord"),
        F.to_json(F.struct(*names), JSON).alias("record"), F.to_json(F.struct(*keys), JSON).alias("key"))
    out = rows.groupBy("key").transformWithStateInPandas(
        FirstPerKey(expiry // dt.timedelta(microseconds=1)), "record string", "Append", "EventTime")
    return out.select(F.from_json("record", ev.schema, JSON).alias("r")).select("r.*")
