"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.session import checkpoint_dir

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB, where the session leaves Spark's 64 MB:
    two tasks' batches, and the arrays made of them, share an executor."""
    given = spark.conf.get(ARROW_BYTES).lower().rstrip("b")
    if given.isdigit() and int(given) >= 64 << 20:
        spark.conf.set(ARROW_BYTES, "4m")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, keeps the columns prunable and survives the loss of
    executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the rows no model of this package learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20,
           max_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` in each
    piece (one row at least): bounds a task's working memory whatever the
    texts' lengths."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = offsets_of(batch.column(column)).astype(np.int64)
        ends = ends - ends[0]
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), at + max_rows, n)
            yield batch.slice(at, to - at)
            at = to
        batch = None
    give_back()


_MEMO_OF: list = [None]
TABLES: list = []  # calls that give up tables which any operator may make again


def sole_memo(forget=None) -> None:
    """A worker keeps the memo of one operator at a time: the one kept
    before, if it is another's, is forgotten, and so are shared tables; their
    memory goes back at once, before the new operator's first batch."""
    before, _MEMO_OF[0] = _MEMO_OF[0], forget
    if before != forget:
        for give_up in [before, *TABLES]:
            if give_up is not None:
                give_up()
        before = give_up = None
        give_back()


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers live
    on from stage to stage beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU system
        pass


def offsets_of(arr: pa.Array) -> np.ndarray:
    """Byte offsets (rows + 1) of a string or binary array."""
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    buf = arr.buffers()[1]
    if buf is None:
        return np.zeros(len(arr) + 1, dtype=kind)
    return np.frombuffer(buf, dtype=kind)[arr.offset:arr.offset + len(arr) + 1]


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array as (uint8 bytes, int64 offsets from 0); nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    off = offsets_of(arr).astype(np.int64)
    data = arr.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
