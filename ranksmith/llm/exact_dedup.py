"""Exact deduplication with an extendible-hash index on shared files.

Texts are equal when they are the same bytes after deleting all white space.
Of equal texts the row with the most code points in the original stays, then
the one with the smallest ``doc_id`` (null first), then the first one stored.

1. Heap files.  One pass normalises the texts, hashes them (64 bits) and writes
   the rows to the shared folder.  Equal texts of a slice (4 MB) become one
   *record*, told by their bytes: its first row holds the text, the number of
   rows and the best of them; the other rows only name the record.
2. Directory.  Records whose hash occurs once need nothing more.  The others
   are put into buckets by the leading bits of the hash.  A bucket beyond the
   capacity is split by its next bits, which doubles the part of the directory
   above it, until it fits or holds one hash value only.  Only the counts of
   buckets still to split reach the driver.
3. Owner tasks.  Every bucket has one owner, which reads its records ordered by
   hash and keeps a chain of different texts for a hash value, compared by
   length and bytes.  A bucket of one hash value beyond the capacity (one text
   copied into very many slices) is first dealt to several owners by record;
   what they leave, one record per text and owner, is chained again, until no
   value exceeds the capacity.
4. The owners write the index (record, its group's size and best row), and
   every row finds its group by its record, of which no slice holds many rows.

Null and empty texts are equal to each other and to texts of white space only.
Repeated rows are copies; one of them stays.  An empty table gives no rows;
extra columns are ignored.  A text of any length is compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, bytes_of, slices, stored
from .repeats import _cell, bit_filter

HASH_BITS = 64
BUCKET_BYTES = 8 << 20
BUCKET_RECORDS = 4096
SPLIT_BITS = 6  # of a bucket that is split
MAX_BUCKETS = 1 << 16  # aimed at: capacities follow the input beyond it
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True

BEST = "points long, doc_id long, row long"
HEAP = f"doc_id long, points long, sha256 string, row long, rec long, key long, size long, n long, best struct<{BEST}>, data binary"
FOUND = f"rec long, top long, n long, best struct<{BEST}>, key long, data binary, more boolean"
_BEST = pa.struct([("points", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64())])


def rank_of(points: int, doc_id: int | None, row: int) -> tuple:
    """Rows that stay sort first: most code points, smallest id, first stored."""
    return -points, doc_id is not None, doc_id or 0, row


def squeezed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a buffer without white space, and their offsets."""
    keep = ~_IS_SPACE[data]
    return data[keep], np.r_[0, np.cumsum(keep)][off]


def _heap(hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text", 4 << 20):
            data, off = bytes_of(b.column("text"))
            points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][off]
            points = np.diff(points).tolist()
            norm, at = squeezed(data, off)
            raw, at = norm.tobytes(), at.tolist()
            ids = b.column("doc_id").to_pylist()
            records: dict[bytes, int] = {}
            recs, best, count = [], {}, {}
            for i, (lo, hi) in enumerate(zip(at, at[1:])):
                rec = records.setdefault(raw[lo:hi], row + i)
                recs.append(rec)
                count[rec] = count.get(rec, 0) + 1
                own = (points[i], ids[i], row + i)
                if rec not in best or rank_of(*own) < rank_of(*best[rec]):
                    best[rec] = own
            made = {rec: (int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(t) >> (64 - hash_bits) << (64 - hash_bits)))),
                          hashlib.sha256(t).hexdigest(), t) for t, rec in records.items()}
            lead = [r == row + i for i, r in enumerate(recs)]
            out = {"doc_id": pa.array(ids, pa.int64()), "points": pa.array(points, pa.int64()),
                   "sha256": pa.array([made[r][1] for r in recs]),
                   "row": pa.array(np.arange(row, row + len(ids))), "rec": pa.array(recs, pa.int64()),
                   "key": pa.array([made[r][0] for r in recs], pa.int64()),
                   "size": pa.array([len(made[r][2]) for r in recs], pa.int64()),
                   "n": pa.array([count[r] if own else None for r, own in zip(recs, lead)], pa.int64()),
                   "best": pa.array([dict(zip(("points", "doc_id", "row"), best[r])) if own else None
                                     for r, own in zip(recs, lead)], _BEST),
                   "data": pa.array([made[r][2] if own else None for r, own in zip(recs, lead)], pa.binary())}
            row += len(ids)
            yield pa.RecordBatch.from_pydict(out)
    return run


class Directory:
    """Buckets of an extendible hash: each is the hash values that begin with
    its ``depth`` bits.  ``start`` (unsigned, ascending) is a bucket's smallest
    value; ``parts`` the owners that share it (one, or several where one hash
    value alone exceeds the capacity)."""

    def __init__(self, start: list[int], depth: list[int], parts: list[int]):
        order = np.argsort(np.array(start, np.uint64), kind="stable")
        self.start = np.array(start, np.uint64)[order]
        self.depth = np.array(depth, np.int64)[order]
        self.parts = np.array(parts, np.int64)[order]

    def owners(self, round_no: int) -> np.ndarray:
        """Owners of each bucket; every round leaves a 4,096th of them."""
        return np.maximum(self.parts >> (12 * round_no), 1)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, key.astype(np.int64).view(np.uint64), side="right") - 1

    @property
    def global_depth(self) -> int:
        return int(self.depth.max()) if len(self.depth) else 0


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, bucket_records: int = BUCKET_RECORDS,
              split_bits: int = SPLIT_BITS) -> Directory:
    """Directory of ``keys`` (key, recs, bytes: one row per hash value)."""
    total = keys.agg(F.sum("recs").alias("recs"), F.sum("bytes").alias("bytes")).first()
    bucket_bytes = max(bucket_bytes, (total["bytes"] or 0) // MAX_BUCKETS)
    bucket_records = max(bucket_records, (total["recs"] or 0) // MAX_BUCKETS)
    start, depth, parts = [], [], []

    def settle(bits, row):
        start.append((row["p"] << (64 - bits)) & ((1 << 64) - 1))
        depth.append(bits)
        over = max(-(-row["recs"] // bucket_records), -(-row["bytes"] // bucket_bytes))
        parts.append(over if row["keys"] == 1 else 1)

    bits, above, todo, spark = 0, 0, None, keys.sparkSession
    while True:
        cells = keys.withColumn("p", _prefix(bits))
        if todo is not None:  # each holds more than the capacity, which bounds their number
            split = spark.createDataFrame([(p,) for p in todo], "up long")
            cells = cells.join(F.broadcast(split), _prefix(above) == F.col("up"), "left_semi")
        rows = cells.groupBy("p").agg(F.sum("recs").alias("recs"), F.sum("bytes").alias("bytes"),
                                      F.count(F.lit(1)).alias("keys")).collect()
        todo = []
        for row in rows:
            if row["keys"] == 1 or (row["recs"] <= bucket_records and row["bytes"] <= bucket_bytes):
                settle(bits, row)
            else:
                todo.append(row["p"])
        if not todo:
            return Directory(start, depth, parts)
        above, bits = bits, min(64, bits + split_bits)


def _dealt(shared, round_no: int):
    """Records of hash values in the filter, with their bucket and owner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, mask = shared.value
        bits = None if mask is None else np.unpackbits(mask).astype(bool)
        for b in batches:
            key = b.column("key").to_numpy()
            if bits is not None:
                b = b.filter(pa.array(bits[_cell(key, len(bits))]))
                key = b.column("key").to_numpy()
            if b.num_rows and len(d.start):
                bucket = np.maximum(d.bucket(key), 0)
                owners = d.owners(round_no)[bucket]
                part = b.column("rec").to_numpy() * 0x9E3779B1 % 0x7FFFFFFF % owners
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(bucket), pa.array(part), pa.array(owners > 1)],
                    [*b.schema.names, "bucket", "part", "more"])
    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal texts of an owner's records, ordered by bucket, part and
    hash value.  Held are the different texts of one hash value with the ids of
    their records.  The records of a shared value name the first one of their
    text, their top, which goes on to the next round; all others are settled."""
    at, more, chain, out, held = None, False, [], [], 0

    def done():
        for data, recs, n, best in chain:
            out.extend((r, recs[0], n, best, at[2], data if more and r == recs[0] else None, more) for r in recs)

    def batch():
        rec, top, n, best, key, data, shared = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(rec, pa.int64()), pa.array(top, pa.int64()), pa.array(n, pa.int64()), pa.array(best, _BEST),
             pa.array(key, pa.int64()), pa.array(data, pa.binary()), pa.array(shared, pa.bool_())],
            ["rec", "top", "n", "best", "key", "data", "more"])

    for b in slices(batches, "data", 4 << 20):
        cols = [b.column(c).to_pylist() for c in ("bucket", "part", "key", "rec", "n", "best", "data", "more")]
        for bucket, part, key, rec, n, best, data, shared in zip(*cols):
            if at != (bucket, part, key):
                done()
                held += sum(len(link[0]) for link in chain) if more else 0
                if len(out) >= 4096 or held >= 4 << 20:
                    yield batch()
                    out.clear()
                    held = 0
                at, more, chain = (bucket, part, key), shared, []
            for link in chain:
                if len(link[0]) == len(data) and link[0] == data:
                    link[1].append(rec)
                    link[2] += n
                    if rank_of(**best) < rank_of(**link[3]):
                        link[3] = best
                    break
            else:
                chain.append([data, [rec], n, best])
    done()
    if out:
        yield batch()


def groups(records: DataFrame, d: Directory, mask: np.ndarray | None = None, round_no: int = 0) -> DataFrame:
    """The index: (rec, n, best) of ``records`` with a hash value that the
    filter lets through: the size and the best row of each one's group."""
    shared = records.sparkSession.sparkContext.broadcast((d, mask))
    rows = records.select("rec", "key", "n", "best", "data").mapInArrow(
        _dealt(shared, round_no),
        f"rec long, key long, n long, best struct<{BEST}>, data binary, bucket long, part long, more boolean")
    found = stored(rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key", "rec")
                   .mapInArrow(_chain, FOUND), "dedup-index")
    settled = found.where("not more").select("rec", "n", "best")
    if not len(d.parts) or d.owners(round_no).max() == 1:
        return settled
    above = groups(found.where("more and data is not null"), d, None, round_no + 1)
    named = found.where("more").select("rec", "top").join(above.withColumnRenamed("rec", "top"), "top")
    return settled.unionByName(named.select("rec", "n", "best"))


def classes(docs: DataFrame, hash_bits: int = HASH_BITS, bucket_bytes: int = BUCKET_BYTES,
            bucket_records: int = BUCKET_RECORDS, split_bits: int = SPLIT_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heap = stored(d.mapInArrow(_heap(hash_bits), HEAP), "dedup-heap")
    leads = heap.where("n is not null")
    keys = stored(leads.groupBy("key").agg(F.count(F.lit(1)).alias("recs"), F.sum("size").alias("bytes"))
                  .where("recs > 1"), "dedup-keys")
    index = groups(leads, directory(keys, bucket_bytes, bucket_records, split_bits), bit_filter(keys, "key"))
    index = index.select("rec", F.col("n").alias("_n"), F.col("best").alias("_best"))
    leads = leads.select("rec", "n", "best").join(index, "rec", "left").select(
        "rec", F.coalesce("_n", "n").alias("n"), F.coalesce("_best", "best").alias("best"))
    return heap.select("doc_id", "row", "rec", "sha256").join(leads, "rec").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha256").alias("text_sha256"))

