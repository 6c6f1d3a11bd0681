"""Removal of long repeated byte strings with a run-compressed BWT.

Texts are UTF-8 bytes.  Every byte covered by a ``length``-byte string (a
window) that also starts somewhere else, in this or another document, is
removed; overlaps count, matches never cross documents, and all is judged on
the input.

1. Every window has an anchor: of its ``GRAM``-byte strings the one with the
   smallest hash, the first if equal.  Equal windows have equal anchors at
   equal places, so they meet under the anchor's hash.  Neighbouring windows
   with the same anchor form one row, (anchor, context), the context being all
   their bytes: one row for about 170 bytes of text.
2. Rows of equal contexts are repeated whole.  Anchors with one context only
   are done; where several contexts share an anchor, one row for each is
   solved together.
3. The contexts of an anchor are aligned at it and indexed by a positional
   Burrows-Wheeler transform: column by column, the rows in order of the
   bytes read backwards.  The order is kept by runs (rows that stay
   neighbours), the length of the match with the row before is handed on
   inside a run, and taken anew at the runs' ends.  These matching statistics
   stream by; a match of ``length`` bytes or more marks its window.
4. An anchor with more than ``BUCKET_ROWS`` contexts is dealt out: its windows
   are cut into narrower ranges (``WIDTHS`` windows each), whose contexts meet
   only if all bytes common to the range agree; ranges of one window need no
   index, equal windows being equal contexts.

Null and empty texts have nothing removed.  Repeated rows are copies of each
other (all of a copy's bytes go if it is ``length`` bytes long).  Windows,
anchors and contexts are told apart by 64-bit hashes.  An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mix64, slices, stored
from .hashing import prefix_sums

LENGTH = 400
GRAM = 64
PIECE = 1 << 20
BUCKET_ROWS = 512
WIDTHS = (32, 1)
SEGMENT_ROWS = 2048
FILTER_BITS = 1 << 27
ROWS = "key long, ctx long, doc_id long, tid long, p long, q1 long, q2 long"


def text_id(data: bytes) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(data))))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of ``width`` neighbours."""
    n = len(v) - width + 1
    pad = np.full(-len(v) % width, np.iinfo(v.dtype).max, v.dtype)
    blocks = np.concatenate([v, pad]).reshape(-1, width)
    to = np.minimum.accumulate(blocks, axis=1).ravel()
    frm = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(frm[:n], to[width - 1:width - 1 + n])


def anchor_rows(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE
                ) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, context hash, p, q1, q2): rows of neighbouring
    windows, starting at q1 to q2, with the anchor at p (places in the text)."""
    out: list[tuple[np.ndarray, ...]] = []
    end_of = np.repeat(off[1:], np.diff(off))
    for lo in range(0, len(data), piece):
        part = data[lo:lo + piece + length - 1]
        if len(part) < length:
            break
        q = np.arange(len(part) - length + 1)
        whole = end_of[lo:lo + len(q)] - lo - q >= length
        if not whole.any():
            continue
        sums, down = prefix_sums(part)
        h = mix64((sums[gram:] - sums[:-gram]) * down[:len(part) - gram + 1])
        # 40 bits decide, then the place
        place = np.arange(len(h), dtype=np.uint64)
        owner = (_sliding_min((h >> np.uint64(24) << np.uint64(24)) | place, length - gram + 1)
                 & np.uint64((1 << 24) - 1)).astype(np.int64)
        q = q[whole]
        own = owner[q]
        doc_end = end_of[lo + q]
        new = np.r_[True, (own[1:] != own[:-1]) | (q[1:] != q[:-1] + 1) | (doc_end[1:] != doc_end[:-1])]
        a = np.flatnonzero(new)
        q1, q2, p = q[a], q[np.r_[a[1:], len(q)] - 1], own[a]
        ctx = mix64((sums[q2 + length] - sums[q1]) * down[q1] + mix64(((p - q1) * 4096 + q2 - q1).astype(np.uint64)))
        doc = np.searchsorted(off, q1 + lo, side="right") - 1
        base = off[doc] - lo
        out.append((doc, h[p], ctx, p - base, q1 - base, q2 - base))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e.astype(np.uint64), e, e, e
    return tuple(np.concatenate(c) for c in zip(*out))


def _texts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data, off = bytes_of(b.column("text"))
    raw = data.tobytes()
    return data, off, [raw[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist())]


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            data, off, texts = _texts(b)
            doc, key, ctx, p, q1, q2 = anchor_rows(data, off, length, gram)
            if not len(doc):
                continue
            tid = np.array([text_id(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(key.view(np.int64)), "ctx": pa.array(ctx.view(np.int64)),
                "doc_id": b.column("doc_id").take(pa.array(doc)), "tid": pa.array(tid[doc]),
                "p": pa.array(p), "q1": pa.array(q1), "q2": pa.array(q2)})
    return run


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose context is repeated, one row for each context of the keys
    with several, with their number ``ctxs``)."""
    mark = F.xxhash64("doc_id", "tid", "q1")
    ctx = stored(rows.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(mark).alias("first")), "rep-ctx")
    keys = stored(ctx.groupBy("key").agg(F.count(F.lit(1)).alias("ctxs"), F.max("n").alias("most"))
                  .where("ctxs > 1 or most > 1").select("key", "ctxs"), "rep-keys")
    live = stored(ctx.join(keys, "key"), "rep-live")
    found = stored(rows.withColumn("mark", mark).join(live, ["key", "ctx"]), "rep-found")
    again = found.where("n > 1").select("doc_id", "tid", "q1", "q2")
    solve = found.where("ctxs > 1 and (n = 1 or mark = first)").drop("mark", "first", "n")
    return again, solve


def bit_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashes of an id column: eight for each id, 16 MB at most."""
    m = 1 << 13
    while m < min(FILTER_BITS, 8 * ids.count()):
        m *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(m, bool)
        for b in batches:
            bits[_cell(b.column(column).to_numpy(), m)] = True
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    mask = np.zeros(m // 8, np.uint8)
    for r in ids.select(column).coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        mask |= np.frombuffer(r["bits"], np.uint8)
    return mask


def _cell(ids: np.ndarray, m: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64(m - 1)).astype(np.int64)


def _passing(docs: DataFrame, mask: np.ndarray) -> DataFrame:
    """Rows (doc_id, tid, text) that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for b in slices(batches, "text", 4 << 20):
            tid = np.array([text_id(t) for t in _texts(b)[2]], np.int64)
            hit = pa.array(bits[_cell(tid, len(bits))])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "tid": pa.array(tid),
                                              "text": b.column("text")}).filter(hit)
    return docs.mapInArrow(run, "doc_id long, tid long, text string")


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            _, _, texts = _texts(b)
            rows = b.column("rows")
            size = np.diff(np.asarray(rows.offsets))
            flat = rows.flatten()
            at = np.repeat(np.arange(b.num_rows), size)
            q1, q2 = np.asarray(flat.field("q1")), np.asarray(flat.field("q2"))
            data = [texts[k][i:j + length] for k, i, j in zip(at.tolist(), q1.tolist(), q2.tolist())]
            take = pa.array(at)
            yield pa.RecordBatch.from_pydict(
                {c: flat.field(c) for c in ("key", "ctx")} | {"doc_id": b.column("doc_id").take(take),
                                                             "tid": b.column("tid").take(take)}
                | {c: flat.field(c) for c in ("p", "q1", "q2", "ctxs")} | {"data": pa.array(data, pa.binary())})
    return run


def _narrow(width: int, length: int):
    """Cut rows into ranges of ``width`` windows under keys of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data", 1 << 20):
            data, off = bytes_of(b.column("data"))
            sums, down = prefix_sums(data)
            key, p, q1, q2 = (b.column(c).to_numpy() for c in ("key", "p", "q1", "q2"))
            lo, hi = (p - q2) // width, (p - q1) // width
            n = hi - lo + 1
            at = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[at]
            a = np.maximum(q1[at], p[at] - (k + 1) * width + 1)
            z = np.minimum(q2[at], p[at] - k * width)
            shift = off[at] - q1[at]
            # the bytes that all windows of the full range have
            c1, c2 = p[at] - k * width + shift, p[at] - (k + 1) * width + 1 + length + shift
            core = mix64((sums[c2] - sums[c1]) * down[c1] + mix64(k.astype(np.uint64)))
            new = mix64(core + mix64(key[at].view(np.uint64)))
            i, j = a + shift, z + length + shift
            ctx = mix64((sums[j] - sums[i]) * down[i] + mix64(((p[at] - a) * 4096 + z - a).astype(np.uint64)))
            raw = data.tobytes()
            part = [raw[x:y] for x, y in zip(i.tolist(), j.tolist())] if width > 1 else [b""] * len(at)
            take = pa.array(at)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(new.view(np.int64)), "ctx": pa.array(ctx.view(np.int64)),
                "doc_id": b.column("doc_id").take(take), "tid": b.column("tid").take(take),
                "p": pa.array(p[at]), "q1": pa.array(a), "q2": pa.array(z), "data": pa.array(part, pa.binary())})
    return run


def matched_windows(key: np.ndarray, p: np.ndarray, q1: np.ndarray, q2: np.ndarray, data: list[bytes],
                    length: int) -> np.ndarray:
    """Marks of the windows that another row of the same key has; column c
    stands for the window that starts ``c - widest`` bytes from p, the widest
    left part being that of the rows.  Rows are ordered by key."""
    n = len(key)
    left, right = p - q1, q2 + length - p
    zero, wide = int(left.max()), int(left.max() + right.max())
    text = np.full((wide, n), 256, np.int64)  # 256: outside the context
    for r, s in enumerate(data):
        text[zero - left[r]:zero + right[r], r] = np.frombuffer(s, np.uint8)
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]]) * 512
    marks = np.zeros((wide - length + 1, n), bool)
    order, since = np.arange(n), np.zeros(n + 1, np.int64)  # column where the match with the row before begins
    for c in range(wide):
        code = (group + text[c])[order]
        step = np.argsort(code, kind="stable")
        code, order = code[step], order[step]
        same = np.r_[False, (code[1:] == code[:-1]) & (code[1:] & 511 < 256)]
        fresh = np.full(n + 1, c + 1)
        run = same & np.r_[False, step[1:] == step[:-1] + 1]
        fresh[:-1][run] = since[step[run]]
        head = np.flatnonzero(same & ~run)  # where a run begins: the longest of what lies between
        if len(head):
            span = np.stack([step[head - 1] + 1, step[head] + 1], axis=1).ravel()
            fresh[head] = np.maximum.reduceat(since, span)[::2]
        since = fresh
        if c >= length - 1:
            far = np.flatnonzero(c + 1 - since[:-1] >= length)
            marks[c + 1 - length, order[far]] = True
            marks[c + 1 - length, order[far - 1]] = True
    return marks.T


def _solve(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in _by_key(batches):
            p, q1 = df["p"].to_numpy(), df["q1"].to_numpy()
            marks = matched_windows(df["key"].to_numpy(), p, q1, df["q2"].to_numpy(), df["data"].tolist(), length)
            zero = int((p - q1).max())
            edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            r, a = np.nonzero(edge == 1)
            _, z = np.nonzero(edge == -1)
            if len(r):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(df["doc_id"], from_pandas=True, type=pa.int64()).take(pa.array(r)),
                    "tid": pa.array(df["tid"].to_numpy()[r]),
                    "q1": pa.array(p[r] - zero + a), "q2": pa.array(p[r] - zero + z - 1)})
    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows ordered by key, some keys at a time, none of them cut."""
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, SEGMENT_ROWS):
            held.append(b.slice(at, SEGMENT_ROWS).to_pandas())
            size += len(held[-1])
            if size >= SEGMENT_ROWS:
                df = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted(df["key"].to_numpy(), df["key"].iloc[-1]))
                if last:
                    yield df.iloc[:last].reset_index(drop=True)
                    df = df.iloc[last:]
                held, size = [df], len(df)
    if size:
        yield pd.concat(held, ignore_index=True)


def _clean(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            out = []
            given = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
            for t, spans in zip(_texts(b)[2], given):
                merged: list[list[int]] = []
                for s in sorted((s["q1"], s["q2"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1] + length)
                    else:
                        merged.append([s[0], s[1] + length])
                kept, at = [], 0
                for i, j in merged:
                    kept.append(t[at:i])
                    at = j
                kept.append(t[at:])
                left = b"".join(kept)
                out.append((len(t), len(t) - len(left), len(merged), hashlib.sha256(left).hexdigest(), len(left)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept"])
    return run


def repeated_windows(d: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, tid, q1, q2) of ``d`` (doc_id, text): ranges of repeated windows."""
    again, solve = _settled(stored(d.mapInArrow(_anchors(length, gram), ROWS), "rep-anchors"))
    found = [again]
    # equal rows ask for the same
    solve = solve.select("doc_id", "tid", "key", "ctx", "p", "q1", "q2", "ctxs").distinct()
    wanted = stored(solve.groupBy("doc_id", "tid").agg(
        F.collect_list(F.struct("key", "ctx", "p", "q1", "q2", "ctxs")).alias("rows")), "rep-wanted")
    w = wanted.select(F.col("doc_id").alias("_d"), F.col("tid").alias("_t"), "rows")
    texts = _passing(d, bit_filter(wanted, "tid"))
    at = texts.join(w, (F.col("tid") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    todo = stored(at.select("doc_id", "tid", "text", "rows").mapInArrow(
        _contexts(length), ROWS + ", ctxs long, data binary"), "rep-contexts")
    for width in (*WIDTHS, 0):
        found.append(todo.where(F.col("ctxs") <= bucket_rows).select("key", "doc_id", "tid", "p", "q1", "q2", "data")
                     .repartition("key").sortWithinPartitions("key")
                     .mapInArrow(_solve(length), "doc_id long, tid long, q1 long, q2 long"))
        hot = todo.where(F.col("ctxs") > bucket_rows)
        if not width or not hot.limit(1).count():
            break
        again, todo = _settled(stored(hot.mapInArrow(_narrow(width, length), ROWS + ", data binary"), "rep-narrow"))
        found.append(again)
        if width == 1:  # equal windows are equal contexts
            break
        todo = stored(todo, "rep-contexts")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept (bytes that
    stay) of every row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = stored(repeated_windows(d, length, gram, bucket_rows).distinct().groupBy("doc_id", "tid").agg(
        F.collect_list(F.struct("q1", "q2")).alias("spans")), "rep-spans")
    mask = bit_filter(spans, "tid")
    s = spans.select(F.col("doc_id").alias("_d"), F.col("tid").alias("_t"), "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long"
    touched = _passing(d, mask).join(s, (F.col("tid") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)

        def rest():
            for b in slices(batches, "text", 4 << 20):
                tid = np.array([text_id(t) for t in _texts(b)[2]], np.int64)
                yield b.filter(pa.array(~bits[_cell(tid, len(bits))]))
        yield from _clean(length)(rest())

    return touched.select("doc_id", "text", "spans").mapInArrow(_clean(length), schema).unionAll(
        d.mapInArrow(others, schema))
