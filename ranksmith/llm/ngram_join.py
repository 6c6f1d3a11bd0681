"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set holds its distinct shingles of ``rule.width`` words (words
are runs of bytes other than ASCII white space, A-Z lower-cased; fewer words:
the whole sequence as one shingle).  Sets link when their Jaccard similarity is
at least ``rule.num / rule.den``.  Shingles and sets are told apart by 64-bit hashes.

1. Equal sets have equal answers: they become one node.
2. A prefix of each set, its rarest shingles first, is indexed.  How rare a
   shingle is comes from counts by hash cell over all documents; any order
   that all sets share keeps the join exact, so the cells' fixed number
   affects the speed only.
3. An index list is ordered by set size and skipped in blocks: beyond the
   size bound, where the position leaves too few shingles to share, and where
   the parity bitmaps (one bit flip per shingle) differ in more bits than two
   linked sets can differ in shingles.  Lists of more than ``LIST_ROWS`` rows
   are dealt out in blocks, and pairs of blocks meet in separate tasks.
4. The remaining pairs are compared nearest first, and those whose sets are
   already joined through more similar sets are skipped, their answers being
   derived: this leaves a forest of pairs in each part of the index.
5. The forest's pairs are checked on the whole sets.  Where one fails, the
   answers that were derived through it are open again: all pairs of the
   index that still lie in different components are then checked too.

Null and empty texts have empty sets and link with nothing.  Repeated rows
count as equal sets.  A null doc_id is never a component's name (rows with
none but such ids have a null component).  An empty table gives no rows, and
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mix64, slices, sole_memo, stored
from .hashing import chain, words
from .links import components

WIDTH = 3
NUM, DEN = 9, 10
CELLS = 1 << 22
CELL_PARTS = 64
LIST_ROWS = 20_000
BLOCK_ROWS = 60_000
PAIR_BLOCK = 1_000_000
FILTER_BITS = 1 << 27
BROADCAST_IDS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the similarity from which sets link."""
    width: int = WIDTH
    num: int = NUM
    den: int = DEN

    def need(self, a, b):
        """Smallest shared number at which sets of a and b shingles link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def need_own(self, n: int) -> int:
        """Shared shingles without which a set of n links with none."""
        return -(-self.num * n // self.den)


RULE = Rule()


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = bytes_of(texts)
    h, at = words(data, off)
    runs = chain(h, width)
    ends = np.searchsorted(at, np.arange(len(texts) + 1))
    none = np.zeros(0, np.uint64)
    out = []
    for lo, hi in zip(ends[:-1], ends[1:]):
        if hi - lo >= width:
            out.append(np.unique(runs[lo:hi - width + 1]))
        else:
            out.append(chain(h[lo:hi], int(hi - lo)) if hi > lo else none)
    return out


def signature(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes()))))


def parity_bits(s: np.ndarray) -> bytes:
    """Bit i is the parity of the shingles that hash to i; as many bits as
    the next power of two from the set's size (128 at least)."""
    m = max(128, 1 << max(0, len(s) - 1).bit_length())
    flips = np.bincount((s >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _info(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    sole_memo()
    for b in slices(batches, "text", 1 << 20):
        sets = shingle_sets(b.column("text"), rule.width)
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
            "sig": pa.array([signature(s) for s in sets], pa.int64()),
            "bits": pa.array([parity_bits(s) for s in sets], pa.binary())})


def _cells(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    cells, held = None, []
    for b in slices(batches, "text", 1 << 20):
        for s in shingle_sets(b.column("text"), rule.width):
            if not len(s) or (k := signature(s)) in seen:
                continue
            if len(seen) < 1 << 18:
                seen.add(k)
            held.append(s >> np.uint64(42))
        if held:
            cells = np.zeros(CELLS, np.uint32) if cells is None else cells
            np.add.at(cells, np.concatenate(held).astype(np.int64), 1)
            held = []
    if cells is not None:
        parts = np.minimum(cells, 65_535).astype("<u2").reshape(CELL_PARTS, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(CELL_PARTS), pa.int32()),
                                          "counts": pa.array([p.tobytes() for p in parts], pa.binary())})


def _sum_cells(key, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CELLS // CELL_PARTS, np.int64)
    for c in pdf["counts"]:
        total += np.frombuffer(c, "<u2")
    return pd.DataFrame({"part": [key[0]], "counts": [np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()]})


def cell_counts(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Shingles per hash cell over all documents (16 MB, whatever the input)."""
    rows = (docs.select("text").mapInArrow(lambda it: _cells(it, rule), "part int, counts binary")
            .groupBy("part").applyInPandas(_sum_cells, "part int, counts binary").collect())
    out = np.zeros((CELL_PARTS, CELLS // CELL_PARTS), "<u4")
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def index_rows(docs: DataFrame, cells: np.ndarray, rule: Rule) -> DataFrame:
    """(key, sig, n, pos): each set's prefix; a key is a shingle, or a pair of
    blocks of one whose cell counts more than ``LIST_ROWS``."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for b in slices(batches, "text", 1 << 20):
            out = []
            seen = set()
            for s in shingle_sets(b.column("text"), rule.width):
                n = len(s)
                if not n or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                p = n - rule.need_own(n) + 1
                weight = cells[(s >> np.uint64(42)).astype(np.int64)]
                order = np.lexsort((mix64(s), weight))[:p]
                pre, w = s[order], weight[order]
                hot = np.flatnonzero(w > LIST_ROWS)
                cold = np.flatnonzero(w <= LIST_ROWS)
                out.append((pre[cold], np.full(len(cold), sig), np.full(len(cold), n), cold))
                for k in hot:
                    blocks = int(-(-int(w[k]) // LIST_ROWS))
                    own = (sig & 0x7FFFFFFFFFFFFFFF) % blocks
                    i, j = np.minimum(own, np.arange(blocks)), np.maximum(own, np.arange(blocks))
                    key = mix64(pre[k] + mix64((i * blocks + j + 1).astype(np.uint64)))
                    out.append((key, np.full(blocks, sig), np.full(blocks, n), np.full(blocks, k)))
            if out:
                key, sig, n, pos = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key.astype(np.uint64).view(np.int64)), "sig": pa.array(sig.astype(np.int64)),
                    "n": pa.array(n.astype(np.int32)), "pos": pa.array(pos.astype(np.int32))})
    return docs.select("text").mapInArrow(run, "key long, sig long, n int, pos int")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows ordered by key, cut between two keys."""
    held, size = [], 0
    for b in batches:
        held.append(b.to_pandas())
        size += len(held[-1])
        if size >= BLOCK_ROWS:
            df = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(df["key"].to_numpy(), df["key"].iloc[-1]))
            if last:
                yield df.iloc[:last]
                df = df.iloc[last:]
            held, size = [df], len(df)
    if size:
        yield pd.concat(held, ignore_index=True)


def _shared(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Index rows whose list holds another set of fitting size."""
    for df in _lists(batches):
        df = df.drop_duplicates(["key", "sig"]).sort_values(["key", "n"], kind="stable")
        key, n = df["key"].to_numpy(), df["n"].to_numpy().astype(np.int64)
        fits = (key[1:] == key[:-1]) & (rule.num * n[1:] <= rule.den * n[:-1])
        df = df[np.r_[False, fits] | np.r_[fits, False]]
        if len(df):
            yield pa.RecordBatch.from_pandas(df, preserve_index=False)


def _hamming(bits: list[bytes], i: np.ndarray, j: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Differing bits of the bitmaps i and j; the longer one is folded."""
    out = np.zeros(len(i), np.int64)
    low = np.minimum(width[i], width[j])
    for w in np.unique(low):
        at = np.flatnonzero(low == w)
        used, where = np.unique(np.r_[i[at], j[at]], return_inverse=True)
        table = np.zeros((len(used), w), np.uint8)
        for r, k in enumerate(used):
            table[r] = np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint8).reshape(-1, w), axis=0)
        table = table.view(np.uint64)
        a, b = where[:len(at)], where[len(at):]
        step = max(1, (4 << 20) // table.shape[1])
        for lo in range(0, len(at), step):
            out[at[lo:lo + step]] = np.bitwise_count(table[a[lo:lo + step]] ^ table[b[lo:lo + step]]).sum(axis=1)
    return out


def candidate_pairs(df: pd.DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) of row pairs of one list that may link; with a
    ``label`` column, only pairs of different labels."""
    df = df.sort_values(["key", "n", "pos"], kind="stable", ignore_index=True)
    key, n, pos = df["key"].to_numpy(), df["n"].to_numpy().astype(np.int64), df["pos"].to_numpy()
    label = df["label"].to_numpy() if "label" in df else None
    sigs, first, node = np.unique(df["sig"].to_numpy(), return_index=True, return_inverse=True)
    bits = df["bits"].iloc[first].tolist()
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    size_of = n[first]
    seen = np.zeros(0, np.int64)
    found: list[np.ndarray] = []

    def settle(held):
        """Compare the pairs that are new; a pair meets in many lists."""
        nonlocal seen
        code = np.unique(np.concatenate(held))
        if len(seen):
            at = np.minimum(np.searchsorted(seen, code), len(seen) - 1)
            code = code[seen[at] != code]
        if not len(code):
            return
        seen = np.union1d(seen, code) if len(seen) else code
        i, j = code // len(sigs), code % len(sigs)
        h = _hamming(bits, i, j, width)
        ok = h <= size_of[i] + size_of[j] - 2 * rule.need(size_of[i], size_of[j])
        found.append(np.stack([sigs[i[ok]], sigs[j[ok]], h[ok]]))

    open_rows, k, held, size = np.arange(len(df)), 1, [], 0
    while len(open_rows):
        open_rows = open_rows[open_rows + k < len(df)]
        i, j = open_rows, open_rows + k
        go = (key[i] == key[j]) & (rule.num * n[j] <= rule.den * n[i])
        open_rows = i = i[go]
        j = j[go]
        ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= rule.need(n[i], n[j])
        if label is not None:
            ok &= label[i] != label[j]
        if ok.any():
            x, y = node[i[ok]], node[j[ok]]
            held.append(np.minimum(x, y) * len(sigs) + np.maximum(x, y))
            size += len(x)
            if size >= PAIR_BLOCK:
                settle(held)
                held, size = [], 0
        k += 1
    if held:
        settle(held)
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e
    a, b, h = np.concatenate(found, axis=1)
    return a, b, h


def _forest(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs, nearest first, that join sets not joined before."""
    for df in _lists(batches):
        a, b, h = candidate_pairs(df, rule)
        order = np.lexsort((b, a, h))
        up: dict[int, int] = {}

        def root(x):
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = up[x]
            return x

        out = []
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            r, s = root(x), root(y)
            if r != s:
                up[r] = s
                out.append((x, y))
        if out:
            x, y = zip(*out)
            yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def _crossing(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """All candidate pairs of different components."""
    for df in _lists(batches):
        a, b, _ = candidate_pairs(df, rule)
        if len(a):
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def _filter_bits(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    bits = None
    for b in batches:
        s = mix64(b.column("sig").to_numpy().view(np.uint64)).astype(np.int64) & (m - 1)
        bits = np.zeros(m, bool) if bits is None else bits
        bits[s] = True
    if bits is not None:
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _texts_of(docs: DataFrame, sigs: DataFrame, rule: Rule) -> DataFrame:
    """(sig, text) of one document per wanted set.

    A bit filter of the wanted signatures (eight bits for each, 16 MB at
    most) keeps most other texts out of the shuffle; the join is exact.
    """
    m = 1 << 13
    while m < min(FILTER_BITS, 8 * sigs.count()):
        m *= 2
    mask = np.zeros(m // 8, np.uint8)
    parts = sigs.coalesce(16).mapInArrow(lambda it: _filter_bits(it, m), "bits binary")
    for r in parts.toLocalIterator():
        mask |= np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        given: set[int] = set()
        for b in slices(batches, "text", 1 << 20):
            sig = np.array([signature(s) if len(s) else 0 for s in shingle_sets(b.column("text"), rule.width)], np.int64)
            hit = bits[mix64(sig.view(np.uint64)).astype(np.int64) & (len(bits) - 1)]
            keep = [k for k in np.flatnonzero(hit).tolist()
                    if sig[k] not in given and (len(given) > 1 << 18 or given.add(int(sig[k])) is None)]
            if keep:
                yield pa.RecordBatch.from_pydict({"sig": pa.array(sig[keep]),
                                                  "text": b.column("text").take(pa.array(keep))})
    made = docs.select("text").mapInArrow(run, "sig long, text string")
    return made.join(sigs, "sig").groupBy("sig").agg(F.max("text").alias("text"))


def _verify(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "ta", 1 << 20):
        ok = []
        for x, y in zip(shingle_sets(b.column("ta"), rule.width), shingle_sets(b.column("tb"), rule.width)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(rule.den * both >= rule.num * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b"), "ok": pa.array(ok, pa.bool_())})


def _checked(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, ok) of pairs of signatures, from the whole sets."""
    sigs = stored(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "join-sigs")
    texts = stored(_texts_of(docs, sigs, rule), "join-texts")
    with_a = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b")
    return stored(with_b.select("a", "b", "ta", "tb").mapInArrow(lambda it: _verify(it, rule), "a long, b long, ok boolean"), "join-checked")


def grouped(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(doc_id, n_shingles, component_id, sig) of every row of ``docs``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    info = stored(d.mapInArrow(lambda it: _info(it, rule), "doc_id long, n long, sig long, bits binary"), "join-sets")
    rows = index_rows(d, cell_counts(d, rule), rule)
    index = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _shared(it, rule), rows.schema), "join-index")
    bits = info.where("n > 0").groupBy("sig").agg(F.max("bits").alias("bits"))

    def by_list(rows: DataFrame, run) -> DataFrame:
        frame = rows.join(bits, "sig")
        return stored(frame.repartition("key").sortWithinPartitions("key")
                      .mapInArrow(lambda it: run(it, rule), "a long, b long").distinct(), "join-pairs")

    tested = _checked(d, by_list(index, _forest), rule)
    links = tested.where("ok").select("a", "b")
    roots = components(links)
    if tested.where("not ok").limit(1).count():
        seen = stored(tested.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "join-open")
        labels = seen.join(roots, seen.sig == roots.node, "left").select(
            "sig", F.coalesce("root", "sig").alias("label"))
        more = by_list(index.join(stored(labels, "join-labels"), "sig"), _crossing)
        more = stored(more.join(tested, ["a", "b"], "left_anti"), "join-more")
        links = _checked(d, more, rule).where("ok").select("a", "b")
        roots = components(links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = stored(info.select("doc_id", "n", "sig").join(roots, info.sig == roots.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "sig", F.coalesce("root", "sig").alias("root")), "join-roots")
    least = stored(named.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "join-least")
    return named.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
        .alias("component_id"), "sig")


def link_documents(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return grouped(docs, rule).drop("sig")


def one_of_each(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Rows of ``docs`` (all columns): the document that names its group, and
    all without shingles.  Rows of equal id and text count as one."""
    groups = stored(grouped(docs, rule).select("doc_id", "component_id"), "join-groups")
    named = groups.where("doc_id = component_id").select("doc_id")
    gone = stored(groups.where("doc_id <> component_id").select("doc_id").distinct()
                  .join(named, "doc_id", "left_anti").select(F.col("doc_id").alias("_gone")), "join-gone")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # the texts stay where they are
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs.doc_id.cast("long") == gone["_gone"], "left_anti")
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if ids else kept
