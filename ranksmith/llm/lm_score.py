"""Cross-entropy difference of matched target and background n-gram models.

Both models are bigram models with the same vocabulary, smoothing and size.
The vocabulary holds every word with ``MIN_COUNT`` occurrences or more in the
target documents; every other word is the unknown word, in either model.
Words are runs of bytes other than ASCII white space, A-Z lower-cased; words
and bigrams are told apart by 64-bit hashes.  Background counts are those of
all documents, scaled by s so that they amount to as many words as the
target's.  With <s> before the first word,

    p1(w)   = (s c(w) + ALPHA) / (N + ALPHA (V + 1))
    p2(w|v) = (s c(v w) + BETA p1(w)) / (s h(v) + BETA)

(s = 1 for the target; N: target words; V: vocabulary; h: times v is followed
by a word).  A token's loss is -ln p2.  A document's score is the mean over
its tokens of target loss less background loss: the lower, the nearer to the
target.  Texts without words, or null, score 0, and so do all if there is no
target document.  Repeated rows all count and are scored alike, a null doc_id
is never a target, and extra columns are ignored.

How it runs: word counts are added up per task and then by word, and written.
The documents are cut into chunks.  Each chunk asks the slots of its distinct
words for their counts, then the slots of its distinct bigrams for theirs, and
scores its documents.  A word or bigram is asked for once per chunk, however
often it occurs, so no slot depends on a frequent one; the vocabulary stays
dealt out, and the number of slots follows the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, give_back, mix64, slices, stored
from .hashing import words

MIN_COUNT = 2
ALPHA = 0.5
BETA = 5.0
SLOT_WORDS = 2_000_000
WORDS_A_SLOT = 4  # slots of bigrams for one of words: a chunk has fewer distinct words
CHUNK_BYTES = 4 << 20
BROADCAST_IDS = 4_000_000
START, UNKNOWN = 0, 1
COUNTS = ("b", "t", "end_b", "end_t")
ROWS = "chunk long, slot int, keys binary, counts binary, docs binary, codes binary"
TEXTS, WORDS = -1, -2  # a chunk's own rows, which no slot gets


class Model:
    """The totals of both models; the words' counts are given to it."""

    def __init__(self, size: int, known: dict[str, int], totals: dict[str, int]):
        self.n_t, n_b = totals["t"], totals["b"]
        self.scale = self.n_t / n_b if n_b else 0.0
        self.base = self.n_t + ALPHA * (size + 1)
        # counts of <s>, which only begins texts, and of the unknown word
        starts = [0, 0, -totals["end_b"], -totals["end_t"]]
        self.first = np.array([starts, [totals[c] - known[c] for c in COUNTS]], np.int64)

    def values(self, words: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Target loss less background loss of the bigrams of the words at v
        and w with the counts n (all, target); a word's counts are in the
        order of ``COUNTS``."""
        hist = words[v, :2] - words[v, 2:]
        p_t = (n[:, 1] + BETA * (words[w, 1] + ALPHA) / self.base) / (hist[:, 1] + BETA)
        p_b = (self.scale * n[:, 0] + BETA * (self.scale * words[w, 0] + ALPHA) / self.base) / (
            self.scale * hist[:, 0] + BETA)
        return np.log(p_b) - np.log(p_t)


def _tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, row, whether the row is a target) of each word."""
    h, at = words(*bytes_of(b.column("text")))
    return h, at, np.asarray(b.column("target")).astype(bool)[at] if len(at) else np.zeros(0, bool)


def _word_rows(w: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    # equal counts side by side: the shuffle's compression finds them in the row before
    order = np.lexsort(counts.T)
    w, counts = w[order], counts[order]
    return pa.RecordBatch.from_pydict({"w": pa.array(w.view(np.int64))} | {
        c: pa.array(counts[:, k]) for k, c in enumerate(COUNTS)})


def _add_up(w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(w, kind="stable")
    w, counts = w[order], counts[order]
    first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
    return w[first], np.add.reduceat(counts, first, axis=0) if len(w) else counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in slices(batches, "text", CHUNK_BYTES):
        h, at, target = _tokens(b)
        if not len(h):
            continue
        end = np.r_[at[1:] != at[:-1], True]
        uniq, place = np.unique(h, return_inverse=True)
        counts = np.stack([np.bincount(place[m], minlength=len(uniq)) for m in
                           (slice(None), target, end, end & target)], axis=1)
        held.append((uniq, counts))
        size += len(uniq)
        if size > 1_000_000:
            held = [_add_up(*(np.concatenate(c) for c in zip(*held)))]
            size = len(held[0][0])
            if size > 500_000:
                yield _word_rows(*held[0])
                held, size = [], 0
    if held:
        yield _word_rows(*_add_up(*(np.concatenate(c) for c in zip(*held))))


def _planes(values: np.ndarray) -> bytes:
    """Integers (one column or several) as byte planes, compressed."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return planes.nbytes.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unplaned(data: list[bytes], columns: int = 1, kind: str = "<i8") -> np.ndarray:
    """The values of several pieces, one after the other."""
    width = np.dtype(kind).itemsize * columns
    got = [np.frombuffer(pa.decompress(d[8:], int.from_bytes(d[:8], "little"), "zstd"), np.uint8) for d in data if len(d)]
    return np.concatenate([np.zeros((0, columns), kind)] + [
        np.ascontiguousarray(g.reshape(width, -1).T).view(kind) for g in got])


def _steps(values: np.ndarray) -> np.ndarray:
    """The first value and the differences that follow, modulo the width."""
    return np.concatenate([values[:1], values[1:] - values[:-1]])


def _slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """A range of the hashes is a slot: what a chunk asks of one lies close
    together, so that its steps are short however many slots there are."""
    return (((keys & np.uint64(0x7FFFFFFFFFFFFFFF)) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(31)).astype(np.int64)


def _asked(chunk: int, slot: np.ndarray, keys: np.ndarray, counts: np.ndarray | None) -> list[tuple]:
    """What a chunk asks of each slot; its keys are ordered by slot.  Words
    (without counts) are told by their steps."""
    cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    told = _steps if counts is None else np.asarray
    return [(chunk, int(slot[lo]), _planes(told(keys[lo:hi]).view(np.int64)),
             b"" if counts is None else _planes(counts[lo:hi]), b"", b"") for lo, hi in zip(cut, np.r_[cut[1:], len(slot)])]


def _chunks(slots: int):
    """Each chunk's words, as what it asks of the slots, and (``TEXTS``) its
    documents with the place of each of their words among those: numbers by
    frequency, and (``keys``) the steps between the places they stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        for b in slices(batches, "text", CHUNK_BYTES, 1 << 20):
            h, at, _ = _tokens(b)
            uniq, code = np.unique(h, return_inverse=True)
            slot = _slot_of(uniq, slots)
            order = np.argsort(slot, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order), dtype="<u4")
            ids = b.column("doc_id")
            docs = np.stack([np.asarray(ids.fill_null(0)).astype("<i8"), np.asarray(ids.is_null()).astype("<i8"),
                             np.asarray(b.column("target")).astype("<i8"),
                             np.bincount(at, minlength=b.num_rows).astype("<i8")], axis=1)
            often = np.lexsort((place, -np.bincount(code, minlength=len(uniq))))
            number = np.empty(len(order), "<u4")
            number[often] = np.arange(len(order), dtype="<u4")
            rows = [(base + seq, TEXTS, _planes(_steps(place[often])), b"", _planes(docs), _planes(number[code]))]
            rows += _asked(base + seq, slot[order], uniq[order], None)
            seq += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[2:]],
                ["chunk", "slot", "keys", "counts", "docs", "codes"])
    return run


def _word_slot(slots: int):
    """One slot: name and counts of each chunk's words; the name of a word
    that is not in the vocabulary is ``UNKNOWN``."""
    def run(asked: pd.DataFrame, vocab: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return asked
        keys = vocab["w"].to_numpy(np.int64)
        order = np.argsort(keys, kind="stable")
        keys = np.append(keys[order], 0)
        own = np.zeros((len(keys), 5), np.int64)
        own[:-1, 0] = np.arange(len(vocab)) * slots + int(asked["slot"].iloc[0]) + 2
        own[:-1, 1:] = vocab[list(COUNTS)].to_numpy(np.int64)[order]
        own[-1, 0] = UNKNOWN
        last = len(vocab)
        got = []
        for k in asked["keys"]:
            want = np.cumsum(_unplaned([k])[:, 0])
            at = np.searchsorted(keys[:last], want)
            got.append(_planes(own[np.where(keys[at] == want, at, last)]))
        return asked.assign(keys=b"", counts=got)
    return run


def _laid_out(docs: np.ndarray, codes: np.ndarray, names: np.ndarray):
    """A chunk's distinct bigrams, sorted, as the two words' names in one
    number, and each token's document and bigram."""
    ids = names[codes]
    at = np.repeat(np.arange(len(docs)), docs[:, 3])
    before = np.r_[START, ids[:-1]][:len(ids)]
    before[np.r_[True, at[1:] != at[:-1]][:len(ids)]] = START
    pair, token = np.unique(before << 32 | ids, return_inverse=True)
    return pair, at, token


def _by_slot(pair: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, place) of the bigrams in the slots' order."""
    slot = _slot_of(mix64(pair.view(np.uint64)), slots)
    order = np.argsort(slot, kind="stable")
    return slot[order], order


def _texts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    own = pdf[pdf["slot"] == TEXTS].iloc[0]
    places = np.cumsum(_unplaned([own["keys"]], kind="<u4")[:, 0], dtype="<u4")
    return _unplaned([own["docs"]], 4), places[_unplaned([own["codes"]], kind="<u4")[:, 0]]


def _bigrams(slots: int):
    """One chunk: what it asks of the slots of its bigrams, and (``WORDS``)
    its words' names and counts."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs, codes = _texts(pdf)
        words_ = _unplaned(list(pdf[pdf["slot"] >= 0].sort_values("slot")["counts"]), 5)
        pair, at, token = _laid_out(docs, codes, words_[:, 0])
        n = np.stack([np.bincount(token, minlength=len(pair)),
                      np.bincount(token[docs[at, 2] > 0], minlength=len(pair))], axis=1)
        slot, order = _by_slot(pair, slots)
        chunk = pdf["chunk"].iloc[0]
        rows = [(chunk, WORDS, b"", _planes(words_), b"", b"")] + _asked(chunk, slot, pair[order], n[order])
        give_back()
        return pd.DataFrame(rows, columns=["chunk", "slot", "keys", "counts", "docs", "codes"])
    return run


def _bigram_slot(pdf: pd.DataFrame) -> pd.DataFrame:
    """One slot: the counts of each chunk's bigrams over all chunks."""
    keys = [_unplaned([k])[:, 0] for k in pdf["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    total = np.add.reduceat(_unplaned(list(pdf["counts"]), 2)[order], first, axis=0)
    out = np.empty((len(key), 2), np.int64)
    out[order] = np.repeat(total, np.diff(np.r_[first, len(key)]), axis=0)
    got = [_planes(out[lo:hi]) for lo, hi in zip(np.r_[0, ends[:-1]], ends)]
    give_back()
    return pdf.assign(keys=b"", counts=got)


def _finish(shared, slots: int):
    """One chunk: its documents' scores."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = shared.value
        docs, codes = _texts(pdf)
        words_ = _unplaned(list(pdf.loc[pdf["slot"] == WORDS, "counts"]), 5)
        pair, at, token = _laid_out(docs, codes, words_[:, 0])
        counts = np.empty((len(pair), 2), np.int64)
        counts[_by_slot(pair, slots)[1]] = _unplaned(list(pdf[pdf["slot"] >= 0].sort_values("slot")["counts"]), 2)
        # the words' counts by the order of their names
        names, first = np.unique(np.r_[START, UNKNOWN, words_[:, 0]], return_index=True)
        own = np.append(model.first, words_[:, 1:], axis=0)[first]
        value = model.values(own, np.searchsorted(names, pair >> 32), np.searchsorted(names, pair & 0xFFFFFFFF), counts)
        n = docs[:, 3]
        total = np.bincount(at, value[token], len(docs))
        ids = pd.arrays.IntegerArray(docs[:, 0].copy(), docs[:, 1] > 0)
        give_back()
        return pd.DataFrame({"doc_id": ids, "n_tokens": n,
                             "ce_difference": np.round(np.where(n > 0, total / np.maximum(n, 1), 0.0), 6)})
    return run


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ce_difference) of every row of ``docs``.

    ``target_ids`` (doc_id) names the target documents; it is broadcast while
    it has at most ``BROADCAST_IDS`` rows and joined by shuffle beyond.
    """
    spark = docs.sparkSession
    ids = target_ids.select(F.col("doc_id").cast("long").alias("_t")).where("_t is not null").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.join(ids, d.doc_id == F.col("_t"), "left").select(
        "doc_id", "text", F.col("_t").isNotNull().alias("target"))
    texts = d.select("text", "target")
    counts = texts.mapInArrow(_count_words, "w long, b long, t long, end_b long, end_t long").groupBy("w").agg(
        *[F.sum(c).alias(c) for c in ("b", "t", "end_b", "end_t")])
    counts = stored(counts, "lm-words")
    add = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    totals = counts.agg(*add).first().asDict()
    slots = max(1, -(-int(totals["b"]) // SLOT_WORDS))
    word_slots = -(-slots // WORDS_A_SLOT)
    vocab = counts.where(F.col("t") >= MIN_COUNT)
    known = vocab.agg(F.count(F.lit(1)).alias("size"), *add).first().asDict()
    if known["size"] >= 1 << 30:  # a bigram's number holds two names
        raise ValueError("vocabularies beyond 2^30 words need wider names")
    shared = spark.sparkContext.broadcast(Model(known["size"], known, totals))
    # the same slot as _slot_of gives the word
    vocab = vocab.withColumn("slot", F.expr(f"CAST(shiftright(shiftright(w & 9223372036854775807, 32) * {word_slots}L, 31) AS INT)"))
    chunks = stored(d.mapInArrow(_chunks(word_slots), ROWS), "lm-chunks")
    own, asked = chunks.where("slot < 0"), chunks.where("slot >= 0")
    answers = asked.groupBy("slot").cogroup(vocab.groupBy("slot")).applyInPandas(_word_slot(word_slots), ROWS)
    bigrams = stored(own.unionAll(answers).groupBy("chunk").applyInPandas(_bigrams(slots), ROWS), "lm-bigrams")
    answers = bigrams.where("slot >= 0").groupBy("slot").applyInPandas(_bigram_slot, ROWS)
    return own.unionAll(bigrams.where("slot < 0")).unionAll(answers).groupBy("chunk").applyInPandas(
        _finish(shared, slots), "doc_id long, n_tokens long, ce_difference double")


def good_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return labels.where("quality = 1 and toxic = 0").select("doc_id")
