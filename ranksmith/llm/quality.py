"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line is described by its own
characters and words (shares of capitals, symbols, exclamation marks, digits
and bars; repeated words; whether the line is repeated in its document; its
length and ending) and by the same of the lines before and after it.  The
field has a weight per feature and one per pair of neighbouring labels.
Forward-backward gives each line's marginal probability of being good, and the
mean of the marginals, weighted by the lines' lengths, is the document's score.

Training: at most ``TRAIN_DOCS`` labelled documents (those with the smallest
hashes of their ids) teach; all lines of a document carry its label.  The
log-likelihood with an L2 penalty is climbed by full-batch steps from zero
weights, so reruns agree.  With no labelled documents every score is 0.5.

Null texts count as empty, and an empty text is one empty line.  Documents
labelled twice teach once for each distinct label; null labels and ids teach
nothing.  Repeated rows are scored alike.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, held_out, mix64, slices
from .hashing import prefix_sums, words

TRAIN_DOCS = 4_000
STEPS = 400
PENALTY = 1e-4
THRESHOLD = 0.3
OWN = ("upper", "symbol", "exclaim", "digit", "bar", "repeat", "echo", "again", "short", "stop", "empty")
NEAR = OWN[:8]
N_FEATURES = 1 + len(OWN) + 2 * (len(NEAR) + 1)

_CLASS = np.zeros(256, np.uint8)  # 1 lower case, 2 upper case, 3 digit, 4 symbol, 5 exclamation mark, 6 bar
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[list(b"*#$%&@^~<>{}[]\\/=+_")] = 4
_CLASS[ord("!")], _CLASS[ord("|")] = 5, 6
_CLASS[128:] = 1
_STOPS = np.isin(np.arange(256), list(b".!?:;\"')"))


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, text, length) of every line of the texts."""
    data, off = bytes_of(texts)
    n_docs = len(off) - 1
    feeds = np.flatnonzero(data == 10)
    # a line begins where a text begins and after each line feed
    begin = np.concatenate([off[:-1], feeds + 1])
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(off, feeds, side="right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    last = np.r_[doc[1:] != doc[:-1], True]
    end = np.where(last, off[doc + 1], np.r_[begin[1:] - 1, 0])
    length = end - begin
    n = len(begin)
    kind = _CLASS[data]

    def share(k):
        run = np.r_[0, np.cumsum(kind == k)]
        return (run[end] - run[begin]) / np.maximum(length, 1)

    lower, upper, digit, symbol, exclaim, bar = (share(k) for k in range(1, 7))
    h, at = words(data, off)
    feats = np.zeros((n, len(OWN)))
    if len(h):
        # the line of each word, from the word's number in its text
        inside = (data != 32) & ((data < 9) | (data > 13))
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        first = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | cut[:len(data)]))
        # empty texts share their begin with the next text, whose line counts
        line = np.searchsorted(begin, first, side="right") - 1
        total = np.bincount(line, minlength=n)
        pair = np.unique(mix64(h + mix64(line.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
        distinct = np.bincount(line[pair], minlength=n)
        next_same = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        echo = np.bincount(line[1:][next_same], minlength=n)
        feats[:, 5] = np.where(total > 0, 1 - distinct / np.maximum(total, 1), 0)
        feats[:, 6] = echo / np.maximum(total, 1)
    sums, down = prefix_sums(data)
    same = mix64((sums[end] - sums[begin]) * down[begin] + mix64(doc.astype(np.uint64) + np.uint64(1)))
    _, where, times = np.unique(same, return_inverse=True, return_counts=True)
    letters = lower + upper
    feats[:, 0] = upper / np.maximum(letters, 1e-9) * (letters > 0)
    feats[:, 1] = np.minimum(1, 4 * symbol)
    feats[:, 2] = np.minimum(1, 6 * exclaim)
    feats[:, 3] = np.minimum(1, 2 * digit)
    feats[:, 4] = np.minimum(1, 6 * bar)
    feats[:, 7] = (times[where] > 1) & (length > 0)
    feats[:, 8] = (length > 0) & (length < 20)
    feats[:, 9] = _STOPS[data[np.maximum(end - 1, 0)]] & (length > 0) if len(data) else 0
    feats[:, 10] = length == 0
    near = feats[:, :len(NEAR)]
    edge = np.r_[True, doc[1:] != doc[:-1]]
    before = np.where(edge[:, None], 0, np.roll(near, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(near, -1, axis=0))
    return np.hstack([np.ones((n, 1)), feats, before, edge[:, None], after, last[:, None]]), doc, length


class Chains:
    """Lines of many documents, walked together one line at a time."""

    def __init__(self, doc: np.ndarray):
        self.first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        self.size = np.diff(np.r_[self.first, len(doc)])
        self.order = np.argsort(-self.size, kind="stable")
        sizes = self.size[self.order]
        heads = self.first[self.order]
        # at step t the documents with more than t lines are in front
        self.steps = [heads[:k] + t for t, k in enumerate(
            np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right"))]

    def marginals(self, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good), forward and backward log-odds) of each line, from the
        lines' log-odds ``e`` and the pair weights ``t`` (before x after)."""
        a, b = np.empty(len(e)), np.zeros(len(e))
        for k, at in enumerate(self.steps):
            if not k:
                a[at] = e[at]
                continue
            p = a[at - 1]
            a[at] = e[at] + np.logaddexp(t[1, 1] + p, t[0, 1]) - np.logaddexp(t[1, 0] + p, t[0, 0])
        for at in self.steps[:0:-1]:
            x = e[at] + b[at]
            b[at - 1] = np.logaddexp(t[1, 0], t[1, 1] + x) - np.logaddexp(t[0, 0], t[0, 1] + x)
        return 1 / (1 + np.exp(-np.clip(a + b, -500, 500))), a, b


def fit(feats: np.ndarray, doc: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, pair weights) of lines with a label each."""
    chains, n_docs = Chains(doc), len(np.unique(doc))
    w, t = np.zeros(feats.shape[1]), np.zeros((2, 2))
    m = np.zeros(len(w) + 4)
    v = np.zeros(len(w) + 4)
    inner = np.flatnonzero(np.r_[False, doc[1:] == doc[:-1]])  # lines with one before
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    for step in range(1, STEPS + 1):
        e = feats @ w
        p, a, b = chains.marginals(e, t)
        grad_w = feats.T @ (label - p) / n_docs - PENALTY * w
        x, y = a[inner - 1], e[inner] + b[inner]
        z = np.stack([np.full(len(x), t[0, 0]), t[0, 1] + y, t[1, 0] + x, t[1, 1] + x + y])
        z = np.exp(z - z.max(axis=0))
        expected = (z / z.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad_t = (seen - expected) / n_docs - PENALTY * t
        g = np.r_[grad_w, grad_t.ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, t = w + move[:-4], t + move[-4:].reshape(2, 2)
    return w, t


def text_scores(texts: pa.Array, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The score of each text."""
    if model is None:
        return np.full(len(texts), 0.5)
    feats, doc, length = line_features(texts)
    p, _, _ = Chains(doc).marginals(feats @ model[0], model[1])
    weight = length + 1.0
    return np.bincount(doc, p * weight, len(texts)) / np.bincount(doc, weight, len(texts))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on a sample of ``docs`` (doc_id, text) with ``labels`` (doc_id,
    quality); the sample's line features reach the driver."""
    picked = (labels.where("quality in (0, 1) and doc_id is not null")
              .select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
              .distinct().orderBy(F.xxhash64("_id"), "_id", "quality").limit(TRAIN_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            feats, doc, _ = line_features(b.column("text"))
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
            rows = [feats[i:j].astype("<f4").tobytes() for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "quality": b.column("quality"),
                                              "lines": pa.array(rows, pa.binary())})

    rows = (docs.join(F.broadcast(picked), docs.doc_id == picked["_id"]).select("doc_id", "text", "quality")
            .mapInArrow(run, "doc_id long, quality int, lines binary").collect())
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["lines"])))
    parts = [np.frombuffer(r["lines"], "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows]
    sizes = [len(x) for x in parts]
    return fit(np.concatenate(parts), np.repeat(np.arange(len(rows)), sizes),
               np.repeat([r["quality"] for r in rows], sizes))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; only
    labels of documents that are not held out teach."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(d, labels.where(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            s = np.round(text_scores(b.column("text"), shared.value), 6)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"),
                                              "score": pa.array(s), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))})

    flagged = d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return flagged.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
