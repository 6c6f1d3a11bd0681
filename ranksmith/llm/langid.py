"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 / -1 entries drawn from its code point.
An n-gram's vector binds (multiplies) its letters' vectors, each rotated by
its place; a text bundles (adds) the vectors of all its n-grams; a language
prototype bundles those of all its training documents.  A document gets the
language whose prototype has the largest cosine with its vector.

A filter (``keep_identified``) trusts the best cosine only where it is not far
below what learned documents of its size reach: documents are classed by the
weight of their vector (about the sum of squared gram counts), and a class's
threshold is ``SHARE`` of the ``QUANTILE`` of its learned documents' cosines.
A class of few learned documents takes the lowest threshold of the full ones
if its own is higher; a size that was never learned takes the lowest of all.
Fewer learned documents than a class needs reject nothing.

Letters are lower-cased; every other run of characters counts as one word
boundary.  Null texts and texts without a letter give ``und`` with score 0,
and so does every text when nothing can be learned (no labelled rows).  Ties
go to the smaller language name.  Rows with null lang teach nothing.  Repeated
rows are scored alike.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, sole_memo

DIM = 512
MAX_LANGUAGES = 4096
UND = "und"
QUANTILE = 0.001
SHARE = 0.5
CLASS_ROWS = 200  # learned documents that give a class a threshold of its own
SLICE_BYTES = 1 << 19  # of text worked on at a time: about 130 bytes of arrays for each


@lru_cache(maxsize=1 << 16)
def letter_vector(code: int, dim: int) -> np.ndarray:
    """The random +1 / -1 vector of a code point (0: word boundary)."""
    bits = np.random.default_rng([code, 20_011]).integers(0, 2, dim, dtype=np.int8)
    return (2 * bits - 1).astype(np.int8)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str | None], groups: np.ndarray | None = None
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, gram, count, letters) of the letter trigrams of the texts.

    The group is the text's place unless ``groups`` names another one; rows
    are sorted by group and gram.  ``letters`` holds the code points that
    occur (0: a run of other characters, or either end), and a gram is the
    number (a * n + b) * n + c of its letters' places there.
    """
    low = [(t or "").lower() + "\x00" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    lens = np.fromiter(map(len, low), np.int64, len(low))
    rows = np.repeat(np.arange(len(low)), lens)
    codes = np.where(_is_letter()[codes], codes, 0)
    first = np.r_[True, rows[1:] != rows[:-1]]
    keep = first | (codes != 0) | np.r_[True, codes[:-1] != 0]
    codes, rows, first = codes[keep], rows[keep], first[keep]
    starts = np.flatnonzero(first)
    codes, rows = np.insert(codes, starts, 0), np.insert(rows, starts, rows[starts])
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    n = len(letters)
    place = np.cumsum(seen) - 1
    p = place[codes]
    ok = (rows[2:] == rows[:-2]) & (codes[1:-1] != 0)
    tri = ((p[:-2] * n + p[1:-1]) * n + p[2:])[ok]
    at = rows[:-2][ok]
    if groups is not None:
        at = groups[at]
    keys, counts = np.unique(at * n ** 3 + tri, return_counts=True)
    return keys // n ** 3, keys % n ** 3, counts, letters


def gram_vectors(gram: np.ndarray, letters: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors (len(gram) x dim, int8)."""
    n = len(letters)
    table = np.stack([letter_vector(int(c), dim) for c in letters])
    out = np.roll(table, 2, axis=1)[gram // (n * n)]
    out *= np.roll(table, 1, axis=1)[gram // n % n]
    out *= table[gram % n]
    return out


def bundle(texts: list[str | None], dim: int, groups: np.ndarray | None = None,
           n_groups: int | None = None) -> np.ndarray:
    """Bundled vectors (float64 holding integers) of texts, or of groups of them."""
    size = len(texts) if groups is None else n_groups
    out = np.zeros((size, dim))
    at, gram, cnt, letters = grams(texts, groups)
    uniq, col = np.unique(gram, return_inverse=True)
    by_col = np.argsort(col, kind="stable")
    for lo in range(0, len(uniq), 4096):  # working memory: 4096 x (groups + dim)
        own = by_col[np.searchsorted(col, lo, sorter=by_col):np.searchsorted(col, lo + 4096, sorter=by_col)]
        vec = gram_vectors(uniq[lo:lo + 4096], letters, dim).astype(np.float32)
        dense = np.zeros((size, len(vec)), np.float32)
        dense[at[own], col[own] - lo] = cnt[own]
        out += dense @ vec
    return out


def _partial(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo()
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, "text", max_bytes=SLICE_BYTES):
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            names, which = np.unique(langs, return_inverse=True)
            vec = bundle(b.column("text").to_pylist(), dim, which, len(names)).round().astype(np.int64)
            for name, v in zip(names, vec):
                sums[name] = sums[name] + v if name in sums else v
            if len(sums) > 256:
                yield from _rows(sums, dim)
                sums = {}
        yield from _rows(sums, dim)
    return run


def _rows(sums: dict[str, np.ndarray], dim: int) -> Iterator[pa.RecordBatch]:
    for name, v in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * dim, pa.string()),
                                          "dim": pa.array(np.arange(dim, dtype=np.int32)),
                                          "total": pa.array(v)})


def learn(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Prototypes (languages, unit vectors) of all rows of ``docs`` (text, lang).

    Each partition adds up its documents; the partial sums meet in a
    ``groupBy(lang, dim)``.  ``MAX_LANGUAGES`` x ``dim`` numbers reach the
    driver at most; more labels than that are refused.
    """
    parts = (docs.select("text", F.col("lang").cast("string").alias("lang"))
             .where(F.col("text").isNotNull() & F.col("lang").isNotNull())
             .mapInArrow(_partial(dim), "lang string, dim int, total long")
             .groupBy("lang", "dim").agg(F.sum("total").alias("total")))
    rows = parts.limit(MAX_LANGUAGES * dim + 1).toPandas()
    if len(rows) > MAX_LANGUAGES * dim:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(rows["lang"].unique())
    proto = np.zeros((len(names), dim))
    proto[rows["lang"].map({n: i for i, n in enumerate(names)}), rows["dim"]] = rows["total"]
    norm = np.linalg.norm(proto, axis=1)
    keep = norm > 0
    return [n for n, k in zip(names, keep) if k], (proto[keep] / norm[keep][:, None])


def predict_batch(texts: list[str | None], names: list[str], proto: np.ndarray) -> tuple[list[str], np.ndarray]:
    return classed_batch(texts, names, proto)[:2]


def classed_batch(texts: list[str | None], names: list[str], proto: np.ndarray
                  ) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, and the class of each text's weight."""
    if not names:
        return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    vec = bundle(texts, proto.shape[1])
    any_letter = np.array([any(map(str.isalpha, t or "")) for t in texts])
    norm = np.linalg.norm(vec, axis=1)
    cos = np.round((vec @ proto.T) / np.where(norm > 0, norm, 1)[:, None], 9)
    best = cos.argmax(axis=1)
    score = np.clip(cos[np.arange(len(texts)), best], 0, 1)
    weight = np.floor(np.log2(np.maximum(norm ** 2 / proto.shape[1], 1))).astype(np.int64)
    return [names[b] if a else UND for b, a in zip(best, any_letter)], np.where(any_letter, score, 0.0), weight


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score."""
    names, proto = model
    shared = docs.sparkSession.sparkContext.broadcast((names, proto))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo()
        names, proto = shared.value
        for b in slices(batches, "text", max_bytes=SLICE_BYTES, max_rows=1024):
            lang, score = predict_batch(b.column("text").to_pylist(), names, proto)
            cols = {c: b.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(cols | {"lang_pred": pa.array(lang, pa.string()),
                                                     "score": pa.array(score)})

    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{c}` {t}" for c, t in frame.select(*keep).dtypes)
    return frame.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict for all."""
    d = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"),
                    F.col("lang").cast("string").alias("lang"))
    model = learn(d.where(~held_out(F.col("doc_id"))))
    flagged = d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(flagged, model, "doc_id", "held_out")


def thresholds(learned: DataFrame, model: tuple[list[str], np.ndarray]) -> tuple[dict[int, float], float]:
    """(threshold by class, threshold of all other classes) from the scores of
    all learned documents."""
    shared = learned.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo()
        for b in slices(batches, "text", max_bytes=SLICE_BYTES, max_rows=1024):
            lang, score, weight = classed_batch(b.column("text").to_pylist(), *shared.value)
            told = np.array([x != UND for x in lang], bool)
            yield pa.RecordBatch.from_pydict({"class": pa.array(weight[told]), "score": pa.array(score[told])})

    rows = learned.select("text").mapInArrow(run, "class long, score double").groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("score", QUANTILE, 100_000).alias("low")).collect()
    if sum(r["n"] for r in rows) < CLASS_ROWS:
        return {}, 0.0
    low = {r["class"]: SHARE * r["low"] for r in rows}
    full = min((low[r["class"]] for r in rows if r["n"] >= CLASS_ROWS), default=1.0)
    return {r["class"]: low[r["class"]] if r["n"] >= CLASS_ROWS else min(low[r["class"]], full) for r in rows}, min(
        low.values(), default=0.0)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) whose language could be told: documents
    with null text or without a letter go, and those that resemble no learned
    language as much as learned documents of their size do."""
    learned = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    model = learn(learned)
    shared = docs.sparkSession.sparkContext.broadcast((model, *thresholds(learned, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo()
        model, own, least = shared.value
        for b in slices(batches, "text", max_bytes=SLICE_BYTES, max_rows=1024):
            lang, score, weight = classed_batch(b.column("text").to_pylist(), *model)
            yield b.filter(pa.array([x != UND and s >= own.get(w, least)
                                     for x, s, w in zip(lang, score.tolist(), weight.tolist())]))

    return docs.mapInArrow(run, docs.schema)
