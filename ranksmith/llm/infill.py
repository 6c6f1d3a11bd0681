"""Fill-in-middle transformation with a piecewise-linear learned rank index.

A text is cut into units (white space with the word after it, or white space
at the end).  Its unit boundaries, ``n + 1`` byte offsets, are indexed by rank:

1. Error-bounded segments are fitted to *all* boundary offsets of a text: a
   segment starts at a boundary and grows while some slope through that start
   keeps every boundary within ``ERROR`` bytes of the line (the cone of allowed
   slopes narrows with each boundary).
2. A boundary's offset is predicted as ``base + round(slope * (rank - first))``
   by the segment its rank falls into; what the prediction misses is stored as
   one signed byte per boundary, the residual.
3. A cut after ``k`` units is predicted from rank ``k`` and corrected by its
   residual, which gives the exact byte offset.

``transform`` cuts each text at two seeded ranks into prefix, middle and suffix
and writes it plain, as psm or as spm; ``restored`` rebuilds the text from the
output and its form alone.  ``rank_index`` returns the index itself.

Null and empty texts have no units and stay plain; texts that hold a marker
stay plain; a null ``doc_id`` is seeded like an empty one.  Repeated rows give
equal rows; an empty table gives no rows; extra columns are ignored.  Texts of
any length are cut whole: a task holds one slice of texts (one at least).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, bytes_of, slices

ERROR = 126  # residuals, with the rounding, fit one signed byte
WINDOW = 512
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def boundaries(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, first): byte offsets of all unit boundaries of the texts in
    a buffer, each text's begin included; text i has those from ``first[i]`` to
    ``first[i + 1]`` (not included)."""
    n = len(data)
    if not n:
        return off[:-1].astype(np.int64), np.arange(len(off), dtype=np.int64)
    last = np.zeros(n + 1, bool)  # a text ends here
    last[off[1:]] = True
    inside = ~_IS_SPACE[data]
    ends = np.flatnonzero((inside & np.r_[~inside[1:], True]) | last[1:]) + 1
    # a text's begin stands before the ends that follow it
    owner = np.searchsorted(off, ends - 1, side="right") - 1
    counts = np.bincount(owner, minlength=len(off) - 1) + 1
    first = np.r_[0, np.cumsum(counts)]
    out = np.empty(first[-1], np.int64)
    at_begin = np.zeros(first[-1], bool)
    at_begin[first[:-1]] = True
    out[at_begin], out[~at_begin] = off[:-1], ends
    return out, first


def segments(y: np.ndarray, error: int = ERROR) -> list[tuple[int, int, float]]:
    """(first rank, offset there, slope) of segments that miss no offset of
    ``y`` by more than ``error``."""
    out, i, n = [], 0, len(y)
    while i < n:
        lo, hi, j, window, end = -np.inf, np.inf, i + 1, WINDOW, n
        while j < n:
            part = y[j:j + window] - y[i]
            d = np.arange(j - i, j - i + len(part))
            low = np.maximum(np.maximum.accumulate((part - error) / d), lo)
            high = np.minimum(np.minimum.accumulate((part + error) / d), hi)
            out_of_cone = low > high
            stop = int(out_of_cone.argmax()) if out_of_cone.any() else len(part)
            if stop:
                lo, hi = low[stop - 1], high[stop - 1]
            j += stop
            if stop < len(part):
                end = j
                break
            window *= 2
        out.append((i, int(y[i]), float((lo + hi) / 2) if end > i + 1 else 0.0))
        i = end
    return out


class RankIndex:
    """Segments and residuals of the boundaries of many texts, by global rank
    (a text's first rank plus the rank in it)."""

    def __init__(self, y: np.ndarray, first: np.ndarray, error: int = ERROR):
        parts, self.per_text = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = segments(y[a:b], error)
            self.per_text.append(len(own))
            parts += [(a + r, base, slope) for r, base, slope in own]
        rank, base, slope = zip(*parts) if parts else ((), (), ())
        self.rank, self.base = np.array(rank, np.int64), np.array(base, np.int64)
        self.slope = np.array(slope, np.float64)
        wide = np.int8 if error <= ERROR else np.int64
        self.residual = (y - self.predict(np.arange(len(y)))).astype(wide)

    def predict(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.rank, rank, side="right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.rank[s])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets: the prediction and its residual."""
        return self.predict(rank) + self.residual[rank]


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four seeded numbers of a document."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = hashlib.sha256(text.encode()).hexdigest()
    return tuple(int(h[k:k + 8], 16) for k in (0, 8, 16, 24))


def _cut(seed: int, error: int, fim_percent: int, spm_percent: int):
    p_mark, s_mark, m_mark = (MARKS[k].encode() for k in ("prefix", "suffix", "middle"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            data, off = bytes_of(b.column("text"))
            y, first = boundaries(data, off)
            index = RankIndex(y, first, error)
            n = np.diff(first) - 1
            drawn = np.array([draws(i, seed) for i in b.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
            one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
            a = index.offset(first[:-1] + np.minimum(one, two))
            z = index.offset(first[:-1] + np.maximum(one, two))
            raw = data.tobytes()
            form, out, sizes = [], [], []
            for i, (lo, c1, c2, hi) in enumerate(zip(off[:-1].tolist(), a.tolist(), z.tolist(), off[1:].tolist())):
                text = raw[lo:hi]
                if not text or drawn[i, 2] % 100 >= fim_percent or any(m in text for m in (p_mark, s_mark, m_mark)):
                    form.append("plain")
                    out.append(text)
                    sizes.append((None, None))
                    continue
                prefix, middle, suffix = raw[lo:c1], raw[c1:c2], raw[c2:hi]
                if drawn[i, 3] % 100 < spm_percent:
                    form.append("spm")
                    out.append(b"".join((s_mark, suffix, p_mark, prefix, m_mark, middle)))
                else:
                    form.append("psm")
                    out.append(b"".join((p_mark, prefix, s_mark, suffix, m_mark, middle)))
                sizes.append((_points(data[lo:c1]), _points(data[c1:c2])))
            chars = list(zip(*sizes))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(chars[0], pa.int64()),
                 pa.array(chars[1], pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def transform(docs: DataFrame, seed: int = SEED, error: int = ERROR, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row."""
    return _columns(docs).mapInArrow(
        _cut(seed, error, fim_percent, spm_percent),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of."""
    piece = F.split(output, "|".join(MARKS.values()), -1)
    return (F.when(form == "psm", F.concat(piece[1], piece[3], piece[2]))
            .when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(output))


def _indexed(error: int):
    kind = pa.list_(pa.struct([("rank", pa.int64()), ("base", pa.int64()), ("slope", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            data, off = bytes_of(b.column("text"))
            y, first = boundaries(data, off)
            index = RankIndex(y, first, error)
            at = np.r_[0, np.cumsum(index.per_text)].tolist()
            parts, rests = [], []
            for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                s = slice(at[i], at[i + 1])
                parts.append([{"rank": r - lo, "base": base - int(off[i]), "slope": slope} for r, base, slope in
                              zip(index.rank[s].tolist(), index.base[s].tolist(), index.slope[s].tolist())])
                rests.append(index.residual[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(first) - 1), pa.array(parts, kind), pa.array(rests, pa.binary())],
                ["doc_id", "n", "segments", "residuals"])
    return run


def rank_index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """doc_id, n, segments and residuals (a signed byte per boundary, eight
    beyond an error of 126) of every text: boundary ``k`` of a text lies at
    ``base + round(slope * (k - rank)) + residuals[k]``, by the last segment
    whose rank is not above ``k``."""
    return _columns(docs).mapInArrow(
        _indexed(error), "doc_id long, n long, segments array<struct<rank: long, base: long, slope: double>>, "
                         "residuals binary")


def digests(docs: DataFrame) -> DataFrame:
    """A digest row per document of the transformed and the rebuilt texts."""
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
