"""Inverted indexes over a corpus ``(item_id, text)``: BM25 and TF-IDF.

Layout choices for scale:

* Term frequencies are counted inside each document row
  (``with_term_freqs``) and then exploded, so postings are produced where
  the documents already sit: building them shuffles nothing.
* Corpus statistics (N, average length, mean idf) are lazy scalar
  subqueries, not joins or driver round trips.
* Items stay whole as *forward* rows (an item with its tokens); postings are
  exploded from them where they are needed.
* The only shuffles of the index build are the vocabulary count (the tasks
  that cut the texts count each batch, so hot tokens collapse at once) and, for
  the length of an item's TF-IDF vector, the occurrences of its rarer tokens.
  Weights (tf * idf / length) are not stored: whoever reads them has the idf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NON_WORD_RE, WS_CLASS, tok_word2, tok_ws
from .util import broadcast_if_small, scalar, stored, with_term_freqs

CHUNK_TOKENS = 500_000
PIECE_BYTES = 4 << 20  # of texts that are cut at a time
ODD_SPACE = WS_CLASS.replace(r"\x{9}-\x{d}\x{1c}-\x{20}", r"\x{1c}-\x{1f}")  # white space other than \t to \r and blank
HOT_TOKENS = 200_000   # frequent tokens whose idf is sent to every task
NORM_ROWS, NORM_BYTES = 4_000_000, 96 << 20  # of norms that are sent to every task


def default_stop_words() -> list[str]:
    """English stop list used by the TF-IDF tokenizer (Spark ML's default
    English list, shipped as a resource so the SQL oracle uses the same)."""
    txt = resources.files("ranksmith.resources").joinpath("stopwords_en.txt").read_text()
    return [w for w in txt.split("\n") if w]


def _postings(d: DataFrame, id_col: str = "item_id") -> DataFrame:
    keep = [c for c in d.columns if c in ("ordinal", "dl")]
    return (d.select(id_col, *keep, F.explode_outer("tfs").alias("p")).filter(F.col("p").isNotNull())
            .select(id_col, *keep, F.col("p.token").alias("token"), F.col("p.tf").alias("tf")))


@dataclass
class Bm25Index:
    postings: DataFrame        # item_id, ordinal, dl, token, tf
    vocab: DataFrame           # token, df, idf
    n_docs: Column
    avgdl: Column
    k1: float
    b: float
    forward: DataFrame         # item_id, ordinal, dl, ws = array of (token, tf)

    @classmethod
    def of(cls, forward: DataFrame, vocab: DataFrame, n_docs: Column, avgdl: Column, k1: float, b: float) -> "Bm25Index":
        """The index of stored forward rows."""
        return cls(_postings(forward.withColumnRenamed("ws", "tfs")), vocab, n_docs, avgdl, k1, b, forward)


def bm25_index(corpus: DataFrame, k1: float = 1.5, b: float = 0.75,
               epsilon: float = 0.25, rows: DataFrame | None = None) -> Bm25Index:
    """Okapi BM25 index on whitespace tokens (punctuation kept).

    idf = ln(N - df + 0.5) - ln(df + 0.5); a negative idf is replaced by
    ``epsilon`` times the mean idf of the whole vocabulary (the mean taken
    before the replacement).  ``rows``: stored ``token_rows``.
    """
    # the ordinal rides along in every posting, so scored pairs carry it
    # and never need a join back to the corpus for tie-breaking
    if rows is not None:
        d = rows.select("item_id", "ordinal", "dl", F.col("ws").alias("tfs"))
    else:
        d = corpus.select("item_id", "ordinal", tok_ws("text").alias("toks"))
        d = d.withColumn("dl", F.size("toks"))
        d = with_term_freqs(d, "toks", "tfs").drop("toks")
    postings = _postings(d)
    n_docs = scalar(corpus.agg(F.count(F.lit(1)).cast("double")))
    avgdl = scalar(d.agg(F.avg("dl")))
    vocab = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")) if rows is None else _dfs(rows, "ws_df")
    vocab = vocab.withColumn("idf_raw", F.ln(n_docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean_idf = scalar(vocab.agg(F.avg("idf_raw")))
    vocab = vocab.select("token", "df", F.when(F.col("idf_raw") < 0, F.lit(epsilon) * mean_idf)
                         .otherwise(F.col("idf_raw")).alias("idf"))
    return Bm25Index(postings, vocab, n_docs, avgdl, k1, b, d.withColumnRenamed("tfs", "ws"))


@dataclass
class TfidfIndex:
    rows: DataFrame            # token_rows
    vocab: DataFrame           # token, df, idf
    stop: DataFrame            # token

    @cached_property
    def forward(self) -> DataFrame:
        """item_id, ordinal, wd = array of (token, tf), norm: length of the
        vector of tf*idf.  Made when first read: the vocabulary needs no
        lengths."""
        norms = broadcast_if_small(_norms(self.rows, self.vocab), NORM_ROWS, NORM_BYTES)
        return self.rows.join(norms, "row", "left").select("item_id", "ordinal", F.col("tfs").alias("wd"), "norm", "row", "dl", "ws")

    @property
    def counts(self) -> DataFrame:
        """(item_id, ordinal, token, tf, norm)"""
        return (self.forward.select("item_id", "ordinal", "norm", F.explode_outer("wd").alias("p")).filter(F.col("p").isNotNull())
                .select("item_id", "ordinal", "p.token", "p.tf", "norm"))

    @property
    def postings(self) -> DataFrame:
        """(item_id, ordinal, token, tf, wn), wn: L2-normalised tf*idf"""
        return self.counts.join(self.vocab.select("token", "idf"), "token").select(
            "item_id", "ordinal", "token", "tf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("wn"))


def stop_frame(spark: SparkSession, stop_words: list[str] | None) -> DataFrame:
    words = default_stop_words() if stop_words is None else stop_words
    return spark.createDataFrame([(w,) for w in words] or [("",)], "token string")


def word_postings(df: DataFrame, id_col: str, text_col: str, stop: DataFrame) -> DataFrame:
    """(id, [ordinal,] token, tf) of 2+-character word tokens without stop words."""
    keep = [c for c in df.columns if c == "ordinal"]
    d = df.select(id_col, *keep, tok_word2(text_col).alias("toks"))
    d = with_term_freqs(d, "toks", "tfs")
    p = (d.select(id_col, *keep, F.explode_outer("tfs").alias("p")).filter(F.col("p").isNotNull())
         .select(id_col, *keep, F.col("p.token").alias("token"), F.col("p.tf").alias("tf")))
    # the stop list is a fixed, small table: broadcast is bounded by it
    return p.join(F.broadcast(stop), "token", "left_anti")


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The elements of a list column, the row of each, and the offsets."""
    off = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(off[0], off[-1] - off[0])
    return flat, np.repeat(np.arange(len(lists)), np.diff(off)), off - off[0]


def _kept(lists: pa.ListArray, least: int, mask: pa.Array | None = None) -> pa.ListArray:
    """The strings of ``least`` characters or more."""
    flat, _, off = _flat(lists)
    good = pc.greater_equal(pc.utf8_length(flat) if least > 1 else pc.binary_length(flat), least)
    kept = np.r_[0, np.cumsum(good.to_numpy(zero_copy_only=False))]
    return pa.ListArray.from_arrays(pa.array(kept[off], pa.int32()), flat.filter(good), mask=mask)


def _spaced(text: pa.Array) -> pa.ListArray:
    """The pieces of each (lower-cased) text between white space, repeats
    kept: ``tok_ws``."""
    odd = pc.match_substring_regex(text, ODD_SPACE).fill_null(False)
    if pc.any(odd).as_py():
        text = pc.replace_with_mask(text, odd, pc.replace_substring_regex(text.filter(odd), ODD_SPACE, " "))
    return _kept(pc.ascii_split_whitespace(text), 1, text.is_null())


def _counts(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, how often) of each distinct pair, ordered; ``n`` codes."""
    key, tf = np.unique(row * max(1, n) + code, return_counts=True)
    return key // max(1, n), key % max(1, n), tf


def _listed(words: pa.Array, code: np.ndarray, n: np.ndarray, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays(
        [words.take(pa.array(code)), pa.array(n, pa.int64())], ["token", "tf"]))


def _pieces(words: pa.Array, row: np.ndarray, code: np.ndarray, tf: np.ndarray, stop: pa.Array
            ) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Counted whitespace tokens as counted word tokens (words, row, code,
    tf) without the stop words: white space is no part of a word, so each
    distinct token is cut once."""
    flat, _, off = _flat(_kept(pc.split_pattern_regex(words, NON_WORD_RE), 2))
    coded = flat.dictionary_encode()
    own, idx = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    good = ~np.asarray(pc.is_in(own, value_set=stop))[idx] if len(idx) else np.zeros(0, bool)
    off = np.r_[0, np.cumsum(good)][off]
    idx = idx[good]
    size = np.diff(off)[code]
    at = np.repeat(off[:-1][code] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    times = np.repeat(tf, size)
    return own, *_counts(np.repeat(np.repeat(row, size), times), np.repeat(idx[at], times), len(own))


def token_rows(corpus: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """(row, item_id, ordinal, dl, ws, tfs, ws_df, tfs_df): the counted tokens
    of both indexes in the item's row, stored.  ``row`` tells repeated ids
    apart; the first row of each piece of a batch also has the piece's own
    vocabularies, each token with the number of its rows that hold it.

    The tasks get the lower-cased texts and cut them as a column, so no token
    is a JVM object and none is handed over one by one."""
    words = default_stop_words() if stop_words is None else stop_words
    d = corpus.select(F.monotonically_increasing_id().alias("row"), "item_id", "ordinal", F.lower("text").alias("text"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        ws = _spaced(b.column("text"))
        flat, row, _ = _flat(ws)
        coded = flat.dictionary_encode()
        own = coded.dictionary
        counted = own, *_counts(row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(own))
        out = {c: b.column(c) for c in ("row", "item_id", "ordinal")} | {"dl": pc.list_value_length(ws)}
        for name, (token, row, code, tf) in (("ws", counted), ("tfs", _pieces(*counted, pa.array(words, pa.string())))):
            out[name] = _listed(token, code, tf, np.searchsorted(row, np.arange(b.num_rows + 1)))
            df = np.bincount(code, minlength=len(token))
            held = np.flatnonzero(df)
            out[name + "_df"] = _listed(token, held, df[held], np.r_[0, np.full(b.num_rows, len(held))])
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = max(1, b.num_rows * PIECE_BYTES // max(1, b.nbytes))
            for lo in range(0, b.num_rows, size):
                yield cut(b.slice(lo, size))

    kinds = dict(d.dtypes)
    own = ", ".join(f"{c} {kinds[c]}" for c in ("row", "item_id", "ordinal"))
    lists = ", ".join(f"{c} array<struct<token: string, tf: long>>" for c in ("ws", "ws_df", "tfs", "tfs_df"))
    return stored(d.mapInArrow(run, f"{own}, dl int, {lists}"), "tokens")


def _dfs(rows: DataFrame, column: str) -> DataFrame:
    """(token, df) of stored ``token_rows``: the pieces' vocabularies together."""
    return (rows.select(F.explode_outer(column).alias("p")).filter(F.col("p").isNotNull())
            .groupBy("p.token").agg(F.sum("p.tf").alias("df")))


def _norms(d: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row, norm): lengths of the rows' TF-IDF vectors.  Every task holds the
    idf of the ``HOT_TOKENS`` most frequent tokens, so only the occurrences of
    the rarer ones are dealt by token."""
    idf = vocab.select("token", "df", "idf")
    hot = idf.orderBy(F.desc("df"), "token").limit(HOT_TOKENS).select("token", "idf").toArrow().combine_chunks()
    shared = d.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.concat_arrays(shared.value.column("token").chunks) if shared.value.num_rows else pa.array([], pa.string())
        weight = np.r_[shared.value.column("idf").to_numpy(), 0.0]
        for b in batches:
            flat, row, _ = _flat(b.column("tfs"))
            token, tf = flat.field("token"), flat.field("tf").to_numpy(zero_copy_only=False)
            at = pc.index_in(token, value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False)
            square = np.bincount(row, (tf * weight[at]) ** 2, b.num_rows)
            rare = np.flatnonzero(at == len(known))
            own = b.column("row").to_numpy()
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.r_[own, own[row[rare]]]),
                "s": pa.array(np.r_[square, np.zeros(len(rare))]),
                "token": pa.concat_arrays([pa.nulls(b.num_rows, pa.string()), token.take(pa.array(rare))]),
                "tf": pa.array(np.r_[np.zeros(b.num_rows, np.int64), tf[rare]], pa.int64())})

    p = stored(d.select("row", "tfs").mapInArrow(run, "row long, s double, token string, tf long"), "squares")
    rare = p.where("token IS NOT NULL").join(idf.select("token", "idf"), "token") \
        .select("row", ((F.col("tf") * F.col("idf")) ** 2).alias("s"))
    return p.where("token IS NULL").select("row", "s").unionByName(rare).groupBy("row").agg(F.sqrt(F.sum("s")).alias("norm"))


def tfidf_index(corpus: DataFrame, stop_words: list[str] | None = None, rows: DataFrame | None = None) -> TfidfIndex:
    """TF-IDF with raw term counts, smooth idf = ln((1+N)/(1+df)) + 1 and
    L2-normalised document vectors.  ``rows``: stored ``token_rows``."""
    spark = corpus.sparkSession
    d = token_rows(corpus, stop_words) if rows is None else rows
    n_docs = scalar(corpus.agg(F.count(F.lit(1)).cast("double")))
    vocab = _dfs(d, "tfs_df")
    vocab = stored(vocab.withColumn("idf", F.ln((n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0), "vocabulary")
    return TfidfIndex(d, vocab, stop_frame(spark, stop_words))
