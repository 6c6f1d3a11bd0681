"""Sparse scoring of many questions without (question, item) rows.

A corpus item is one *forward* row: its tokens with their impacts.  Tasks read
blocks of items and hold the weights of a bounded slice of questions; what
leaves a task is bounded by its questions, never by pairs (but for ``pairs``):

* ``top``: every task keeps the best ``k`` items per question.  The k-th best
  score so far is the question's bound, at first that of a hash sample of the
  corpus (a part's k-th best is never above the whole's).  For every block the
  tokens' largest impacts are known, so that

  - a question whose tokens together cannot reach its bound skips the block,
  - otherwise its rarest tokens are scored first; the most frequent ones, as
    far as their largest impacts together stay below the bound, are only looked
    up for the items whose score so far could still reach it.

* ``pairs``: the scores of all matched pairs, for results that have a row for
  each: an item's tokens are in its row, so a pair is scored whole in one task
  and none is shuffled.
* ``stats``: number, least and largest score of the matched items.
* ``lookup``: scores of given candidates only.
* ``before``: how many matched items are ordered before given cuts (candidates'
  scores): each score falls into a range between two cuts of its question, and
  tasks emit counts of ranges.

Questions are dealt into slices of ``SLICE_TERMS`` weighted tokens, one pass
over the forward rows for each, which bounds what is sent to the tasks.
Weights are not negative (``nonnegative`` tells).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import RANK_DIGITS, broadcast_if_small, rank_key, topk

SLICE_TERMS = 200_000
CELLS = 1 << 21      # questions x items scored at a time
CROWDED = 64         # items in a block that hold a question token, on average
SEED_PART = 32       # one in so many items gives the first bounds
POOL_ROWS = 1 << 16  # found rows that are held before they are cut to k
HOT_SHARE = 128      # a token is multiplied where one in so many (question, item) cells share it
EPS = 2 * 10.0 ** -RANK_DIGITS


def nonnegative(terms: DataFrame) -> bool:
    """Whether no token of the questions has a negative weight."""
    return not terms.where("w < 0").limit(1).count()


@dataclass
class Slice:
    """Weighted tokens of some questions, ordered by question and rarity."""

    queries: np.ndarray
    tokens: list[pa.Array]   # per kind of token
    term: np.ndarray         # number of each question token (kinds follow each other)
    w: np.ndarray
    start: np.ndarray        # first token of each question, and the end
    df: list[np.ndarray]     # per kind, of each token: how many items hold it

    def __post_init__(self):
        self.of = np.repeat(np.arange(len(self.queries)), np.diff(self.start))
        self.n_terms = sum(map(len, self.tokens))
        self.by_term = np.argsort(self.term, kind="stable")


def slices(terms: DataFrame) -> Iterator[Slice]:
    """``terms`` (query_id, kind, token, w, df) a bounded slice at a time."""
    n = max(1, -(-terms.count() // SLICE_TERMS))
    for k in range(n):
        own = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)
        t = own.orderBy("query_id", "df", "kind", "token").toArrow().combine_chunks()
        q, start = np.unique(t.column("query_id").to_numpy(), return_index=True)
        kind, token = t.column("kind").to_numpy(), t.column("token").combine_chunks()
        number, tokens, dfs, at = np.zeros(len(kind), np.int64), [], [], 0
        df = t.column("df").to_numpy()
        for i in (0, 1):
            mine = np.flatnonzero(kind == i)
            code = token.take(pa.array(mine)).dictionary_encode()
            code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
            own = code.indices.to_numpy(zero_copy_only=False)
            number[mine] = own + at
            tokens.append(code.dictionary)
            dfs.append(np.zeros(len(code.dictionary)))
            dfs[-1][own] = df[mine]
            at += len(code.dictionary)
        yield Slice(q, tokens, number, t.column("w").to_numpy(), np.r_[start, len(kind)], dfs)


class Block:
    """Occurrences of a slice's tokens in some forward rows, by token."""

    def __init__(self, s: Slice, b: pa.RecordBatch, impacts: tuple[Callable | None, Callable | None]):
        self.n = b.num_rows
        doc, term, value, at = [], [], [], 0
        for kind, impact in enumerate(impacts):
            tokens = s.tokens[kind]
            if impact is not None and len(tokens):
                rows = b.column(("ws", "wd")[kind])
                off = np.asarray(rows.offsets).astype(np.int64)
                flat = rows.values.slice(off[0], off[-1] - off[0])
                code = pc.index_in(flat.field("token"), value_set=tokens)
                hit = np.flatnonzero(np.asarray(code.is_valid()))
                d = np.searchsorted(off - off[0], hit, side="right") - 1
                doc.append(d)
                own = code.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64)
                term.append(own + at)
                value.append(impact(b, flat, hit, d, s.df[kind][own]))
            at += len(tokens)
        none = np.zeros(0, np.int64)
        doc, term = (np.concatenate(x) if x else none for x in (doc, term))
        order = np.lexsort((doc, term))
        self.doc, self.term = doc[order], term[order]
        self.value = (np.concatenate(value) if value else none.astype(float))[order]
        self.first = np.searchsorted(self.term, np.arange(s.n_terms + 1))

    def largest(self) -> np.ndarray:
        """Each token's largest impact, 0 where it does not occur."""
        out = np.zeros(len(self.first) - 1)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            out[some] = np.maximum.reduceat(self.value, self.first[some])
        return out

    def spread(self, s: Slice, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, contribution) of the question tokens ``used``: cell =
        question * items + item."""
        size = (self.first[1:] - self.first[:-1])[s.term[used]]
        at = np.repeat(self.first[:-1][s.term[used]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        own = np.repeat(used, size)
        return s.of[own] * self.n + self.doc[at], s.w[own] * self.value[at]

    def _crowded(self, s: Slice, used: np.ndarray) -> bool:
        """Whether the tokens are so frequent here that adding them one by one
        beats a row per question, token and item."""
        return len(used) > 0 and (self.first[1:] - self.first[:-1])[s.term[used]].sum() >= CROWDED * len(used)

    def _added(self, s: Slice, used: np.ndarray, hit: np.ndarray | None = None) -> np.ndarray:
        """The tokens' contributions to each cell, added in the order of
        ``spread``; their cells are marked in ``hit``."""
        out = np.zeros((len(s.queries), self.n))
        for q, t, w in zip(s.of[used].tolist(), s.term[used].tolist(), s.w[used].tolist()):
            lo, hi = self.first[t], self.first[t + 1]
            if lo < hi:
                doc = self.doc[lo:hi]
                out[q][doc] += w * self.value[lo:hi]
                if hit is not None:
                    hit[q][doc] = True
        return out.ravel()

    def scores(self, s: Slice, used: np.ndarray, counted: bool = False) -> np.ndarray:
        if not counted and self._crowded(s, used):
            return self._added(s, used)
        cell, x = self.spread(s, used)
        return np.bincount(cell, None if counted else x, len(s.queries) * self.n)

    def whole(self, s: Slice, used: np.ndarray) -> np.ndarray:
        """Scores of all questions and items (a row per question) by the
        question tokens ``used``.  Tokens that many questions and many items
        hold are a matrix product, the others are added one by one."""
        n, nq = self.n, len(s.queries)
        hot = np.bincount(s.term[used], minlength=s.n_terms) * np.diff(self.first) > n * nq / HOT_SHARE
        own = hot[s.term[used]]
        out = self.scores(s, used[~own]).reshape(nq, n)
        if own.any():
            code = np.cumsum(hot) - 1
            weight, value = np.zeros((nq, code[-1] + 1)), np.zeros((code[-1] + 1, n))
            np.add.at(weight, (s.of[used[own]], code[s.term[used[own]]]), s.w[used[own]])
            at = np.flatnonzero(hot[self.term])
            value[code[self.term[at]], self.doc[at]] = self.value[at]
            out = out + weight @ value
        return out

    def matched(self, s: Slice, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(whether any token is held, score) of every cell, by the question
        tokens ``used`` (all)."""
        used = np.arange(len(s.w)) if used is None else used
        hit = np.zeros((len(s.queries), self.n), bool)
        if self._crowded(s, used):
            score = self._added(s, used, hit)
            return hit.ravel(), score
        hit = hit.ravel()
        cell, x = self.spread(s, used)
        hit[cell] = True
        return hit, np.bincount(cell, x, len(hit))

    def found(self, s: Slice, cell: np.ndarray, terms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """What the tokens ``terms`` (first, end per question) add to cells."""
        lo, hi = terms[0][cell // self.n], terms[1][cell // self.n]
        size = hi - lo
        of = np.repeat(np.arange(len(cell)), size)
        t = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        key = s.term[t] * self.n + (cell % self.n)[of]
        held = self.term * self.n + self.doc
        at = np.minimum(np.searchsorted(held, key), max(len(held) - 1, 0))
        hit = held[at] == key if len(held) else np.zeros(len(key), bool)
        return np.bincount(of[hit], (s.w[t] * self.value[at])[hit], len(cell)) if hit.any() else np.zeros(len(cell))


def _blocks(s: Slice, batches: Iterator[pa.RecordBatch], impacts) -> Iterator[tuple[pa.RecordBatch, Block]]:
    size = max(1, CELLS // max(1, len(s.queries)))
    for b in batches:
        for lo in range(0, b.num_rows, size):
            part = b.slice(lo, size)
            yield part, Block(s, part, impacts)


class _Best:
    """The best ``k`` found rows per question, and the bounds they give."""

    def __init__(self, n: int, k: int, bound: np.ndarray):
        self.k, self.bound, self.n = k, bound.copy(), n
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, q, key, ordinal, item, score) -> None:
        self.held.append((q, key, ordinal, item, score))
        self.rows += len(q)
        if self.rows - len(self.held[0][0]) > max(POOL_ROWS, self.k * self.n) // 8 or len(self.held) == 1:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            none = np.zeros(0, np.int64)
            return none, none.astype(float), none, none, none.astype(float)
        q, key, ordinal, item, score = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ordinal, -key, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        order, last = order[top], order[rank == self.k - 1]
        out = tuple(c[order] for c in (np.concatenate([h[0] for h in self.held]), key, ordinal, item, score))
        of_last = np.concatenate([h[0] for h in self.held])[last]
        self.bound[of_last] = np.maximum(self.bound[of_last], key[last])
        self.held, self.rows = [out], len(out[0])
        return out


class Scorer:
    """Scores of questions against forward rows (item_id, ordinal, and ``ws``
    with dl, or ``wd`` with norm, or both)."""

    def __init__(self, forward: DataFrame, n_items: int, avgdl: float = 0.0, k1: float = 1.5, b: float = 0.75,
                 kinds: tuple[bool, bool] = (True, True)):
        self.forward, self.n_items = forward, n_items

        def bm25(batch, flat, hit, doc, df):
            tf = flat.field("tf").to_numpy(zero_copy_only=False)[hit].astype(float)
            dl = batch.column("dl").to_numpy().astype(float)[doc]
            return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))

        def tfidf(batch, flat, hit, doc, df):
            tf = flat.field("tf").to_numpy(zero_copy_only=False)[hit].astype(float)
            return tf * (np.log((n_items + 1.0) / (df + 1.0)) + 1.0) / batch.column("norm").to_numpy(zero_copy_only=False)[doc]

        self.impacts = (bm25 if kinds[0] else None, tfidf if kinds[1] else None)

    def _passes(self, terms: DataFrame, run, schema: str, rows: DataFrame | None = None, extra=None) -> DataFrame:
        """``run(slice, extra, batches)`` over the forward rows, per slice."""
        rows = self.forward if rows is None else rows
        spark, out = rows.sparkSession, None
        for s in slices(terms):
            shared = spark.sparkContext.broadcast((s, extra(s) if extra else None))

            def task(batches, shared=shared):
                return run(*shared.value, batches)
            # tokens of a kind that is not asked for stay behind
            idle = [c for c, asked, impact in zip(("ws", "wd"), s.tokens, self.impacts) if impact is None or not len(asked)]
            part = rows.drop(*idle).mapInArrow(task, schema)
            out = part if out is None else out.unionAll(part)
        return out

    def top(self, terms: DataFrame, k: int, rows: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
        """(query_id, item_id, ordinal, score): the best ``k`` items per
        question among those that score above 0, by (score, ordinal)."""
        impacts = self.impacts
        if rows is None and self.n_items >= 4 * SEED_PART * k:
            part = self.forward.where(F.pmod(F.xxhash64("item_id"), F.lit(SEED_PART)) == 0)
            first = self.top(terms, k, rows=part)
            bounds = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(rank_key("score")).alias("bound")) \
                .where(F.col("n") >= k).select("query_id", "bound")

        def known(s: Slice) -> np.ndarray:
            return np.array([given.get(q, 0.0) for q in s.queries.tolist()])

        given = dict(map(tuple, bounds.collect())) if bounds is not None else {}  # a number per question

        def run(s: Slice, bound: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(s.queries), k, bound)
            for b, block in _blocks(s, batches, impacts):
                ub = s.w * block.largest()[s.term]
                # what a token and all more frequent ones of its question can add
                rest = np.r_[np.cumsum(ub[::-1])[::-1], 0.0]
                tail = rest[:-1] - rest[s.start[1:]][s.of]
                low = tail < best.bound[s.of] - EPS
                first_low = s.start[1:] - np.bincount(s.of, low, len(s.queries)).astype(np.int64)
                used = np.flatnonzero(~low & (ub > 0))
                if not len(used):
                    continue
                score = block.scores(s, used)
                open_ = np.where(first_low < s.start[1:], tail[np.minimum(first_low, len(tail) - 1)], 0.0)
                need = np.maximum(best.bound - open_ - EPS, 0.0)
                cell = np.flatnonzero(score > np.repeat(need, block.n))
                if not len(cell):
                    continue
                total = score[cell] + block.found(s, cell, (first_low, s.start[1:]))
                q, d = cell // block.n, cell % block.n
                key = np.round(total, RANK_DIGITS)
                good = (key >= best.bound[q] - EPS) & (total > 0)
                q, d, key, total = q[good], d[good], key[good], total[good]
                best.add(q, key, b.column("ordinal").to_numpy()[d], b.column("item_id").to_numpy()[d], total)
            q, _, ordinal, item, score = best.cut()
            if len(q):
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(s.queries[q], pa.int64()), "item_id": pa.array(item, pa.int64()),
                    "ordinal": pa.array(ordinal, pa.int64()), "score": pa.array(score)})

        found = self._passes(terms, run, "query_id long, item_id long, ordinal long, score double", rows, known)
        return topk(found, "query_id", "score", "ordinal", k).drop("rank")

    def pairs(self, terms: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """(query_id, item_id, ordinal, bm25, cosine) of every pair of a
        question and a row that share a token; a score is null where no token
        of its kind is shared."""
        impacts = self.impacts

        def run(s: Slice, _, batches):
            kinds = s.term >= len(s.tokens[0])
            for b, block in _blocks(s, batches, impacts):
                hits, scores = zip(*(block.matched(s, np.flatnonzero(kinds == kind)) for kind in (0, 1)))
                cells = np.flatnonzero(hits[0] | hits[1])
                for lo in range(0, len(cells), POOL_ROWS):
                    cell = cells[lo:lo + POOL_ROWS]
                    d = pa.array(cell % block.n)
                    yield pa.RecordBatch.from_pydict({
                        "query_id": pa.array(s.queries[cell // block.n], pa.int64()),
                        "item_id": b.column("item_id").take(d).cast(pa.int64()),
                        "ordinal": b.column("ordinal").take(d).cast(pa.int64()),
                        **{name: pa.array(score[cell], mask=~hit[cell]) for name, hit, score in zip(("bm25", "cosine"), hits, scores)}})

        return self._passes(terms, run, "query_id long, item_id long, ordinal long, bm25 double, cosine double", rows)

    def stats(self, terms: DataFrame) -> DataFrame:
        """(query_id, mn, mx, m): least and largest score and the number of the
        matched items."""
        impacts = self.impacts

        def run(s: Slice, _, batches):
            n = len(s.queries)
            low, high, m = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
            for _, block in _blocks(s, batches, impacts):
                hit, score = (x.reshape(n, block.n) for x in block.matched(s))
                low = np.minimum(low, np.where(hit, score, np.inf).min(axis=1))
                high = np.maximum(high, np.where(hit, score, -np.inf).max(axis=1))
                m += hit.sum(axis=1)
            some = np.flatnonzero(m)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(s.queries[some], pa.int64()), "mn": pa.array(low[some]),
                                              "mx": pa.array(high[some]), "m": pa.array(m[some])})

        out = self._passes(terms, run, "query_id long, mn double, mx double, m long")
        return out.groupBy("query_id").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("m").alias("m"))

    def lookup(self, terms: DataFrame, cands: DataFrame) -> DataFrame:
        """(query_id, item_id, ordinal, score) of the ``cands`` (query_id,
        item_id) that are matched."""
        impacts = self.impacts
        asked = cands.select("query_id", "item_id").distinct().groupBy("item_id").agg(
            F.collect_list("query_id").alias("asked"))
        rows = self.forward.join(broadcast_if_small(asked), "item_id")

        def run(s: Slice, _, batches):
            for b, block in _blocks(s, batches, impacts):
                lists = b.column("asked")
                off = np.asarray(lists.offsets).astype(np.int64)
                ask = lists.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(b.num_rows), np.diff(off))
                at = np.minimum(np.searchsorted(s.queries, ask), len(s.queries) - 1)
                own = s.queries[at] == ask
                cell = at[own] * block.n + doc[own]
                hit, score = block.matched(s)
                cell = cell[hit[cell]]
                d = cell % block.n
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(s.queries[cell // block.n], pa.int64()),
                    "item_id": b.column("item_id").take(pa.array(d)), "ordinal": b.column("ordinal").take(pa.array(d)).cast(pa.int64()),
                    "score": pa.array(score[cell])})

        return self._passes(terms, run, "query_id long, item_id long, ordinal long, score double", rows)

    def before(self, terms: DataFrame, cuts: DataFrame) -> DataFrame:
        """(query_id, item_id, n_before): how many of the question's matched
        items are ordered before each cut (query_id, item_id, ordinal, score).

        The cuts of a question are candidates, so their number is bounded;
        they are sent along with the slice of their questions."""
        impacts = self.impacts
        given = cuts.select("query_id", "item_id", "ordinal", rank_key("score").alias("key"))

        def known(s: Slice):
            spark = cuts.sparkSession
            mine = spark.createDataFrame([(int(x),) for x in s.queries], "query_id long")
            rows = given.join(F.broadcast(mine), "query_id").orderBy("query_id", F.desc("key"), "ordinal").toArrow()
            q = np.searchsorted(s.queries, rows.column("query_id").to_numpy())
            return (q, rows.column("item_id").to_numpy(), rows.column("key").to_numpy(), rows.column("ordinal").to_numpy(),
                    np.searchsorted(q, np.arange(len(s.queries) + 1)))

        def run(s: Slice, cut, batches):
            q, items, key, ordinal, start = cut
            n = len(s.queries)
            ranges = np.zeros(len(q) + n, np.int64)  # range c of a question: its rows after c of the cuts
            base = start[:-1] + np.arange(n)
            for b, block in _blocks(s, batches, impacts):
                hit, score = (x.reshape(n, block.n) for x in block.matched(s))
                score = np.round(score, RANK_DIGITS)
                ords = b.column("ordinal").to_numpy()
                for i in np.flatnonzero(hit.any(axis=1) & (np.diff(start) > 0)):
                    d = np.flatnonzero(hit[i])
                    lo, hi = start[i], start[i + 1]
                    # (key desc, ordinal) of the cuts and the rows, as one order
                    k = np.r_[key[lo:hi], score[i, d]]
                    o = np.r_[ordinal[lo:hi], ords[d]]
                    order = np.lexsort((np.r_[np.zeros(hi - lo), np.ones(len(d))], o, -k))
                    is_cut = order < hi - lo
                    passed = np.cumsum(is_cut)[~is_cut]
                    ranges[base[i]:base[i] + hi - lo + 1] += np.bincount(passed, minlength=hi - lo + 1)
            # rows before a cut lie in the ranges up to it
            total = np.cumsum(ranges)
            at = np.arange(len(q)) + q
            count = total[at] - np.where(base[q] > 0, total[np.maximum(base[q] - 1, 0)], 0)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(s.queries[q], pa.int64()), "item_id": pa.array(items, pa.int64()),
                                              "n_before": pa.array(count)})

        out = self._passes(terms, run, "query_id long, item_id long, n_before long", extra=known)
        return out.groupBy("query_id", "item_id").agg(F.sum("n_before").alias("n_before"))

