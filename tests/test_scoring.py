"""Bounded scoring against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.operators import index as ix
from ranksmith.operators import scoring as sc
from ranksmith.operators import search as se
from ranksmith.plans import retrieve as rt


@pytest.fixture(scope="module")
def world(spark):
    """Zipf words, copies (ties), an item without words, questions with
    repeated, unknown and very frequent words."""
    rnd = random.Random(6)
    word = lambda: f"w{int(1 / (rnd.random() + 0.004))}"
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(500)]
    texts += [texts[3]] * 20 + ["", "w1 w1 w1", "unique words here"]
    asks = [" ".join(word() for _ in range(rnd.randrange(1, 20))) for _ in range(25)] + ["w1", "w1 w2", "nothing known", "", "unique w1 w1"]
    corpus = spark.createDataFrame([(i, 1000 - i, f"N{i}", t) for i, t in enumerate(texts)],
                                   "item_id long, ordinal long, name string, text string").repartition(5)
    qs = spark.createDataFrame(list(enumerate(asks)), "query_id long, question string")
    return corpus, qs, rt.Indexes(corpus)


@pytest.mark.parametrize("limits", [{}, {"SLICE_TERMS": 7, "CELLS": 64, "SEED_PART": 2, "POOL_ROWS": 8}])
def test_top_equals_all_pairs(world, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(sc, name, value)
    corpus, qs, idx = world
    for scorer, terms, pairs in ((se.bm25_scorer(idx.bm25), se.bm25_terms(idx.bm25, qs), se.bm25_scores(idx.bm25, qs)),
                                 (idx.hybrid, se.tfidf_terms(idx.tfidf, qs), se.tfidf_scores(idx.tfidf, qs))):
        assert sc.nonnegative(terms)
        every = collections.defaultdict(list)
        for r in pairs.where("score > 0").collect():
            every[r.query_id].append((-round(r.score, 9), r.ordinal, r.item_id))
        want = {(q, x[2]): -x[0] for q, rows in every.items() for x in sorted(rows)[:4]}
        got = {(r.query_id, r.item_id): round(r.score, 9) for r in scorer.top(terms, 4).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 3e-9 for k in want)


def test_statistics_lookup_and_ranks(world, monkeypatch):
    monkeypatch.setattr(sc, "CELLS", 200)
    corpus, qs, idx = world
    every = collections.defaultdict(dict)
    for r in se.bm25_scores(idx.bm25, qs).collect():
        every[r.query_id][r.item_id] = (-round(r.score, 9), r.ordinal)
    st = {r.query_id: (r.m, round(r.mn, 9), round(r.mx, 9)) for r in idx.hybrid.stats(se.bm25_terms(idx.bm25, qs)).collect()}
    assert st == {q: (len(x), -max(x.values())[0], -min(x.values())[0]) for q, x in every.items()}
    cands = qs.select("query_id").crossJoin(corpus.where("item_id % 37 = 0").select("item_id"))
    got = rt.pool_scores(idx, qs, cands).collect()
    assert len(got) == cands.count()
    for r in got:
        own = every[r.query_id]
        if r.item_id in own:
            assert round(r.bm25, 9) == -own[r.item_id][0]
            assert r.bm25_rank == 1 + sum(x < own[r.item_id] for x in own.values())
        else:
            assert r.bm25 is None and r.bm25_rank == len(own) + 1


def test_frequent_tokens_are_looked_up_for_survivors_only(world):
    """With a bound, blocks score the rare tokens only, and the result stays."""
    corpus, qs, idx = world
    terms = se.bm25_terms(idx.bm25, qs)
    (s,) = sc.slices(terms)
    assert (np.diff(s.start) > 0).all() and len(s.queries) == 28
    df = {r.token: r.df for r in terms.collect()}
    for a, b in zip(s.start[:-1], s.start[1:]):  # rarest first
        own = [df[s.tokens[0][int(t)].as_py()] for t in s.term[a:b]]
        assert own == sorted(own)
    scored = []
    scores = sc.Block.scores
    try:
        sc.Block.scores = lambda self, s, used, counted=False: scored.append(len(used)) or scores(self, s, used, counted)
        batch = idx.hybrid.forward.toArrow().combine_chunks().to_batches()[0]
        block = sc.Block(s, batch, idx.hybrid.impacts)
        full = block.scores(s, np.arange(len(s.w))).reshape(len(s.queries), -1)
        bound = np.sort(full, axis=1)[:, -3]
        ub = s.w * block.largest()[s.term]
        for q in range(len(s.queries)):
            tail = np.cumsum(ub[s.start[q]:s.start[q + 1]][::-1])[::-1]
            rare = np.flatnonzero(tail >= bound[q]) + s.start[q]
            part = block.scores(s, rare).reshape(len(s.queries), -1)[q]
            open_ = tail[len(rare)] if len(rare) < len(tail) else 0.0
            assert set(np.flatnonzero(full[q] >= bound[q])) <= set(np.flatnonzero(part + open_ >= bound[q] - 1e-9))
    finally:
        sc.Block.scores = scores
    assert scored[0] == len(s.w) and min(scored[1:]) < max(scored[1:])


def test_small_corpus_with_negative_idf(spark):
    corpus = spark.createDataFrame([(i, i, f"N{i}", "a b") for i in range(4)], "item_id long, ordinal long, name string, text string")
    qs = spark.createDataFrame([(1, "a a c")], "query_id long, question string")
    idx = rt.Indexes(corpus)
    assert not sc.nonnegative(se.bm25_terms(idx.bm25, qs))
    got = [r.item_id for r in se.bm25_search(idx.bm25, qs, corpus, 3).orderBy("rank").collect()]
    assert got == [0, 1, 2]
    assert [r.item_id for r in rt.hybrid_pool(idx, qs, 2).orderBy("rank").collect()] == [0, 1]


def test_tfidf_weights_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ix, "CHUNK_TOKENS", 30)
    rnd = random.Random(1)
    texts = [" ".join(f"x{rnd.randrange(30)}" for _ in range(rnd.randrange(0, 25))) for _ in range(40)] + ["the of", ""]
    corpus = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "item_id long, ordinal long, text string")
    t = ix.tfidf_index(corpus)
    n = len(texts)
    df = collections.Counter(w for x in texts for w in set(x.split()) - {"the", "of"})
    want = {}
    for i, x in enumerate(texts):
        c = collections.Counter(w for w in x.split() if w not in ("the", "of"))
        w = {k: v * (np.log((n + 1) / (df[k] + 1)) + 1) for k, v in c.items()}
        norm = np.sqrt(sum(v * v for v in w.values()))
        want |= {(i, k): v / norm for k, v in w.items()}
    got = {(r.item_id, r.token): r.wn for r in t.postings.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert t.forward.count() == n


def _bm25_brute(texts: list[str], asks: list[str]) -> dict:
    """(question, item) -> score of every pair that shares a word."""
    docs = [t.lower().split() for t in texts]
    df = collections.Counter(w for d in docs for w in set(d))
    raw = {w: np.log(len(docs) - n + 0.5) - np.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    avg = sum(map(len, docs)) / len(docs)
    out = {}
    for q, ask in enumerate(asks):
        for i, d in enumerate(docs):
            tf = collections.Counter(d)
            held = [w for w in ask.lower().split() if w in tf]
            if held:
                out[q, i] = sum((raw[w] if raw[w] >= 0 else 0.25 * mean) * tf[w] * 2.5
                                / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in held)
    return out


@pytest.mark.parametrize("limits", [{}, {"SLICE_TERMS": 7, "CELLS": 64, "POOL_ROWS": 8}])
def test_all_pairs_are_scored_where_the_items_lie(world, monkeypatch, limits):
    """a row per pair, scored whole in the task that reads the item,
    so the plan has no exchange of pairs."""
    for name, value in limits.items():
        monkeypatch.setattr(sc, name, value)
    corpus, qs, idx = world
    texts = [r.text for r in corpus.orderBy("item_id").collect()]
    asks = [r.question for r in qs.orderBy("query_id").collect()]
    want = _bm25_brute(texts, asks)
    scores = se.bm25_scores(idx.bm25, qs)
    got = {(r.query_id, r.item_id): r.score for r in scores.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    both = se.both_scores(idx.all_pairs, se.bm25_terms(idx.bm25, qs), se.tfidf_terms(idx.tfidf, qs))
    cosine = {(r.query_id, r.item_id): r.score for r in se.tfidf_scores(idx.tfidf, qs).collect()}
    rows = {(r.query_id, r.item_id): r for r in both.collect()}
    assert rows.keys() == got.keys() | cosine.keys()
    for k, r in rows.items():
        for value, own in ((r.bm25, got), (r.cosine, cosine)):
            assert (value is None) == (k not in own) and (value is None or abs(value - own[k]) < 1e-9)
    normed = se.minmax_norm(scores, idx.n_items)
    for plan in (scores, both, normed):
        assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    low = {q: min(0.0, *(v for k, v in want.items() if k[0] == q)) for q, _ in want}
    high = {q: max(0.0, *(v for k, v in want.items() if k[0] == q)) for q, _ in want}
    for r in normed.collect():
        assert abs(r.norm - (r.score - low[r.query_id]) / ((high[r.query_id] - low[r.query_id]) or 1.0)) < 1e-9


def test_pairs_of_repeated_and_null_ids_add_up(spark):
    rows = [(1, 1, "A", "x y"), (1, 1, "A", "x x z"), (2, 2, "B", "x q"), (None, None, None, "y q"), (None, None, None, "y z")] + [
        (i, i, "C", f"other{i} words{i}") for i in range(3, 20)]
    corpus = spark.createDataFrame(rows, "item_id long, ordinal long, name string, text string")
    qs = spark.createDataFrame([(7, "x y"), (None, "y"), (None, "q")], "query_id long, question string")
    got = {(r.query_id, r.item_id): r.score for r in se.bm25_scores(rt.Indexes(corpus).bm25, qs).collect()}
    want = collections.defaultdict(float)
    for (q, i), v in _bm25_brute([r[3] for r in rows], ["x y", "y", "q"]).items():
        want[(7, None, None)[q], rows[i][0]] += v
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_frequent_tokens_are_added_without_a_row_per_token_and_item(spark, monkeypatch):
    import numpy as np

    from ranksmith.operators import scoring as sc
    n = 300
    corpus = spark.createDataFrame([(i, i, f"n{i}", "aa bb " + ("cc " if i % 2 else "") + f"w{i}") for i in range(n)],
                                   "item_id long, ordinal long, name string, text string").coalesce(1)
    idx = rt.Indexes(corpus)
    batch = idx.hybrid.forward.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    s = next(sc.slices(spark.createDataFrame(
        [(7, 0, "aa", 0.1, n), (7, 0, "cc", 0.7, n // 2), (7, 1, "bb", 0.3, n), (8, 1, "aa", 0.2, n), (8, 0, "cc", 0.0, n // 2),
         (8, 0, "zz", 1.0, 1), (9, 0, "w5", 0.9, 1)], "query_id long, kind int, token string, w double, df long")))
    block, every = sc.Block(s, batch, idx.hybrid.impacts), np.arange(len(s.w))
    monkeypatch.setattr(sc, "CROWDED", 1 << 40)
    plain = block.matched(s), block.scores(s, every)
    monkeypatch.setattr(sc, "CROWDED", 64)
    monkeypatch.setattr(sc.Block, "spread", None)
    added = block.matched(s), block.scores(s, every)
    assert (plain[0][0] == added[0][0]).all() and plain[0][0].any() and not plain[0][0].all()
    assert (plain[0][1] == added[0][1]).all() and (plain[1] == added[1]).all()  # the same sums, bit by bit
