"""The index stores counted tokens once, not weights; norms of rare and frequent tokens."""

import collections
import math

from ranksmith.operators import index as ix
from ranksmith.operators import search as se
from ranksmith.plans import retrieve as rt


def test_norms_with_few_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(ix, "HOT_TOKENS", 2)
    texts = ["aa aa bb cc", "aa bb dd", "aa ee", "", "the aa"]
    corpus = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "item_id long, ordinal long, text string")
    t = ix.tfidf_index(corpus)
    df = collections.Counter(w for x in texts for w in set(x.split()) - {"the"})
    got = {(r.item_id, r.token): r.wn for r in t.postings.collect()}
    for i, x in enumerate(texts):
        w = {k: v * (math.log(6 / (df[k] + 1)) + 1) for k, v in collections.Counter(x.split()).items() if k != "the"}
        norm = math.sqrt(sum(v * v for v in w.values()))
        assert {k for j, k in got if j == i} == set(w)
        assert all(abs(got[i, k] - v / norm) < 1e-12 for k, v in w.items())


def test_forward_rows_hold_counts_only_and_repeated_ids_pair_up(spark):
    corpus = spark.createDataFrame([(1, 1, "n1", "aa bb"), (1, 1, "n1", "aa cc"), (2, 2, "n2", "dd"), (None, 3, "n3", "aa")],
                                   "item_id long, ordinal long, name string, text string")
    idx = rt.Indexes(corpus)
    assert set(idx.tfidf.forward.schema["wd"].dataType.elementType.names) == {"token", "tf"}
    ids = collections.Counter(r.item_id for r in idx.hybrid.forward.collect())
    assert ids == {1: 4, 2: 1}  # as a join of both indexes by id pairs them
    qs = spark.createDataFrame([(7, "dd")], "query_id long, question string")
    assert [r.item_id for r in se.tfidf_search(idx.tfidf, qs, corpus, 1).collect()] == [2]


def test_texts_are_cut_as_the_token_functions_do(spark):
    from pyspark.sql import functions as F

    from ranksmith.functions.text import tok_word2, tok_ws
    texts = ["", " ", "a", "Aa  bb CC dd　", "\x1cx\x1d\x85y z", "don't stop_me_now x9 éÉ 中文 中", "_ __ a_ 1 22",
             "İstanbul ẞ ΣΣ ß", "tab\tnew\nline\r\nend ", "\U0001d54fy \U0001d54f", "​q﻿", None]
    d = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "item_id long, ordinal long, text string")
    want = {r.item_id: r for r in d.select("item_id", tok_ws("text").alias("ws"), tok_word2("text").alias("w2"),
                                           F.size(F.coalesce(tok_ws("text"), F.array().cast("array<string>"))).alias("n")).collect()}
    rows = ix.token_rows(d, ["stop_me_now"])
    assert len(rows.collect()) == len(texts)
    for r in rows.collect():
        w = want[r.item_id]
        assert r.dl == (None if w.ws is None else w.n), texts[r.item_id]
        assert {x.token: x.tf for x in r.ws} == collections.Counter(w.ws or []), texts[r.item_id]
        assert {x.token: x.tf for x in r.tfs} == collections.Counter(x for x in w.w2 or [] if x != "stop_me_now"), texts[r.item_id]


def test_no_norms_for_the_vocabulary_alone(spark, monkeypatch):
    corpus = spark.createDataFrame([(1, 1, "n1", "aa bb"), (2, 2, "n2", "aa")], "item_id long, ordinal long, name string, text string")
    monkeypatch.setattr(ix, "_norms", None)
    idx = rt.Indexes(corpus)
    assert {r.token: r.df for r in idx.tfidf.vocab.collect()} == {"aa": 2, "bb": 1}


def test_a_block_spreads_its_tokens_once_for_hits_and_scores(spark, monkeypatch):
    from ranksmith.operators import scoring as sc
    corpus = spark.createDataFrame([(1, 1, "n1", "aa bb"), (2, 2, "n2", "aa"), (3, 3, "n3", "cc")],
                                   "item_id long, ordinal long, name string, text string")
    idx = rt.Indexes(corpus)
    forward = idx.hybrid.forward.toArrow().combine_chunks().to_batches()[0]
    s = next(sc.slices(spark.createDataFrame([(7, 0, "aa", 0.0, 2), (7, 0, "cc", 2.0, 1), (8, 0, "zz", 1.0, 0)],
                                             "query_id long, kind int, token string, w double, df long")))
    block = sc.Block(s, forward, idx.hybrid.impacts)
    calls, spread = [], sc.Block.spread
    monkeypatch.setattr(sc.Block, "spread", lambda *a: calls.append(1) or spread(*a))
    hit, score = (x.reshape(2, 3) for x in block.matched(s))
    at = {i: k for k, i in enumerate(forward.column("item_id").to_pylist())}
    # a token of weight 0 matches too
    assert [bool(hit[0, at[i]]) for i in (1, 2, 3)] == [True, True, True] and not hit[1].any()
    assert [score[0, at[i]] > 0 for i in (1, 2, 3)] == [False, False, True] and len(calls) == 1


def test_vocabularies_are_counted_where_texts_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ix, "PIECE_BYTES", 64)
    texts = ["aa bb aa", "the (cc-dd) cc", None, "", "aa x y b cc", "don't aa", "aa-aa bb", "\x1caa\x1f"]
    corpus = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "item_id long, ordinal long, text string").coalesce(1)
    rows = ix.token_rows(corpus)
    got = rows.collect()
    assert sum(1 for r in got if r.ws_df) > 1  # several pieces
    for column, listed in (("ws_df", "ws"), ("tfs_df", "tfs")):
        want = collections.Counter(x.token for r in got for x in r[listed])
        assert {r.token: r.df for r in ix._dfs(rows, column).collect()} == want and want
    monkeypatch.setattr(ix, "_postings", lambda d, *a: d.limit(0).selectExpr("null token"))  # no pass over the occurrences
    vocab = ix.bm25_index(corpus, rows=rows).vocab
    assert {r.token: r.df for r in vocab.collect()} == collections.Counter(x.token for r in got for x in r["ws"])
