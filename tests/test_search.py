import math

from ranksmith.operators import index as ix
from ranksmith.operators import search as se
from ranksmith.plans import retrieve as rt

DOCS = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "the the the", "",
        "birds fly high", "the cat"]
QS = [(1, "the cat"), (2, "cat cat dog"), (3, "zebra"), (4, "the")]


def bm25_python(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = [d.lower().split() for d in docs]
    n = len(toks)
    avgdl = sum(len(t) for t in toks) / n
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (eps * mean if v < 0 else v) for w, v in idf.items()}
    out = []
    for t in toks:
        s = 0.0
        for q in query.lower().split():
            tf = t.count(q)
            s += idf.get(q, 0.0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avgdl))
        out.append(s)
    return out


def corpus(spark):
    return spark.createDataFrame([(i, i, f"D_{i}", d) for i, d in enumerate(DOCS)],
                                 "item_id long, ordinal long, name string, text string")


def test_bm25_matches_python_with_fill(spark):
    c = corpus(spark)
    q = spark.createDataFrame(QS, "query_id long, question string")
    res = se.bm25_search(ix.bm25_index(c), q, c, k=5).collect()
    for qid, text in QS:
        scores = bm25_python(DOCS, text)
        order = sorted(range(len(DOCS)), key=lambda i: (-round(scores[i], 9), i))[:5]
        got = sorted([r for r in res if r.query_id == qid], key=lambda r: r.rank)
        assert [r.item_id for r in got] == order, (qid, got, order)
        for r in got:
            assert math.isclose(r.score, round(scores[r.item_id], 6), abs_tol=1e-6)


def test_minmax_all_equal_and_no_match(spark):
    c = corpus(spark)
    q = spark.createDataFrame([(3, "zebra")], "query_id long, question string")
    idx = rt.Indexes(c, materialize=False)
    out = rt.hybrid_pool(idx, q, 3).orderBy("rank").collect()
    assert [r.item_id for r in out] == [0, 1, 2]      # no match: lowest ordinals, score 0
    assert all(r.score == 0.0 for r in out)


def test_corpus_smaller_than_k(spark):
    c = corpus(spark).limit(2)
    q = spark.createDataFrame([(1, "the cat")], "query_id long, question string")
    out = se.bm25_search(ix.bm25_index(c), q, c, k=10).collect()
    assert len(out) == 2


def test_topk_exact_with_negative_scores(spark):
    """The mean idf is negative here, so matches score below the unmatched
    items, which are not the lowest-ordinal ones."""
    docs = spark.createDataFrame([(i, i, f"n{i}", "a b" if i < 20 else "zz") for i in range(23)],
                                 "item_id long, ordinal long, name string, text string")
    from ranksmith.plans.retrieve import Indexes
    idx = Indexes(docs)
    q = spark.createDataFrame([(1, "a"), (2, "nothing"), (3, "zz a b")], "query_id long, question string")
    got = {}
    for r in se.bm25_search(idx.bm25, q, docs, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    assert [i for i, _ in got[1]] == [20, 21, 22] and {s for _, s in got[1]} == {0.0}
    assert [i for i, _ in got[2]] == [0, 1, 2]
    assert [i for i, _ in got[3]] == [20, 21, 22] and all(s > 0 for _, s in got[3])
    # all matched, fewer than k unmatched
    all_k = se.bm25_search(idx.bm25, q.filter("query_id = 1"), docs, 23).collect()
    assert [r["item_id"] for r in sorted(all_k, key=lambda r: r["rank"])] == [20, 21, 22, *range(20)]
