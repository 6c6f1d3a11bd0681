"""Operators against brute force, and their forms for hot groups."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ranksmith.llm import (decontam, html_text, knn_join, langid, links, lm_score, mixing, ngram_join, quality, repeats,
                           token_files)
from ranksmith.llm.hashing import words


@pytest.fixture(scope="module")
def near_copies(spark):
    """A group of near copies, a group of exact ones, and texts that share a
    passage only."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    base, passage = rnd.choices(vocab, k=120), rnd.choices(vocab, k=70)
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append(" ".join(w))
    rows += [" ".join(rnd.choices(vocab, k=rnd.randrange(1, 40))) for _ in range(40)]
    for _ in range(60):
        rows.append(" ".join(rnd.choices(vocab, k=rnd.randrange(0, 60)) + passage + rnd.choices(vocab, k=rnd.randrange(0, 60))))
    rows += [" ".join(base)] * 30 + ["a b", "a b", "A  B", "c", "", None]
    rnd.shuffle(rows)
    return spark.createDataFrame([(i * 3, t) for i, t in enumerate(rows)], "doc_id long, text string").cache()


def sets_of(pdf, width=3):
    out = {}
    for i, t in zip(pdf["doc_id"], pdf["text"]):
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def component_ids(sets, num=90, den=100):
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = links.union_find(pairs)
    return {i: root.get(i, i) for i in ids}


@pytest.mark.parametrize("list_rows", [20_000, 40])
def test_ngram_join_brute_force(near_copies, monkeypatch, list_rows):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", list_rows)  # 40: lists are dealt out in blocks
    sets = sets_of(near_copies.toPandas())
    want = component_ids(sets)
    got = ngram_join.link_documents(near_copies).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {
        i: (len(s), want[i]) for i, s in sets.items()}


def test_ngram_join_of_another_rule(spark, near_copies):
    """150 words, three changed far apart: 134 of 158 shingles of five words
    are shared, 140 of 156 of three, which 0.9 keeps apart."""
    rule = ngram_join.Rule(width=5, num=8, den=10)
    w = [f"w{i}" for i in range(150)]
    other = [f"x{i}" if i in (30, 75, 148) else v for i, v in enumerate(w)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(other)), (3, "another text of some words")],
                                 "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs, rule).collect()) == [1, 3]
    assert sorted(r.component_id for r in ngram_join.link_documents(docs).collect()) == [1, 2, 3]
    pdf = near_copies.toPandas()
    sets = {}
    for i, t in zip(pdf["doc_id"], pdf["text"]):
        v = (t or "").encode().lower().split()
        sets[i] = {tuple(v[k:k + 5]) for k in range(len(v) - 4)} if len(v) >= 5 else ({tuple(v)} if v else set())
    ids = sorted(sets)
    root = links.union_find([(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
                             if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(near_copies, rule).collect()}
    assert got == {i: root.get(i, i) for i in ids}


def brute_ce(texts, targets):
    words_ = {i: t.lower().split() for i, t in texts.items()}
    t = collections.Counter(w for i in targets for w in words_[i])
    ids = {i: ["<s>"] + [w if t[w] >= 2 else None for w in ws] for i, ws in words_.items()}
    size = 1 + sum(n >= 2 for n in t.values())

    def counts(docs):
        own = [ids[i] for i in docs]
        return (collections.Counter(w for x in own for w in x[1:]), collections.Counter(w for x in own for w in x[:-1]),
                collections.Counter(p for x in own for p in zip(x, x[1:])))

    one_t, his_t, two_t = counts(targets)
    one_b, his_b, two_b = counts(texts)
    n = sum(one_t.values())
    s = n / sum(one_b.values())

    def loss(c1, h, c2, s, v, w):
        return -np.log((s * c2[v, w] + 5 * (s * c1[w] + 0.5) / (n + 0.5 * size)) / (s * h[v] + 5))

    return {i: np.mean([loss(one_t, his_t, two_t, 1, *p) - loss(one_b, his_b, two_b, s, *p) for p in zip(x, x[1:])])
            for i, x in ids.items()}


@pytest.mark.parametrize("slot_words", [2_000_000, 500])
def test_lm_score_keeps_all_words(spark, monkeypatch, slot_words):
    """The vocabulary holds all words of the target's, however many."""
    monkeypatch.setattr(lm_score, "MAX_WORDS", 20, raising=False)
    monkeypatch.setattr(lm_score, "SLOT_WORDS", slot_words)
    rnd = random.Random(3)
    texts = {i: " ".join(f"w{int(300 * rnd.random() ** 3)}" for _ in range(rnd.randrange(1, 60))) for i in range(200)}
    targets = [i for i in texts if i % 3 == 0]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = lm_score.score(docs, spark.createDataFrame([(i,) for i in targets], "doc_id long")).collect()
    want = brute_ce(texts, targets)
    assert len(got) == len(want)
    assert max(abs(r["ce_difference"] - want[r["doc_id"]]) for r in got) < 2e-6


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1500)]
    got = links.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(301)}, **{k: 1000 for k in range(1000, 1500)}}


def brute_repeats(texts, length):
    seen = collections.Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                mark[k] += 1
                mark[k + length] -= 1
        gone = np.cumsum(mark)[:len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket_rows", [512, 5])
def test_repeats_brute_force(near_copies, spark, bucket_rows):
    more = ["ab" * 300, "x" * 500, "é" * 100 + "y", "abcabc" * 20 + "q" * 90]
    df = near_copies.unionAll(spark.createDataFrame(list(enumerate(more, 10_001)), "doc_id long, text string"))
    pdf = df.toPandas().sort_values("doc_id")
    want = brute_repeats([(t or "").encode() for t in pdf["text"]], 100)
    got = repeats.remove_repeats(df, length=100, gram=16, bucket_rows=bucket_rows).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == want
    assert all(r.n_kept == r.n_bytes - r.n_removed for r in got)


def test_repeats_of_equal_rows_stay_linear(spark):
    """5,000 equal rows, and a text that shares part of them: every row asks
    for its spans once."""
    rnd = random.Random(4)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(700))
    other = "other " + text[1000:3000] + " end"
    rows = [(1, text)] * 5000 + [(2, other), (3, "short"), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = repeats.repeated_windows(df).where("doc_id = 1").distinct()
    assert spans.count() < 5000
    got = collections.Counter((r.doc_id, r.n_removed, r.n_kept) for r in repeats.remove_repeats(df).collect())
    assert got == {(1, len(text), 0): 5000, (2, 2000, len(other) - 2000): 1, (3, 0, 5): 2}


def test_anchor_rows_cut_in_pieces():
    rnd = np.random.default_rng(3)
    data = rnd.integers(0, 3, 5000).astype(np.uint8)
    off = np.array([0, 700, 700, 4000, 5000])
    whole = repeats.anchor_rows(data, off, 60, 8)
    cut = repeats.anchor_rows(data, off, 60, 8, piece=333)
    windows = lambda rows: {(d, q): (k, p) for d, k, _, p, a, b in zip(*(r.tolist() for r in rows)) for q in range(a, b + 1)}
    assert windows(whole) == windows(cut) and len(windows(whole)) == 641 + 3241 + 941


def test_knn_brute_force(spark):
    rnd = np.random.default_rng(1)
    m = rnd.normal(size=(700, 16)) * rnd.uniform(0.1, 3, size=(700, 1))
    m[300:520] = m[300]  # a hot vector
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    z = np.floor(64 * m)
    s = z @ z.T
    want = []
    for q in range(0, 700, 20):
        order = sorted((x for x in range(700) if x != q), key=lambda x: (-s[q, x], x))[:20]
        want += [(q, k, x, int(s[q, x])) for k, x in enumerate(order, 1)]
    old = knn_join.BLOCK_ROWS, knn_join.QUERY_ROWS
    knn_join.BLOCK_ROWS, knn_join.QUERY_ROWS = 32, 8
    try:
        got = knn_join.top_k(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    finally:
        knn_join.BLOCK_ROWS, knn_join.QUERY_ROWS = old
    assert [tuple(r) for r in got] == want


ITEM = "If Alice Brown buys 12 apples for 3 dollars, how many dollars does Alice Brown pay for 40 apples today?"


def test_templates(spark):
    items = decontam.Items([(7, ITEM), (8, "Short item"), (9, "the sum of two numbers is 15 and their difference is 3 so what are they")])
    one = lambda t: list(items.matches(t))
    assert one("Intro here. " + ITEM + " More text.") == [(7, 16, 16, 0, True)]
    assert one(ITEM.upper())[0][0] == 7
    other = ITEM.replace("Alice Brown", "Bob Stone").replace("12", "15").replace("3 dollars", "7 euros").replace(
        "many dollars", "many euros").replace("40", "95")
    assert [(m[0], m[3] > 0, m[4]) for m in one("Well. " + other)] == [(7, True, False)]
    # one name of the item stands for two in the text
    assert not one(other.replace("does Bob Stone", "does Eve Stone"))
    assert one("short item!")[0][0] == 8 and not one("a short item here")
    assert not one("If many people buy apples for a few dollars, how many of them pay today?")


def test_names_at_sentence_starts():
    text = "Tom bought 12 apples. Tom gave 3 to Anna. Tom ate 2 more. How many apples does Tom have left?"
    items = decontam.Items([(1, text)])
    found = lambda t: [m[0] for m in items.matches(t)]
    assert list(items.matches(text)) == [(1, 16, 16, 0, True)]
    assert found(text.replace("Tom", "Sam")) == [1]
    assert found("Some words. " + text.replace("Tom", "Sam").replace("12", "15") + " Others follow.") == [1]
    # one name of the item stands for two in the text
    assert found(text.replace("Tom gave", "Eve gave").replace("Tom", "Sam")) == []


def test_fillers_of_other_lengths():
    text = ("If Alice Brown travels from New York with 20 sealed boxes and sells every one of them for 3 dollars "
            "before noon then how many dollars does Alice Brown bring back to New York that evening")
    passage = [f"p{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(40)]
    items = decontam.Items([(1, text), (2, " ".join(passage))])
    found = lambda t: [m[0] for m in items.matches(t)]
    assert found("Well: " + text.replace("Alice Brown", "Bob").replace("20", "twenty five").replace("New York", "Paris")) == [1]
    for other in (passage[:20] + ["inserted"] + passage[20:], passage[:20] + passage[21:]):
        (m,) = items.matches("before " + " ".join(other) + " after")
        assert m[0] == 2 and m[1] >= 0.8 * 36 and not m[4]
    # the parts in another order, or far from each other, are not the passage
    assert not found(" ".join(passage[20:] + passage[:20]))
    assert not found(" ".join(passage[:20] + [f"x{i}y" for i in range(60)] + passage[20:]))


def test_numbers_that_become_equal():
    text = "Tom bought 3 apples and 5 pears at the market and then gave half of all of them to his sister Anna"
    items = decontam.Items([(1, text)])
    found = lambda t: [m[0] for m in items.matches(t)]
    assert found(text.replace("3", "4").replace("5", "6")) == [1]
    assert found("Here: " + text.replace("3", "4").replace("5", "4") + " End.") == [1]
    # one number of the item may not become two, nor two names one
    twice = text.replace("5 pears", "3 pears")
    assert [m[0] for m in decontam.Items([(1, twice)]).matches(twice.replace("3 apples", "8 apples"))] == []
    names = text.replace("sister Anna", "sister Anna and Bob and Tom") + " when Anna asked"
    items = decontam.Items([(1, names)])
    assert found(names) == [1] and found(names.replace("Anna", "Eve")) == [1]
    assert found(names.replace("Anna", "Bob")) == []


CHINESE = "小明在市场上买了12个苹果和3个梨子，然后把其中的一半送给了他的妹妹，请问小明现在还剩下多少个水果可以带回家给妈妈吃呢"
JAPANESE = "太郎さんは市場でりんごを十二個買いました。そのあと妹に半分をあげました。太郎さんはいくつのりんごを持っていますか。"
THAI = "สมชายซื้อแอปเปิ้ลสิบสองลูกที่ตลาดแล้วให้น้องสาวครึ่งหนึ่งตอนนี้สมชายมีแอปเปิ้ลกี่ลูก"


@pytest.mark.parametrize("item", [CHINESE, JAPANESE, THAI])
def test_items_without_spaces(item):
    items = decontam.Items([(1, "an item of some other words that are not here"), (2, item)])
    found = lambda t: [m[0] for m in items.matches(t)]
    other = "这是一个完全不同的句子，里面没有任何基准测试的内容，只是一些普通的中文文字而已。"
    assert found(item) == [2] and found(other + item + other) == [2]
    assert found("Some English words, then " + item[:40] + "\n" + item[40:] + " and more English words.") == [2]
    assert found(other * 5) == [] and found(other + item[:len(item) // 2] + other) == []
    half = len(item) // 2
    assert found(item[half:] + other + item[:half]) == []
    if "12" in item:
        assert [m[3:] for m in items.matches(other + item.replace("12", "345"))] == [(1, False)]


def test_no_break_spaces():
    item = "The quick brown fox jumps over a lazy dog and then runs far away"
    items = decontam.Items([(1, item.replace(" ", "\u00a0"))])
    assert [m[0] for m in items.matches("So: " + item + " again")] == [1]
    items = decontam.Items([(1, item)])
    assert [m[0] for m in items.matches("Então:\u2003" + item.replace(" ", "\u00a0"))] == [1]


def brute_holds(item, doc):
    """Whether some alignment of the whole texts covers the item: windows
    compared word by word, no hashes and no index."""
    def template(text):
        _, slot, words = decontam.template(text)
        slot = [0 if s == decontam.FIRST else int(s) for s in slot]
        return slot, [w.strip(decontam._OUTER).lower() for w in words]

    (si, wi), (sd, wd) = template(item), template(doc)
    n = len(wi) - 4
    for shift in range(-len(wi), len(wd)):
        held = []
        for p in range(n):
            q = p + shift
            if q < 0 or q + 5 > len(wd):
                continue
            typed = all(a == b and (a or x == y) for a, b, x, y in zip(si[p:p + 5], sd[q:q + 5], wi[p:p + 5], wd[q:q + 5]))
            if typed or wi[p:p + 5] == wd[q:q + 5] and any(si[p:p + 5]) and any(sd[q:q + 5]):
                held.append(p)
        if len(held) < 0.8 * n:
            continue
        places = sorted({p + k for p in held for k in range(5)})
        to, back, ok = {}, {}, True
        for p in places:
            if si[p]:
                ok &= to.setdefault((si[p], wi[p]), wd[p + shift]) == wd[p + shift]
                if si[p] == decontam.NAME:
                    ok &= back.setdefault(wd[p + shift], wi[p]) == wi[p]
        if ok:
            return True
    return False


def test_decontamination_brute_force(spark):
    rnd = random.Random(11)
    vocab = [a + b + c for a in "bdgk" for b in "aeio" for c in "lmnr"]

    def sentence(names, numbers):
        w = [rnd.choice(vocab) for _ in range(14)]
        w[3], w[6], w[9], w[11] = names[0], numbers[0], numbers[1], names[1]
        w[13] = names[0]
        return " ".join(w)

    items = [sentence(("Tom", "Anna"), ("12", "30")) for _ in range(12)]
    docs = []
    for k in range(150):
        t = rnd.choice(items)
        for a, b in (("Tom", rnd.choice(["Tom", "Sam", "Anna"])), ("12", rnd.choice(["12", "30", "7"])), ("Anna", rnd.choice(["Anna", "Eve"]))):
            t = t.replace(a, b)
        w = t.split()
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append(" ".join(rnd.choices(vocab, k=rnd.randrange(6)) + w + rnd.choices(vocab, k=rnd.randrange(6))))
    docs += [" ".join(rnd.choices(vocab, k=30)) for _ in range(20)]
    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if brute_holds(t, d)}
    got = decontam.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
                        spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and 20 < len(want) < 150


def test_decontamination_slices(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_ITEMS", 3)
    texts = [" ".join(f"t{i}x{k}" for k in range(12)) for i in range(10)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(100 + i, "before. " + t + " after") for i, t in enumerate(texts)] + [(1, "clean text")],
                                 "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find(docs, items).collect()) == [(100 + i, i) for i in range(10)]
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [1]


def test_language_accuracy(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95


def naive_vector(text, dim=langid.DIM):
    """A text's bundle, gram by gram."""
    out = np.zeros(dim, np.int64)
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        codes = [0, *map(ord, word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            v = [langid.letter_vector(x, dim).astype(np.int64) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


def naive_scores(pdf):
    """(vectors, languages, cosines) of rows with doc_id, text and lang."""
    vec = np.array([naive_vector(t) for t in pdf["text"]], float)
    own = [zlib.crc32(str(i).encode()) % 5 != 0 and t is not None and x is not None
           for i, t, x in zip(pdf["doc_id"], pdf["text"], pdf["lang"])]
    names = sorted({x for x, o in zip(pdf["lang"], own) if o})
    proto = np.array([vec[[o and x == n for x, o in zip(pdf["lang"], own)]].sum(0) for n in names])
    norms = np.linalg.norm(vec, axis=1)
    cos = vec @ (proto / np.linalg.norm(proto, axis=1)[:, None]).T / np.where(norms > 0, norms, 1)[:, None]
    return vec, names, cos, np.array(own)


def test_language_brute_force(spark, sf_small):
    pdf = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60).toPandas()
    pdf = pd.concat([pdf, pd.DataFrame({"doc_id": [-1, -2], "text": ["12 !", None], "lang": [None, None]})], ignore_index=True)
    pdf = pdf.astype(object).where(pdf.notna(), None)
    _, names, cos, _ = naive_scores(pdf)
    rows = spark.createDataFrame([(int(i), t, x) for i, t, x in zip(pdf["doc_id"], pdf["text"], pdf["lang"])],
                                 "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(rows).collect()}
    for i, t, c in zip(pdf["doc_id"], pdf["text"], np.round(cos, 9)):
        if t is None or not any(map(str.isalpha, t)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert got[i].lang_pred == names[int(c.argmax())] and abs(got[i].score - max(0, c.max())) < 1e-8


def brute_identified(pdf):
    """Ids that the language stage keeps, where no class of sizes is full."""
    vec, names, cos, own = naive_scores(pdf)
    size = np.floor(np.log2(np.maximum((vec ** 2).sum(1) / langid.DIM, 1))).astype(int)
    score = np.clip(np.round(cos.max(1), 9), 0, 1)
    letters = np.array([any(map(str.isalpha, t or "")) for t in pdf["text"]])
    low = {}
    for c in set(size[own & letters]):  # of so few rows the quantile is the least one
        low[c] = 0.5 * score[own & letters & (size == c)].min()
    return {i for i, s, c, a in zip(pdf["doc_id"], score, size, letters) if a and s >= low.get(c, min(low.values()))}


def test_thresholds_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "CLASS_ROWS", 100)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(130)
    rnd = random.Random(4)
    bad = spark.createDataFrame([(10**9 + i, "".join(rnd.choice("abcdefghijkl mnopqrstuvwxyz ") for _ in range(3000)), None, "x", 1)
                                 for i in range(5)], docs.schema)
    docs = docs.unionAll(bad)
    pdf = docs.toPandas()
    pdf = pdf.astype(object).where(pdf.notna(), None)
    want = brute_identified(pdf)
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == want and len(want) < len(pdf)


def test_gibberish_is_not_identified(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(2)
    say = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    bad = spark.createDataFrame([(10**9 + i, say(rnd.randrange(50, 2000)), None, "x", 1) for i in range(60)], docs.schema)
    kept = [r.doc_id for r in langid.keep_identified(docs.unionAll(bad)).select("doc_id").collect()]
    assert sum(i >= 10**9 for i in kept) <= 15  # three quarters go where 800 documents were learned
    assert sum(i < 10**9 for i in kept) >= 0.995 * docs.count()


def test_bound_vectors():
    at, gram, cnt, letters = langid.grams(["Aab", "x1y", None])
    text = ["".join(chr(letters[g // len(letters) ** k % len(letters)]) for k in (2, 1, 0)) for g in gram]
    assert sorted(zip(at.tolist(), text, cnt.tolist())) == [
        (0, "\0aa", 1), (0, "aab", 1), (0, "ab\0", 1), (1, "\0x\0", 1), (1, "\0y\0", 1)]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()


def test_forward_backward():
    rnd = np.random.default_rng(0)
    doc = np.array([0, 0, 0, 1, 2, 2])
    e, t = rnd.normal(size=6), rnd.normal(size=(2, 2))
    p, _, _ = quality.Chains(doc).marginals(e, t)
    for d in range(3):
        own = np.flatnonzero(doc == d)
        total = np.zeros(2 ** len(own))
        good = np.zeros((len(own), 2 ** len(own)))
        for k in range(2 ** len(own)):
            y = [(k >> j) & 1 for j in range(len(own))]
            total[k] = np.exp(sum(e[i] * y[j] for j, i in enumerate(own)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            good[:, k] = y
        assert np.allclose(p[own], good @ total / total.sum())


def test_line_features():
    f, doc, length = quality.line_features(pa.array(["a a b\nLOUD!!", None, "", "x\n"]))
    assert doc.tolist() == [0, 0, 1, 2, 3, 3] and length.tolist() == [5, 6, 0, 0, 1, 0]
    assert f.shape[1] == quality.N_FEATURES and np.isclose(f[0, 6], 1 / 3) and f[1, 1] == 1


def test_html_trees():
    page = ('<body class="page-with-sidebar"><header>Site<nav><a href=1>m</a></nav></header><div id="wrap"><div class="post">'
            '<h1>Title &amp; more</h1><p>First, long paragraph, with some <b>bo</b>ld words in it, and<br>a break.'
            '<p>Second one, unclosed, with text enough to be a paragraph<div class="share-links">tweet</div>'
            '<ul><li><a>x</a></li><li><a>y</a></li></ul></div><aside>side</aside>'
            '<div id="comments"><p>I like it, really, very, very much, thanks for this.</p></div></div>'
            '<form>mail</form><footer>foot</footer><script>"</p>"</script></body>')
    assert html_text.main_text(page) == (
        "Title & more First, long paragraph, with some bold words in it, and a break. "
        "Second one, unclosed, with text enough to be a paragraph")


@pytest.mark.parametrize("seed", range(4))
def test_flow_is_largest_and_cheapest(seed):
    rnd = random.Random(seed)
    supply = [rnd.randrange(1, 30) for _ in range(6)]
    members = [sorted(rnd.sample(range(4), rnd.randrange(1, 4))) for _ in range(6)]
    quota = [rnd.randrange(0, 60) for _ in range(4)]
    flow = mixing.min_cost_flow(supply, members, quota, 2)
    for p, f in enumerate(flow):
        assert set(f) == set(members[p]) and 0 <= sum(f.values()) <= 2 * supply[p]
    assert all(sum(f.get(s, 0) for f in flow) <= quota[s] for s in range(4))

    def largest(times):  # by the smallest cut over sets of sources
        return min(sum(quota[s] for s in range(4) if not k >> s & 1)
                   + sum(times * supply[p] for p in range(6) if any(k >> s & 1 for s in members[p])) for k in range(16))

    taken = [sum(f.values()) for f in flow]
    assert sum(taken) == largest(2)
    assert sum(min(t, s) for t, s in zip(taken, supply)) == largest(1)  # repeats only what must be


def test_targets():
    # the second is full at 20; the other 220 go 5 : 1
    assert np.allclose(mixing.share_out([100, 10, 50], [5, 2, 1], 240, 2), [220 * 5 / 6, 20, 220 / 6])
    assert mixing.share_out([], [], 0, 2) == [] and mixing.share_out([0, 0], [5, 2], 0, 2) == [0, 0]


def test_mix_near_targets(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    a, b = (sorted(map(tuple, mixing.mix_documents(docs.repartition(n)).collect())) for n in (1, 5))
    assert a == b
    pdf = pd.DataFrame(a, columns=["doc_id", "size", "source_size", "target", "taken", "source"])
    by = pdf.groupby("source").agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"),
                                   taken=("taken", "sum"))
    assert (by["size"] == by["given"]).all() and (abs(by["taken"] / by["target"] - 1) < 0.02).all()
    assert np.isclose(by["target"].sum(), 1.5 * by["size"].sum()) and (pdf["taken"] <= 2 * pdf["size"]).all()


def test_overlapping_sources(spark):
    rows = [(i, f"{'w ' * (1 + i % 5)}", ["a"] if i % 3 else ["b", "a", "a", None]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    sized = mixing.with_size(docs, F.col("s"), mixing.word_count("text"))
    plan = mixing.mix(sized, lambda names, sizes: [sizes[0] * 0.5, sizes[1] * 0.25, 10.0])
    got = plan.repeats(sized).toPandas()
    size_b = got.loc[got["doc_id"] % 3 == 0, "_size"].sum()
    assert abs((got["_size"] * got["_repeats"]).sum() - (0.5 * got["_size"].sum() + 0.25 * size_b + 10)) <= 6


ODD = ["", " ", "a  b", "a b ", "\nx", "x\n\ny z", "a\tb c", "tab\t x", "it's we'll, x's.", "<|endoftext|> a <|endoftext|>b.",
       "1,234.5 km/h.", "é è. ñ!!", "a b  c", "x\r\ny z", "漢字 漢字。 a", "a .b ..c", "w. \nq", "end.\n", "| a |b", "\x1c \x85"]


def test_token_encoder_equals_library():
    enc = token_files.MemoEncoder(token_files.byte_bpe_path(), True)
    for _ in range(2):
        got = enc.encode(ODD)
        assert got == [np.array(enc.tok.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in ODD]


def test_token_files_round_trip(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect())
    tok = token_files.MemoEncoder(token_files.byte_bpe_path(), True).tok
    want, start = [], 0
    for r in rows:
        ids = np.array(tok.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.token_digest(spark, docs.repartition(3)).collect())) == want


def test_pipeline(spark, sf_small):
    """Each stage against its rule, on its own input."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    pdf = docs.toPandas()
    told = langid.keep_identified(docs).toPandas()["doc_id"]
    assert set(told) == {i for i, t in zip(pdf["doc_id"], pdf["text"]) if any(map(str.isalpha, t))}  # 200 rows reject nothing
    pdf = pdf[pdf["doc_id"].isin(told)]
    root = component_ids(sets_of(pdf, 5), 8, 10)
    pdf = pdf[[root[i] == i for i in pdf["doc_id"]]]
    items = spark.read.parquet(f"{sf_small}/benchmark.parquet").toPandas()
    low = [t.lower() for t in items["text"]]
    pdf = pdf[[not any(t in x.lower() for t in low) for x in pdf["text"]]]
    kept = spark.createDataFrame(pdf[["doc_id", "text", "lang", "source", "n_chars"]])
    taken = mixing.mix_documents(kept).toPandas()
    times = {i: t // s for i, t, s in zip(taken["doc_id"], taken["taken"], taken["size"]) if s}
    got = collections.Counter(r["doc_id"] for r in cp.run(spark, sf_small).collect())
    assert got == {i: n for i, n in times.items() if n}


def test_word_hashes():
    a, at = words(np.frombuffer("The cat\tTHE\n".encode() + "the caT".encode(), np.uint8), np.array([0, 12, 19]))
    assert a[0] == a[2] == a[3] and a[1] == a[4] and len(set(a.tolist())) == 2 and at.tolist() == [0, 0, 0, 1, 1]


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "post-footer", "nav-content", "cookie-notice", "ad", "ads-box", "adSlot",
                                  "widget-content", "newsletter-signup", "comments", "comment-body", "reader_comments", "related-posts",
                                  "share-buttons", "breadcrumbs", "main-menu", "topbar", "promo-text", "login-form", "page-header"])
def test_html_names_of_other_parts(name):
    text = "A paragraph, with commas, and enough words to be taken for the article, if nothing else told."
    for attr in (f'class="{name}"', f'id="{name}"'):
        page = (f'<body><div class="layout"><div {attr}><p>{text * 3}</p></div><div class="story has-sidebar"><div class="post-header">'
                f'<h1>Head</h1></div><p>Real, first, paragraph of it.</p><p>Real, second, one.</p></div></div></body>')
        assert html_text.main_text(page) == "Head Real, first, paragraph of it. Real, second, one."
