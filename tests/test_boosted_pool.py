"""The full pipeline's pools without rows per (question, item)."""

import random

from ranksmith.operators import boost as bo
from ranksmith.plans import retrieve as rt

WORDS = ["the", "dog", "of", "la", "maison", "und", "katze", "house", "cat", "les", "und", "red"]


def _world(spark, n=60):
    rnd = random.Random(4)
    langs = ["EN", "FR", "DE"]
    docs = [(i, (i * 7) % n, f"{langs[i % 3]}_{'SRCX' if i % 4 == 0 else f'SRC{i % 5}'}_{i}" if i % 11 else "ODD",
             " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 12)))) for i in range(n)]
    corpus = spark.createDataFrame(docs, "item_id long, ordinal long, name string, text string")
    keys = spark.createDataFrame([(i, k, o) for i, o, _, _ in docs for k in ([f"s{i % 5}_id"] * (i % 2) + ["en_code"] * (i % 3 == 0))],
                                 "item_id long, key string, ordinal long")
    asked = [f"what of the {' '.join(rnd.choice(WORDS) for _ in range(4))} {x}" for x in
             ("srcx?", "en src1 21", "src2s", "", "see de srcx 8", "fr src1 1 and srcx")] + ["", "zzz", "srcx"]
    qs = spark.createDataFrame([(q, t) for q, t in enumerate(asked)] + [(None, "the dog"), (3, "red house")], "query_id long, question string")
    return rt.Indexes(corpus), qs, keys


def test_pools_are_those_of_all_pairs(spark, monkeypatch):
    idx, qs, keys = _world(spark)
    rules = rt.LANGUAGE_RULES + [bo.Rule("first", [" the ", " la "], "EN_SRCX_12", 0.9), bo.Rule("odd", [" red "], "ODD", 0.8)]
    assert idx.plain
    kept, plain = [], rt.stored
    monkeypatch.setattr(rt, "stored", lambda df, name: kept.append(name) or plain(df, name))

    def rows():
        return sorted(tuple(r) for r in rt.retrieve_full(idx, qs, keys, k=5, pool=6, rules=rules).collect())
    got = rows()
    assert got and not any("pairs" in name or name == "scores" for name in kept)
    idx._plain = False
    assert got == rows() and "bm25-pairs" in kept


def test_repeated_or_missing_ids_are_not_plain(spark):
    def plain(rows):
        return rt.Indexes(spark.createDataFrame([(i, o, "A_SRC1", "a b") for i, o in rows],
                                                "item_id long, ordinal long, name string, text string")).plain
    assert plain([(1, 1), (2, 2)]) and not plain([(1, 1), (1, 2)]) and not plain([(1, 1), (None, 2)]) and not plain([(1, None)])
