"""Thresholds of the language filter come from every learned document."""

import random

import numpy as np

from ranksmith.llm import langid


def test_thresholds_of_all_learned_documents(spark, monkeypatch):
    monkeypatch.setattr(langid, "SCORED_ROWS", 250, raising=False)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(60)) for _ in range(900)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    own, least = langid.thresholds(docs, model)
    _, score, weight = langid.classed_batch(texts, *model)
    n = {w: int((weight == w).sum()) for w in np.unique(weight)}
    full = min(score[weight == w].min() for w in n if n[w] >= langid.CLASS_ROWS)
    assert set(own) == set(n)
    for w in n:
        low = score[weight == w].min()
        assert abs(own[w] - langid.SHARE * (low if n[w] >= langid.CLASS_ROWS else min(low, full))) < 1e-9
    assert abs(least - langid.SHARE * score.min()) < 1e-9
