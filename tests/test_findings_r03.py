"""Steps that grew faster than their input, or ran one by one."""

import random
import threading
import time

import pandas as pd
from pyspark.sql import functions as F

from ranksmith.operators import boost as bo
from ranksmith.operators import ltr
from ranksmith.operators.features import FEATURE_NAMES
from ranksmith.streaming.first import FirstPerKey


def test_name_boost_makes_pairs_last(spark):
    """Each pair once, without a shuffle above the join that makes it."""
    corpus = spark.createDataFrame([(i, i, f"EN_SRC1_{i}") for i in range(40)], "item_id long, ordinal long, name string")
    qs = spark.createDataFrame([(q, f"see en src1 {q} src1s") for q in range(20)], "query_id long, question string")
    mentions = bo.mention_pairs(qs, corpus)
    out = bo.name_boost(qs, corpus, mentions)
    rows = {(r.query_id, r.item_id): r.name_boost for r in out.collect()}
    named = {(r.query_id, r.item_id) for r in mentions.collect()}
    assert named == {(q, i) for q in range(20) for i in range(40) if str(q).startswith(str(i))}
    assert out.count() == 800 and rows == {(q, i): 2.0 if (q, i) in named else 1.5 for q in range(20) for i in range(40)}
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_folds_are_fitted_at_the_same_time(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(g, i, *(rnd.random() for _ in FEATURE_NAMES), float(i == 0)) for g in range(12) for i in range(4)]
    train = spark.createDataFrame(rows, "group_id long, item_id long, " + ", ".join(f"{c} double" for c in FEATURE_NAMES) + ", label double")
    monkeypatch.setattr(ltr, "MODEL_PARAMS", {"gradient_boosting": dict(maxIter=1, maxDepth=1, seed=1),
                                              "random_forest": dict(numTrees=1, maxDepth=1, seed=1)})
    one_by_one = threading.Lock()
    running, most, fit = [0], [0], ltr.fit

    def watched(*a, **k):
        with one_by_one:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(1)
        try:
            return fit(*a, **k)
        finally:
            with one_by_one:
                running[0] -= 1
    monkeypatch.setattr(ltr, "fit", watched)
    got = ltr.cross_validate(train, "gradient_boosting", 3).orderBy("fold").collect()
    assert [r.fold for r in got] == [0, 1, 2] and most[0] > 1
    assert [r.fold for r in ltr.cross_validate(train, "random_forest", 2).orderBy("fold").collect()] == [0, 1]


class _Handle:
    def __init__(self):
        self.calls, self.kept = 0, []

    def getValueState(self, *_):
        return self

    getListState = getMapState = getValueState

    def exists(self):
        return False

    def containsKey(self, _):
        self.calls += 1
        return False

    def updateValue(self, *_):
        self.calls += 1

    def appendList(self, rows):
        self.calls += 1
        self.kept += rows

    def registerTimer(self, _):
        self.calls += 1


def test_state_is_written_once_per_key_and_batch():
    h = _Handle()
    p = FirstPerKey(10)
    p.init(h)
    rows = pd.DataFrame({"us": [5000, 1000, 5000, 9000] * 50, "ord": range(200), "record": [str(i) for i in range(200)]})
    list(p.handleInputRows(("k",), iter([rows]), None))
    assert h.calls == 2 and h.kept == [(1000, 1, "1"), (5000, 0, "0"), (9000, 3, "3")]
