"""Distinct neighbours, greedy folds, propagation beyond the pool, summary."""

import collections
import random

import numpy as np
import pytest

from ranksmith.operators import boost as bo
from ranksmith.operators import catalog as cg
from ranksmith.operators import ltr
from ranksmith.operators import telemetry as tm


@pytest.mark.parametrize("most", [10, 2])
def test_neighbours_brute_force(spark, monkeypatch, most):
    """Each neighbour once, also through several keys; 2: most patterns are
    joined instead of counted by subsets."""
    monkeypatch.setattr(cg, "MOST_SUBSETS_OF", most)
    rnd = random.Random(most)
    keys = [f"K{i}_KEY" for i in range(7)]
    held = {f"T{t}": set(rnd.sample(keys, rnd.randrange(0, 6))) for t in range(60)}
    held |= {"LONE": {"ONLY_KEY"}, "NONE": set()}
    rows = [(t, c, "NUMBER", i) for t, ks in held.items() for i, c in enumerate(sorted(ks) + ["NAME"])]
    cols = spark.createDataFrame(rows, "table_name string, column_name string, column_type string, ordinal int")
    got = {r.table_name: r.num_neighbours for r in cg.relation_counts(cols).collect()}
    assert got == {t: sum(bool(ks & other) for o, other in held.items() if o != t) for t, ks in held.items()}


@pytest.mark.parametrize("seed", range(6))
def test_greedy_folds_brute_force(seed):
    rnd = random.Random(seed)
    sizes = sorted((rnd.choice([1, 1, 2, 3, 25, 25, 26, 400, rnd.randrange(1, 900)]) for _ in range(rnd.randrange(1, 300))), reverse=True)
    k = min(rnd.choice([1, 2, 5, 7]), len(sizes))
    classes = collections.Counter(sizes)
    before = ltr.loads_by_size(list(classes.items()), k)
    loads, at, want = [0] * k, collections.Counter(), []
    for n in sizes:  # each to the lightest fold, one after another
        if not at[n]:
            assert before[n].tolist() == loads
        f = loads.index(min(loads))
        assert ltr.deal(before[n], n, np.array([at[n]]))[0] == f
        want.append(f)
        loads[f] += n
        at[n] += 1


def test_folds_of_uneven_groups(spark):
    rnd = random.Random(9)
    sizes = {g: rnd.choice([1, 2, 2, 3, 40, 300]) for g in range(90)}
    train = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "group_id long")
    fold = {r.group_id: r.fold for r in ltr.group_kfold(train, 5).collect()}
    loads = [0] * 5
    for n, g in sorted((-n, g) for g, n in sizes.items()):
        f = loads.index(min(loads))
        assert fold[g] == f
        loads[f] -= n
    few = ltr.group_kfold(spark.createDataFrame([(1,), (2,), (2,)], "group_id long"), 5).collect()
    assert {r.group_id: r.fold for r in few} == {2: 0, 1: 1}


def test_propagation_reaches_beyond_the_pool(spark):
    """The best item lifts a scored neighbour that 30 others outrank, and its
    hub tells the lift of a neighbour without a score."""
    scores = spark.createDataFrame([(1, 0, 3.0)] + [(1, i, 0.9 - i / 100) for i in range(1, 40)], "query_id long, item_id long, score double")
    keys = spark.createDataFrame([(0, "K", 0), (39, "K", 39), (77, "K", 77)], "item_id long, key string, ordinal long")
    got = {r.item_id: r.score for r in bo.graph_propagate(scores, keys).collect()}
    assert len(got) == 40 and abs(got[39] - 1.2) < 1e-9 and got[38] == pytest.approx(0.52)
    (hub,) = bo.push_hubs(scores, keys).collect()
    assert (hub.query_id, hub.key) == (1, "K") and hub.lift == pytest.approx(1.2)


def test_summary_of_no_requests(spark):
    events = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    r = tm.metrics_summary(tm.requests_from_events(events)).first()
    assert r.total_requests == r.total_errors == r.n_endpoints == 0 and r.error_rate == r.avg_confidence == 0.0
    assert r.endpoints == [] and r.latency_p50_ms == [] and r.expansion_ms == 0.0
