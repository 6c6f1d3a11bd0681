import pytest

from ranksmith.operators import boost as bo
from ranksmith.operators import search as se


def corpus(spark):
    names = ["FCLT_BUILDING", "FCLT_ROOMS", "SIS_DEPARTMENT", "TIP_DETAIL"]
    return spark.createDataFrame([(i, i, n, n.lower()) for i, n in enumerate(names)],
                                 "item_id long, ordinal long, name string, text string")


def test_rule_boost_grammar(spark):
    c = corpus(spark)
    q = spark.createDataFrame([(1, "Which building has most rooms?"), (2, "building history please"),
                               (3, "isbn of the textbook")], "query_id long, question string")
    rules = [
        bo.Rule("fam", ["building", "room"], "FCLT_", 0.3, match="prefix"),
        bo.Rule("two", ["building"], "FCLT_ROOMS", 1.0, any_of_2=["rooms"]),
        bo.Rule("excl", ["building"], "SIS_DEPARTMENT", 0.5, none_of=["history"]),
        bo.Rule("or", ["isbn"], "TIP_DETAIL", 0.9),
        bo.Rule("or", ["textbook"], "TIP_DETAIL", 0.7),   # same rule id: counts once, at max
    ]
    got = {(r.query_id, r.item_id): round(r.boost, 6) for r in bo.rule_boost(q, c, rules).collect()}
    assert got[(1, 0)] == 0.3 and got[(1, 1)] == 1.3 and got[(1, 2)] == 0.5
    assert (2, 2) not in got and got[(2, 0)] == 0.3
    assert got[(3, 3)] == 0.9


def test_graph_propagate(spark):
    scores = spark.createDataFrame([(1, 0, 2.0), (1, 1, 0.5), (1, 2, 0.9), (1, 3, 1.0)],
                                   "query_id long, item_id long, score double")
    keys = spark.createDataFrame([(0, "k1", 0), (1, "k1", 1), (2, "k2", 2), (3, "k2", 3), (2, "k1", 2),
                                  (4, "k1", 4), (5, "k1", 5)],
                                 "item_id long, key string, ordinal long")
    got = {r.item_id: r.score for r in bo.graph_propagate(scores, keys).collect()}
    assert got[1] == 0.8 and got[2] == 0.9  # lifted to 0.4 * 2.0 = 0.8; 0.9 stays (max)
    assert got[3] == 1.0                    # score exactly 1.0 pushes nothing (strict >)
    assert got[0] == 2.0
    assert 4 not in got
    ordered = scores.withColumn("ordinal", scores.item_id)
    base = spark.createDataFrame([(1, 0.1)], "query_id long, base double")
    fill = lambda k, b=base: {r.item_id: r.score for r in bo.propagated_fill(ordered, keys, b, k).collect()}
    # the lowest members of hub k1 (0, 1, 2) are scored already: the fill
    # goes on to 4 and 5, at the lift 0.8
    assert fill(1) == {4: 0.8} and fill(3) == {4: 0.8, 5: 0.8}
    # a base above the lift stays
    assert fill(1, spark.createDataFrame([(1, 0.95)], "query_id long, base double")) == {4: 0.95}


def test_first_free_looks_through_the_whole_group(spark):
    members = spark.createDataFrame([(i, i, "g") for i in range(40)] + [(100, 0, "h")], "item_id long, ordinal long, g string")
    groups = spark.createDataFrame([(1, "g"), (2, "g"), (2, "h")], "query_id long, g string")
    taken = spark.createDataFrame([(1, i) for i in range(38)] + [(2, 1)], "query_id long, item_id long")
    got = sorted((r.query_id, r.g, r.item_id) for r in se.first_free(groups, members, taken, 3, ["g"]).collect())
    assert got == [(1, "g", 38), (1, "g", 39), (2, "g", 0), (2, "g", 2), (2, "g", 3), (2, "h", 100)]


def test_rule_families(spark):
    """A positive family with a negative one inside it: the lowest members
    are the penalised ones, the fill must reach beyond them."""
    c = spark.createDataFrame([(i, i, f"AA_B{i}" if i < 9 else f"AA_C{i}", "t") for i in range(12)],
                              "item_id long, ordinal long, name string, text string")
    rules = [bo.Rule("up", ["x"], "AA_", 0.5, match="prefix"), bo.Rule("down", ["x"], "AA_B", -0.4, match="prefix")]
    q = spark.createDataFrame([(1, "x y")], "query_id long, question string")
    none = spark.createDataFrame([], "query_id long, item_id long")
    got = {r.item_id: round(r.boost, 6) for r in
           bo.apply_rule_boosts(none, c, bo.rule_target_boosts(q, rules), rules, fill_k=2).collect()}
    assert got == {0: 0.1, 1: 0.1, 9: 0.5, 10: 0.5}
    bo.check_rules(rules)
    with pytest.raises(ValueError):
        bo.check_rules([*rules, bo.Rule("more", ["x"], "AA_B", 0.3, match="prefix")])


def test_pin_to_front(spark):
    c = corpus(spark)
    ranked = spark.createDataFrame([(1, 2, 0.9, 1), (1, 0, 0.5, 2), (1, 1, 0.4, 3)],
                                   "query_id long, item_id long, score double, rank int")
    forced = spark.createDataFrame([(1, 3, 1), (1, 1, 2)], "query_id long, item_id long, fpos long")
    out = [(r.item_id, round(r.score, 6)) for r in bo.pin_to_front(ranked, forced, c, 3).orderBy("rank").collect()]
    assert out == [(3, 2.0), (1, 1.4), (2, 0.9)]


def test_target_level_rule_boosts_match_item_level(spark):
    c = corpus(spark)
    q = spark.createDataFrame([(1, "Which building has most rooms?"), (3, "isbn of the textbook")],
                              "query_id long, question string")
    rules = [bo.Rule("fam", ["building", "room"], "FCLT_", 0.3, match="prefix"),
             bo.Rule("two", ["building"], "FCLT_ROOMS", 1.0, any_of_2=["rooms"]),
             bo.Rule("or", ["isbn"], "TIP_DETAIL", 0.9), bo.Rule("or", ["textbook"], "TIP_DETAIL", 0.7)]
    tb = bo.rule_target_boosts(q, rules)
    pairs = spark.createDataFrame([(1, 1)], "query_id long, item_id long")
    got = {(r.query_id, r.item_id): round(r.boost, 6)
           for r in bo.apply_rule_boosts(pairs, c, tb, rules, fill_k=5).collect()}
    exp = {(r.query_id, r.item_id): round(r.boost, 6) for r in bo.rule_boost(q, c, rules).collect()}
    assert got == exp


def test_memo_lookup_hits_misses_upsert(spark):
    from pyspark.sql import functions as F
    reqs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "a")], "query_id long, question string")
    cache = spark.createDataFrame([("a", "cached-a"), ("z", "cached-z")], "question string, value string")
    asked = []

    def compute(m):
        asked.extend(sorted(r.question for r in m.collect()))
        return m.select("question", F.concat(F.lit("new-"), "question").alias("value"))
    answers, updated = bo.memo_lookup(reqs, cache, compute)
    a = {r.query_id: (r.value, r.from_cache) for r in answers.collect()}
    assert a == {1: ("cached-a", True), 2: ("new-b", False), 3: ("new-b", False), 4: ("new-c", False), 5: ("cached-a", True)}
    assert asked == ["b", "c"]  # each missing text once
    assert sorted(map(tuple, updated.collect())) == [("a", "cached-a"), ("b", "new-b"), ("c", "new-c"), ("z", "cached-z")]


def test_propagation_meets_classes_of_items(spark):
    """pairs look up their item's class of join keys; repeated rows,
    null ids, null keys and items without keys as by rows (pair, key)."""
    scores = [(1, 1, 2.0), (1, 2, 0.5), (1, 2, 0.9), (1, 3, 1.5), (1, 4, 0.1), (1, None, 5.0), (2, 2, 0.3), (2, 3, 3.0), (None, 1, 4.0), (2, 5, 0.2)]
    keys = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (3, "b"), (5, None), (6, "a"), (4, "c"), (None, "b")]
    s = spark.createDataFrame(scores, "query_id long, item_id long, score double")
    k = spark.createDataFrame([(*x, 0) for x in keys], "item_id long, key string, ordinal long")
    hub = {}
    for q, i, v in scores:
        for j, key in keys:
            if i is not None and i == j and key is not None and v > 1:
                hub[q, key] = max(hub.get((q, key), 0.0), v * 0.4)
    assert {(r.query_id, r.key): r.lift for r in bo.push_hubs(s, k).collect() if r.query_id is not None} == {
        x: v for x, v in hub.items() if x[0] is not None}
    want = [(q, i, max([v] + [hub.get((q, key), v) for j, key in keys if q is not None and i == j and i is not None])) for q, i, v in scores]
    got = bo.graph_propagate(s, k)
    assert got.columns == s.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(_keys" not in plan  # the keys met the questions before, not the pairs
