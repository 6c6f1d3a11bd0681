import math

from ranksmith.operators import evaluate as ev


def auc_python(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a != 1]
    if not pos or not neg:
        return 0.0
    u = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return u / (len(pos) * len(neg))


def test_auc_with_ties_and_single_class(spark):
    y = [1, 0, 1, 0, 0, 1, 0, 1, 0, 0]
    s = [0.9, 0.9, 0.5, 0.3, 0.5, 0.1, 0.2, 0.9, 0.0, 0.3]
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    assert math.isclose(ev.auc_roc(df).first()[0], auc_python(y, s))
    one = spark.createDataFrame([(1, 0.2), (1, 0.3)], "label int, score double")
    assert ev.auc_roc(one).first()[0] == 0.0


def test_pool_metrics(spark):
    rows = [(1, 10, 1, 0.9), (1, 11, 0, 0.8), (1, 12, 1, 0.1), (2, 20, 0, 0.5), (2, 21, 0, 0.4),
            (3, 30, 0, 0.7), (3, 31, 1, 0.7)]
    df = spark.createDataFrame(rows, "group_id long, item_id long, label int, score double")
    r = ev.pool_metrics(df, ks=(1, 5)).first()
    assert r.n_groups == 2  # group 2 has no positive: skipped
    # group 1: top1 = 10 (pos); group 3: tie at 0.7 broken by item_id -> 30 (neg)
    assert math.isclose(r.recall_at_1, (0.5 + 0.0) / 2)
    dcg1 = 1 / math.log2(2) + 1 / math.log2(4)
    idcg1 = 1 / math.log2(2) + 1 / math.log2(3)
    dcg3 = 1 / math.log2(3)
    assert math.isclose(r.ndcg_at_5, (dcg1 / idcg1 + dcg3 / 1.0) / 2)


def test_recall_at_k(spark):
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "query_id long, item_id long")
    ret = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 11, 6), (2, 21, 1)],
                                "query_id long, item_id long, rank int")
    r = {x.k: x for x in ev.recall_at_k(ret, gold, (5, 10)).collect()}
    assert math.isclose(r[5].recall, (0.5 + 0.0) / 2) and math.isclose(r[10].recall, (1.0 + 0.0) / 2)
    assert r[5].n_queries >= r[5].recall  # recall@10 >= recall@5 below
    assert r[10].recall >= r[5].recall


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, score double")
    r = ev.binary_metrics(df).first()
    assert r.accuracy == 1.0 and r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0


def test_tie_avg_rank_brute_force(spark):
    import random
    rnd = random.Random(5)
    vals = [round(rnd.random(), 1) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "score double")
    got = {r.score: r.avg_rank for r in ev.tie_avg_rank(df).collect()}
    order = sorted(vals)
    for v in set(vals):
        pos = [i + 1 for i, x in enumerate(order) if x == v]
        assert math.isclose(got[v], sum(pos) / len(pos))
