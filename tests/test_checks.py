"""Properties of learned rankings: kept by right rows, broken by wrong ones."""

from pyspark.sql import functions as F

from ranksmith.operators import checks as ck


def _ok(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]["n_rows"], rows[0]["n_groups"], rows[0]["ok"]


def test_top_check(spark):
    train = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "group_id long, item_id long")
    schema = "group_id long, item_id long, score double, rank int"
    top = spark.createDataFrame([(1, 11, 0.9, 1), (1, 10, 0.2, 2), (2, 10, 0.5, 1)], schema)
    assert _ok(ck.top_check("t", top, train)) == (3, 2, True)
    for bad in [(2, 11, 0.4, 2), (2, 10, 0.4, 2), (1, 10, 0.1, 4), (1, 10, 1.5, 3)]:
        assert not _ok(ck.top_check("t", top.union(spark.createDataFrame([bad], schema)), train))[2], bad
    assert _ok(ck.top_check("t", top.limit(0), train)) == (0, 0, True)


def test_score_and_same_check(spark):
    rows = [(g, i, float(i % 2), 0.9 if i % 2 else 0.1) for g in range(3) for i in range(6)]
    s = spark.createDataFrame(rows, "group_id long, item_id long, label double, score double")
    assert _ok(ck.score_check("s", s, 0.9)) == (18, 3, True)
    assert not _ok(ck.score_check("s", s.withColumn("score", 1 - F.col("score")), 0.9))[2]
    assert not _ok(ck.score_check("s", s.withColumn("score", F.col("score") + 1), 0.9))[2]
    assert _ok(ck.same_check("x", s, s)) == (18, 3, True)
    assert not _ok(ck.same_check("x", s, s.filter("item_id > 0")))[2]
    assert not _ok(ck.same_check("x", s, s.withColumn("score", F.col("score") + 1e-12)))[2]


def test_importance_check(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    imp = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "feature string, importance double")
    assert _ok(ck.importance_check("i", imp, train, ["a", "b"])) == (2, 1, True)
    wrong = spark.createDataFrame([("a", 0.8), ("b", 0.2)], "feature string, importance double")
    assert not _ok(ck.importance_check("i", wrong, train, ["a", "b"]))[2]


def test_fold_checks(spark):
    folds = spark.createDataFrame([(0, 0.2, 0.4), (1, 0.6, 0.6)], "fold int, val_recall_at_5 double, val_recall_at_10 double")
    assert _ok(ck.fold_check("f", folds)) == (2, 2, True)
    assert not _ok(ck.fold_check("f", folds.withColumn("val_recall_at_10", F.lit(0.3))))[2]
    from ranksmith.operators.ltr import cv_summary
    s = cv_summary(folds)
    assert _ok(ck.summary_check("m", s, folds)) == (1, 2, True)
    assert not _ok(ck.summary_check("m", s.withColumn("val_recall_at_5", F.lit(0.7)), folds))[2]
    both = s.withColumn("model_type", F.lit("x")).withColumn("best", F.lit(True)).unionByName(
        s.withColumn("model_type", F.lit("y")).withColumn("best", F.lit(False)))
    assert _ok(ck.best_check("b", both)) == (2, 2, True)
    assert not _ok(ck.best_check("b", both.withColumn("best", F.lit(True))))[2]
