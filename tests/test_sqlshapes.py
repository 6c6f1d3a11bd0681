import pytest

from ranksmith.plans import sqlshapes as sh


def test_execution_match_set_semantics(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(2, "x"), (1, None)], "c int, d string")          # other names, order, no dups
    r = sh.execution_match(a, b).first()
    assert r.match and r.only_left == 0 and r.only_right == 0
    c = spark.createDataFrame([(2, "y"), (1, None)], "c int, d string")
    r2 = sh.execution_match(a, c).first()
    assert not r2.match and r2.only_left == 1 and r2.only_right == 1


def test_guarded_preview(spark):
    spark.range(500).createOrReplaceTempView("nums")
    assert sh.guarded_preview(spark, "  select id from nums order by id").count() == 100
    assert sh.guarded_preview(spark, "WITH t AS (SELECT 1 AS x) SELECT * FROM t").count() == 1
    with pytest.raises(ValueError):
        sh.guarded_preview(spark, "DROP VIEW nums")
