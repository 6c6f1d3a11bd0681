import math

from pyspark.sql import functions as F

from ranksmith.functions import scalars as sc
from ranksmith.functions import text as tx


def test_variance_rules(spark):
    df = spark.createDataFrame(
        [("one", "5"), ("two", "1"), ("two", "3"), ("text", "abc"), ("text", "7"), ("none", None)],
        "g string, x string")
    r = {row.g: row for row in df.groupBy("g").agg(
        sc.agg_variance("x").alias("v"), sc.agg_stddev("x").alias("s"),
        sc.agg_var_pop("x").alias("vp"), sc.agg_stddev_pop("x").alias("sp")).collect()}
    assert r["one"].v == 0.0 and r["one"].s == 0.0 and r["one"].vp == 0.0
    assert r["two"].v == 2.0 and math.isclose(r["two"].s, math.sqrt(2.0)) and r["two"].vp == 1.0
    assert r["text"].v == 0.0  # 'abc' skipped, one value left
    assert r["none"].v is None and r["none"].vp is None and r["none"].sp is None


def test_log_exp_ascii(spark):
    df = spark.createDataFrame([("0",), ("-1",), ("710",), ("abc",), ("",), ("é",), ("1_000",), ("2.5",)], "x string")
    rows = df.select("x", sc.fn_log("x").alias("l"), sc.fn_exp("x").alias("e"), sc.fn_ascii("x").alias("a")).collect()
    got = {r.x: r for r in rows}
    assert got["0"].l is None and got["-1"].l is None and got["abc"].l is None
    assert got["710"].e is None  # overflow
    assert math.isclose(got["2.5"].l, math.log(2.5)) and math.isclose(got["-1"].e, math.exp(-1))
    assert math.isclose(got["1_000"].l, math.log(1000.0))
    assert got[""].a is None and got["é"].a == ord("é") and got["abc"].a == ord("a")
    n = spark.createDataFrame([(0.0,), (-3.5,), (12.0,)], "v double")
    a = [r[0] for r in n.select(sc.fn_ascii("v", numeric=True)).collect()]
    assert a == [None, ord("-"), ord("1")]


def test_jaccard_and_trigrams(spark):
    df = spark.createDataFrame([("ab", "ab"), ("", ""), ("Hello", "yellow")], "a string, b string")
    df = tx.with_trigrams(tx.with_trigrams(df, "a", "ga"), "b", "gb")
    rows = df.select("a", F.size("ga").alias("n"), tx.jaccard(F.col("ga"), F.col("gb")).alias("j"),
                     tx.jaccard(tx.tok_word("a"), tx.tok_word("b")).alias("jw")).collect()
    by = {r.a: r for r in rows}
    assert by["ab"].n == 1 and by["ab"].j == 1.0          # whole text when shorter than 3
    assert by[""].jw == 0.0                               # two empty sets
    ga = {"hel", "ell", "llo"}
    gb = {"yel", "ell", "llo", "low"}
    assert math.isclose(by["Hello"].j, len(ga & gb) / len(ga | gb))


def test_tokenizers(spark):
    df = spark.createDataFrame([("  The cats, (sat) on\tthe mats?  ",)], "q string")
    r = df.select(tx.tok_ws("q").alias("ws"), tx.tok_clean_plural("q").alias("cp"),
                  tx.keyword_hits(F.lower("q"), ["the", "sat on", "cat"]).alias("k")).first()
    assert r.ws == "  The cats, (sat) on\tthe mats?  ".lower().split()
    # edge punctuation stripped; singulars only for words longer than four
    assert set(r.cp) == {"the", "cats", "sat", "on", "mats"}
    assert r.k == 2


def test_trigram_count_matches_python(spark):
    texts = ["Hello World", "ab", "", "aaaaaa", "Éclair éCLAIR"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.trigram_count("t")).collect()]
    exp = [1 if len(t) < 3 else len({t.lower()[i:i + 3] for i in range(len(t) - 2)}) for t in texts]
    assert got == exp


def test_sql_table_refs(spark):
    sql = ('WITH t AS (SELECT * FROM "db"."ORDERS" o JOIN items i ON o.id = i.id) '
           'SELECT * FROM t JOIN (SELECT 1) x JOIN `sales`.line_items(') 
    df = tx.sql_table_refs(spark.createDataFrame([(sql,)], "s string"), "s")
    r = df.first().refs
    assert set(r.tables) == {"ORDERS", "ITEMS", "T", "LINE_ITEMS"}
    assert set(r.ctes) == {"T"}


def test_strip_code_fence(spark):
    rows = [("```sql\nSELECT 1\n```",), ("Here:\n```\nSELECT 2\n",), ("SQL: SELECT 3",), ("SELECT 4",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(tx.strip_code_fence("s")).collect()]
    assert got == ["SELECT 1", "Here:\nSELECT 2", "SELECT 3", "SELECT 4"]


def test_map_top(spark):
    from ranksmith.sources.logs import map_top
    df = spark.createDataFrame([({"a": 0.1, "b": 0.5, "c": 0.3, "d": 0.2, "e": 0.9, "f": 0.05},)],
                               "m map<string,double>")
    assert set(df.select(map_top(F.col("m"), 5)).first()[0]) == {"a", "b", "c", "d", "e"}


def test_run_comparison_overlay(spark):
    from ranksmith.sources import logs as lg
    runs = spark.createDataFrame(
        [("r1", "gbt", "2024", {"val_recall_at_5": 0.5, "val_auc_roc": 0.7}, {"val_auc_roc": 0.9}, 12.34)],
        "run_id string, model_type string, timestamp string, val_metrics map<string,double>, "
        "test_metrics map<string,double>, training_duration_seconds double")
    r = lg.run_comparison(runs, ["val_recall_at_5", "val_auc_roc", "missing"]).first()
    assert r.val_recall_at_5 == 0.5 and r.val_auc_roc == 0.9 and r.missing == 0.0
    assert r.training_duration_seconds == 12.3


def test_sql_functions_agree_with_columns(spark):
    from ranksmith.functions import scalars as sc
    sc.register_sql_functions(spark)
    rows = [("2.5",), ("1_000",), (" 7 ",), ("0",), ("-1",), ("abc",), ("",), (None,), ("1__0",), ("710",), ("5d",), ("nan",)]
    df = spark.createDataFrame(rows, "x string")
    df.createOrReplaceTempView("rs_args")
    got = spark.sql("SELECT rs_log(x) AS l, rs_exp(x) AS e, rs_ascii(x) AS a, x FROM rs_args").collect()
    want = df.select(sc.fn_log("x").alias("l"), sc.fn_exp("x").alias("e"), sc.fn_ascii("x").alias("a"), "x").collect()
    assert [str(r) for r in got] == [str(r) for r in want]
    assert got[1].l is not None and got[5].l is None and got[10].l is None and got[9].e is None
    assert spark.sql("SELECT rs_sigmoid(0.0D) AS s").first().s == 0.5
