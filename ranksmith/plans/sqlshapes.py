"""The SQL shapes the reference's users run (its worked examples), as Spark
SQL over the star-schema tables.  Catalyst decorrelates the scalar
subquery, turns IN (subquery) into a semi join and pushes the filters
into the parquet scans.

The sample variance / stddev rule of the reference (0.0 for a single
value) is written out with a CASE on the count, in Spark and in the
oracle alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import TABLES, table

GROUPWISE_MAX = """
WITH s AS (
  SELECT sp.s_suppkey, sp.s_name, sp.s_acctbal, n.n_nationkey, n.n_name
  FROM supplier sp JOIN nation n ON sp.s_nationkey = n.n_nationkey
  WHERE n.n_name LIKE 'A%' OR sp.s_acctbal > 5000
)
SELECT s.n_name, s.s_suppkey, s.s_name, s.s_acctbal, a.avg_acctbal
FROM s
JOIN (SELECT n_nationkey, round(avg(s_acctbal), 6) AS avg_acctbal FROM s GROUP BY n_nationkey) a
  ON a.n_nationkey = s.n_nationkey
WHERE s.s_acctbal = (SELECT max(s2.s_acctbal) FROM s s2 WHERE s2.n_nationkey = s.n_nationkey)
ORDER BY s.n_name, s.s_suppkey
"""

FILTERED_VARIANCE = """
WITH o AS (
  SELECT c.c_mktsegment, od.o_orderpriority, od.o_totalprice
  FROM orders od JOIN customer c ON od.o_custkey = c.c_custkey
  WHERE od.o_orderpriority IS NOT NULL
    AND c.c_mktsegment != 'BUILDING'
    AND od.o_orderstatus NOT IN ('P')
)
SELECT c_mktsegment, o_orderpriority,
       round(avg(o_totalprice), 4) AS avg_price,
       round(CASE WHEN count(o_totalprice) = 1 THEN 0.0 ELSE var_samp(o_totalprice / 1000.0) END, 6) AS var_price,
       count(*) AS n_orders
FROM o
GROUP BY c_mktsegment, o_orderpriority
ORDER BY avg_price DESC
"""

SEMI_HAVING = """
WITH rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT n.n_name,
       count(DISTINCT o.o_custkey) AS n_customers,
       round(CASE WHEN count(o.o_totalprice) = 1 THEN 0.0 ELSE stddev_samp(o.o_totalprice) END, 6) AS sd_price
FROM nation n
LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey
WHERE c.c_custkey IN (SELECT c_custkey FROM rich)
GROUP BY n.n_name
HAVING count(DISTINCT o.o_custkey) > 5
ORDER BY n.n_name
"""

# The group-wise maximum again, written with a window instead of the
# correlated subquery: the execution-match check compares the two.
GROUPWISE_MAX_WINDOW = """
WITH s AS (
  SELECT sp.s_suppkey, sp.s_name, sp.s_acctbal, n.n_nationkey, n.n_name
  FROM supplier sp JOIN nation n ON sp.s_nationkey = n.n_nationkey
  WHERE n.n_name LIKE 'A%' OR sp.s_acctbal > 5000
), w AS (
  SELECT *, max(s_acctbal) OVER (PARTITION BY n_nationkey) AS mx,
            round(avg(s_acctbal) OVER (PARTITION BY n_nationkey), 6) AS avg_acctbal
  FROM s
)
SELECT n_name, s_suppkey, s_name, s_acctbal, avg_acctbal FROM w WHERE s_acctbal = mx
"""

PREVIEW = """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice
FROM lineitem
WHERE l_returnflag = 'R'
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber
"""


def register_views(spark: SparkSession, sf_dir: str, names=None) -> None:
    for t in names or TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)


def run(spark: SparkSession, sf_dir: str, sql: str, names=None) -> DataFrame:
    register_views(spark, sf_dir, names)
    return spark.sql(sql)


def guarded_preview(spark: SparkSession, statement: str, max_rows: int = 100) -> DataFrame:
    """Run a read-only statement (starting with SELECT or WITH) and return
    at most ``max_rows`` rows; anything else is refused."""
    head = statement.lstrip().split(None, 1)[0].upper() if statement.strip() else ""
    if head not in ("SELECT", "WITH"):
        raise ValueError("only SELECT / WITH statements can be previewed")
    return spark.sql(statement).limit(max_rows)


def execution_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Do two results hold the same *set* of rows?  Order, duplicates and
    column names are ignored (columns compared by position); NULL equals
    NULL.  One row: (match, only_left, only_right)."""
    if len(a.columns) != len(b.columns):
        return a.sparkSession.createDataFrame([(False, -1, -1)], "match boolean, only_left long, only_right long")
    b2 = b.toDF(*a.columns)
    left = a.distinct().subtract(b2.distinct())
    right = b2.distinct().subtract(a.distinct())
    l_n = left.groupBy().count().withColumnRenamed("count", "only_left")
    r_n = right.groupBy().count().withColumnRenamed("count", "only_right")
    lc = l_n.select(F.col("only_left").alias("v"), F.lit(0).alias("side"))
    rc = r_n.select(F.col("only_right").alias("v"), F.lit(1).alias("side"))
    u = lc.unionByName(rc).groupBy().agg(
        F.sum(F.when(F.col("side") == 0, F.col("v")).otherwise(0)).alias("only_left"),
        F.sum(F.when(F.col("side") == 1, F.col("v")).otherwise(0)).alias("only_right"))
    return u.select(((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("match"),
                    "only_left", "only_right")
