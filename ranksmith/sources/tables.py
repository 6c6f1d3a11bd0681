"""Table access for the driver-provided parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read one table.  ``spread`` gives a scan that comes back as fewer
    partitions than the cluster has cores (one row group per file, as in
    the test data) a round-robin split, so per-row text work runs in
    parallel; a large input already has enough splits and is left alone."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread:
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            df = df.repartition(par)
    return df


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a retrieval corpus: (item_id, ordinal, name, text).

    ``ordinal`` is the tie-breaker of every ranking (the position in the
    catalog in the reference; here the document id).  ``name`` is the
    identifier a question could mention: LANG_SOURCE_ID in upper case.
    """
    d = table(spark, sf_dir, "documents", spread=True)
    return d.select(
        F.col("doc_id").alias("item_id"),
        F.col("doc_id").alias("ordinal"),
        F.upper(F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string"))).alias("name"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def questions_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as a question batch: (query_id, question)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"),
                    F.coalesce(F.col("text"), F.lit("")).alias("question"))


def questions_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as a larger question batch."""
    c = table(spark, sf_dir, "conversations")
    return (c.filter(F.col("role") == "user")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                    F.coalesce(F.col("text"), F.lit("")).alias("question")))


def catalog_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in catalog rows ``(table_name, column_names, column_types)``
    with one described table per document: its id, a per-source key, a
    per-language code, text and size columns, a load-date audit column and
    the label columns when the document is labelled.  Even ids carry the
    lists as JSON arrays, odd ids as bracketed comma text (the fallback
    format).  Only the input rows are built here; every catalog operator
    runs on them unchanged."""
    d = table(spark, sf_dir, "documents", spread=True).select("doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("_lab"))
    j = d.join(lab, "doc_id", "left")
    labelled = F.coalesce(F.col("_lab"), F.lit(False))
    names = F.concat(F.array(F.lit("doc_id"), F.concat(F.col("source"), F.lit("_id")),
                             F.concat(F.col("lang"), F.lit("_code")), F.lit("text"), F.lit("n_chars"),
                             F.lit("load_date")),
                     F.when(labelled, F.array(F.lit("quality"), F.lit("toxic"))).otherwise(F.array().cast("array<string>")))
    types = F.concat(F.array(*[F.lit(t) for t in ("int64", "int64", "string", "string", "int64", "timestamp")]),
                     F.when(labelled, F.array(F.lit("int32"), F.lit("int32"))).otherwise(F.array().cast("array<string>")))

    def enc(a):
        return F.when(F.col("doc_id") % 2 == 0, F.to_json(a)) \
            .otherwise(F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]")))
    return j.select(F.upper(F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string"))).alias("table_name"),
                    enc(names).alias("column_names"), enc(types).alias("column_types"))
