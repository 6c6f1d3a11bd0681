"""Evaluation operators: gold sets, Recall@K, NDCG@K, binary metrics, AUC.

All metrics are aggregates over a per-query (or per-pair) fact table, so
they run as ordinary grouped aggregations; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import rank_key


def gold_items(refs: DataFrame, ctes: DataFrame | None, catalog: DataFrame,
               qcol: str = "query_id", icol: str = "item_id") -> DataFrame:
    """Gold set per query: referenced items minus CTE names (anti join),
    restricted to items of the catalog (semi join).  Queries left with no
    gold item simply have no rows."""
    g = refs.select(qcol, icol).distinct()
    if ctes is not None:
        g = g.join(ctes.select(qcol, icol), [qcol, icol], "left_anti")
    return g.join(catalog.select(icol).distinct(), icol, "left_semi")


def recall_at_k(retrieved: DataFrame, gold: DataFrame, ks=(5, 10),
                rank_col: str = "rank") -> DataFrame:
    """End-to-end Recall@K: mean over queries with gold of
    |gold ∩ top-k| / |gold|.  One row per k: (k, recall, n_queries)."""
    r = retrieved.select("query_id", "item_id", rank_col)
    j = gold.select("query_id", "item_id").join(r, ["query_id", "item_id"], "left")
    per_q = j.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_gold"),
        *[F.sum(F.when(F.col(rank_col) <= k, 1).otherwise(0)).alias(f"hit{k}") for k in ks])
    rows = [per_q.select(F.lit(k).alias("k"), (F.col(f"hit{k}") / F.col("n_gold")).alias("r"))
            for k in ks]
    u = rows[0]
    for x in rows[1:]:
        u = u.unionByName(x)
    return u.groupBy("k").agg(F.avg("r").alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def per_query_recall(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, gold_items, retrieved_items, matched, recall) per query
    with gold; lists sorted."""
    r = retrieved.filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.array_sort(F.collect_list("item_id")).alias("retrieved_items"))
    g = gold.groupBy("query_id").agg(F.array_sort(F.collect_set("item_id")).alias("gold_items"))
    j = g.join(r, "query_id", "left").withColumn(
        "retrieved_items", F.coalesce("retrieved_items", F.array().cast("array<bigint>")))
    j = j.withColumn("matched", F.array_sort(F.array_intersect("gold_items", "retrieved_items")))
    return j.withColumn("recall", F.size("matched") / F.size("gold_items"))


def _ranked_by_score(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(rank_key(score).desc(), F.col(tie).asc())
    return df.withColumn("_pos", F.row_number().over(w))


def pool_metrics(df: DataFrame, group: str = "group_id", label: str = "label",
                 score: str = "score", tie: str = "item_id", ks=(5, 10)) -> DataFrame:
    """Recall@K and NDCG@K inside each candidate pool (denominator =
    positives in the pool); groups without a positive are skipped.  One
    row: recall_at_{k}, ndcg_at_{k} for every k, n_groups."""
    r = _ranked_by_score(df.select(group, label, score, tie), group, score, tie)
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    disc = F.log2(F.col("_pos") + 1)
    aggs = [F.sum(label).alias("_npos")]
    for k in ks:
        aggs.append(F.sum(F.when(F.col("_pos") <= k, F.col(label)).otherwise(0)).alias(f"_hit{k}"))
        aggs.append(F.sum(F.when(F.col("_pos") <= k, gain / disc).otherwise(0.0)).alias(f"_dcg{k}"))
    per = r.groupBy(group).agg(*aggs).filter(F.col("_npos") > 0)
    outs = []
    for k in ks:
        # ideal DCG with binary labels: one unit gain at each of the first
        # min(P, k) positions
        idcg = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_npos").cast("int"), F.lit(k))),
                           F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
        outs.append(F.avg(F.col(f"_hit{k}") / F.col("_npos")).alias(f"recall_at_{k}"))
        outs.append(F.avg(F.when(idcg > 0, F.col(f"_dcg{k}") / idcg).otherwise(0.0)).alias(f"ndcg_at_{k}"))
    return per.agg(*outs, F.count(F.lit(1)).alias("n_groups"))


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score",
                   threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, F1 at ``score >= threshold``; a zero
    denominator gives 0.0."""
    pred = (F.col(score) >= threshold).cast("int")
    y = F.col(label).cast("int")
    c = df.agg(F.count(F.lit(1)).alias("n"),
               F.sum(((pred == 1) & (y == 1)).cast("int")).alias("tp"),
               F.sum(((pred == 1) & (y == 0)).cast("int")).alias("fp"),
               F.sum(((pred == 0) & (y == 1)).cast("int")).alias("fn"),
               F.sum((pred == y).cast("int")).alias("ok"))
    z = F.lit(0.0)
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), z)
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), z)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(z)
    return c.select(F.coalesce(F.try_divide(F.col("ok").cast("double"), F.col("n")), z).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def cumulative_before(df: DataFrame, order_col: str, value_cols: list[str],
                      buckets: int = 64) -> DataFrame:
    """Add ``before_<v>`` = sum of ``v`` over rows with a strictly smaller
    ``order_col`` (rows must be distinct on ``order_col``).

    A running sum with no partition key would run in one task.  Instead the
    key range is cut into ``buckets`` by approximate quantiles (a scalar
    subquery; the cut points only affect balance, not the result), each
    bucket runs its own window, and bucket offsets come from a table with
    one row per bucket.
    """
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(order_col, probs, 10000)).scalar()
    # number of cut points strictly below the key (no lambda: a scalar
    # subquery may not sit inside a higher-order function)
    key = F.col(order_col).cast("double")
    b = df.withColumn("_b", F.array_position(
        F.sort_array(F.concat(cuts.cast("array<double>"), F.array(key))), key) - 1)
    tot = b.groupBy("_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    wo = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_b", *[F.coalesce(F.sum(f"_t_{v}").over(wo), F.lit(0)).alias(f"_o_{v}")
                             for v in value_cols])
    wl = Window.partitionBy("_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = b.join(F.broadcast(off), "_b")  # one row per bucket: bounded by ``buckets``
    for v in value_cols:
        out = out.withColumn(f"before_{v}", F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(wl), F.lit(0)))
    return out.drop("_b", *[f"_o_{v}" for v in value_cols])


def auc_roc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC with ties counted half (Mann–Whitney); 0.0 when only
    one class is present.  One row: auc_roc."""
    g = df.groupBy(F.col(score).alias("s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    c = cumulative_before(g, "s", ["neg"])
    a = c.agg(F.sum(F.col("pos") * (F.col("before_neg") + 0.5 * F.col("neg"))).alias("u"),
              F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return a.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n")))
                    .otherwise(F.lit(0.0)).alias("auc_roc"))


def tie_avg_rank(df: DataFrame, score: str = "score") -> DataFrame:
    """Average 1-based ascending rank of every row, ties sharing the mean
    of their positions: (score, n, avg_rank) per distinct score."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    c = cumulative_before(g, "s", ["n"])
    return c.select(F.col("s").alias(score), "n", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


# --- fixed values: question words that mark benchmark subtasks ------------
COLUMN_WORDS = ["budget", "phone", "email", "name", "title"]
DOMAIN_WORDS = ["mit", "residential", "chemical", "biology", "mathematics"]
# --- end of fixed values ----------------------------------------------------


def benchmark_facts(queries: DataFrame, gold: DataFrame, top5: DataFrame, top10: DataFrame) -> DataFrame:
    """One row per question with gold: recall at 5 and 10 and the subtask
    flags (several gold items; 'join' asked for; column words; domain
    words).  Questions without gold are skipped."""
    g = gold.groupBy("query_id").agg(F.collect_set("item_id").alias("gold"))
    r5 = top5.groupBy("query_id").agg(F.collect_set("item_id").alias("r5"))
    r10 = top10.groupBy("query_id").agg(F.collect_set("item_id").alias("r10"))
    j = g.join(queries.select("query_id", F.lower("question").alias("ql")), "query_id") \
        .join(r5, "query_id", "left").join(r10, "query_id", "left")
    empty = F.array().cast("array<bigint>")
    rec = lambda c: F.size(F.array_intersect("gold", F.coalesce(c, empty))) / F.size("gold")
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(F.col("ql"), w) > 0)
    return j.select("query_id", F.size("gold").alias("n_gold"), rec(F.col("r5")).alias("recall_5"),
                    rec(F.col("r10")).alias("recall_10"),
                    (F.size("gold") > 1).alias("multi_table"), (F.instr("ql", "join") > 0).alias("join_detection"),
                    has(COLUMN_WORDS).alias("column_mapping"), has(DOMAIN_WORDS).alias("domain_knowledge"))


SUBTASKS = ["multi_table", "column_mapping", "join_detection", "domain_knowledge"]


def subtask_breakdown(facts: DataFrame) -> DataFrame:
    """Per subtask: members, successes (all gold in the top 5) and the
    success rate, 1.0 for a subtask without members (4 d.p.)."""
    ok = F.col("recall_5") == 1.0
    rows = facts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("subtask"), F.col(s).alias("m"))
                                            for s in SUBTASKS])).alias("x"), ok.alias("ok"))
    agg = rows.groupBy("x.subtask").agg(F.sum(F.col("x.m").cast("long")).alias("count"),
                                        F.sum((F.col("x.m") & F.col("ok")).cast("long")).alias("correct"))
    return agg.select("subtask", "count", "correct",
                      F.when(F.col("count") > 0, F.round(F.col("correct") / F.col("count"), 4))
                      .otherwise(F.lit(1.0)).alias("rate"))


def benchmark_summary(facts: DataFrame) -> DataFrame:
    """One row: questions evaluated, mean Recall@5 / @10 (4 d.p.) and the
    retrieval-failure count (questions with Recall@5 = 0)."""
    return facts.agg(F.count(F.lit(1)).alias("total_queries"),
                     F.round(F.avg("recall_5"), 4).alias("retrieval_recall_at_5"),
                     F.round(F.avg("recall_10"), 4).alias("retrieval_recall_at_10"),
                     F.sum((F.col("recall_5") == 0).cast("long")).alias("retrieval_failures"))
