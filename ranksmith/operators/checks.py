"""Properties of learned rankings that hold whatever the trees look like.

Each check is one row (check, n_rows, n_groups, ok): counts that follow from
the training set alone, and whether every row keeps the property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import auc_roc


def _row(name: str, df: DataFrame, ok: Column, group: str = "group_id") -> DataFrame:
    return df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(group).alias("n_groups"), F.coalesce(F.min(ok), F.lit(True)).alias("ok"))


def top_check(name: str, top: DataFrame, train: DataFrame) -> DataFrame:
    """A top-k list: candidates of the group, each once, scores within 0 and 1
    and not rising with the rank, ranks without gaps."""
    known = train.select("group_id", "item_id", F.lit(True).alias("_known"))
    by = Window.partitionBy("group_id").orderBy("rank")
    j = (top.join(known, ["group_id", "item_id"], "left")
         .withColumn("_n", F.row_number().over(by)).withColumn("_before", F.lag("score").over(by))
         .withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("group_id", "item_id"))))
    ok = (F.coalesce("_known", F.lit(False)) & (F.col("_copies") == 1) & F.col("score").between(0, 1)
          & (F.col("rank") == F.col("_n")) & (F.coalesce("_before", F.lit(1.0)) >= F.col("score") - 1e-9))
    return _row(name, j, ok)


def score_check(name: str, scored: DataFrame, least_auc: float) -> DataFrame:
    """Scores of all training candidates: within 0 and 1, and the fitted rows
    told apart with an AUC of at least ``least_auc``."""
    told = auc_roc(scored.select("label", "score")).select(F.col("auc_roc") >= least_auc).scalar()
    return _row(name, scored, F.col("score").between(0, 1)).withColumn("ok", F.col("ok") & told)


def same_check(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Two scorings of the same rows agree row by row, to the last digit."""
    j = left.select("group_id", "item_id", F.col("score").alias("a")).join(
        right.select("group_id", "item_id", F.col("score").alias("b")), ["group_id", "item_id"], "full")
    return _row(name, j, F.coalesce(F.col("a") == F.col("b"), F.lit(False)))


def importance_check(name: str, importance: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """Importances sum to 1; a feature that is constant in the training set
    splits nothing and has none.  ``n_groups`` counts the constant features."""
    ranges = train.agg(*[(F.max(c) == F.min(c)).alias(c) for c in cols])
    constant = ranges.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("constant"))
                                                 for c in cols])).alias("x")).select("x.*")
    j = importance.join(constant, "feature")
    return j.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n_rows"),
                 F.count_if("constant").alias("n_groups"),
                 ((F.abs(F.sum("importance") - 1) < 1e-3) & F.min(F.col("importance") >= 0)
                  & (F.coalesce(F.max(F.when(F.col("constant"), F.col("importance"))), F.lit(0.0)) == 0)).alias("ok"))


def fold_check(name: str, per_fold: DataFrame) -> DataFrame:
    """Fold metrics: within 0 and 1, more found in ten than in five."""
    cols = [c for c in per_fold.columns if c.startswith("val_")]
    ok = F.col("val_recall_at_5") <= F.col("val_recall_at_10")
    for c in cols:
        ok = ok & F.col(c).between(0, 1)
    return _row(name, per_fold, ok, "fold")


def summary_check(name: str, summary: DataFrame, per_fold: DataFrame) -> DataFrame:
    """Means lie between the folds' least and greatest values, and the square
    of a deviation is the mean square less the squared mean."""
    cols = [c for c in per_fold.columns if c.startswith("val_")]
    folds = per_fold.agg(*[f(c).alias(f"{c}{tag}") for c in cols for tag, f in
                           (("_lo", F.min), ("_hi", F.max), ("_sq", lambda x: F.avg(F.col(x) * F.col(x))))])
    ok = F.lit(True)
    for c in cols:
        m, sd = F.col(c), F.col(f"{c}_std")
        ok = (ok & m.between(F.col(f"{c}_lo") - 1e-9, F.col(f"{c}_hi") + 1e-9)
              & (F.abs(sd * sd - (F.col(f"{c}_sq") - m * m)) < 1e-9))
    # both sides are one row
    both = summary.withColumn("_1", F.lit(1)).join(folds.withColumn("_1", F.lit(1)), "_1")
    return both.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n_rows"),
                    F.lit(len(cols)).cast("long").alias("n_groups"), F.min(ok).alias("ok"))


def best_check(name: str, compared: DataFrame, score: str = "val_recall_at_5") -> DataFrame:
    """One model is flagged best, and none scores higher."""
    best = F.max(F.when(F.col("best"), F.col(score)))
    return compared.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n_rows"),
                        F.count_distinct("model_type").alias("n_groups"),
                        ((F.count_if("best") == 1) & (best == F.max(score))).alias("ok"))
