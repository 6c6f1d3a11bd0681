"""Learning to rank with Spark ML: training set, scaling, grouped folds,
tree ensembles, cross-validation, importances, prediction, persistence.

The training set is a DataFrame ``(group_id, item_id, f1..f28, label)``;
every step is a DataFrame / ML Pipeline step that runs on the executors.
Folds are assigned per group (a question never sits in two folds); the
scaler is fitted inside each fold on its training rows only.
"""

from __future__ import annotations

import functools
import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evaluate import auc_roc, binary_metrics, pool_metrics
from .features import FEATURE_NAMES
from .util import stored, topk

# model settings of the reference, in Spark ML terms
MODEL_PARAMS = {
    "gradient_boosting": dict(maxIter=200, maxDepth=5, stepSize=0.05, subsamplingRate=0.8,
                              minInstancesPerNode=10, seed=42),
    "random_forest": dict(numTrees=200, maxDepth=8, minInstancesPerNode=5,
                          featureSubsetStrategy="sqrt", seed=42),
    # boosted-library variants fall back to gradient boosting with their settings
    "lightgbm": dict(maxIter=200, maxDepth=5, stepSize=0.05, subsamplingRate=0.8,
                     minInstancesPerNode=10, seed=42),
    "xgboost": dict(maxIter=200, maxDepth=5, stepSize=0.05, subsamplingRate=0.8,
                    minInstancesPerNode=1, seed=42),
}


def training_set(features: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates x gold -> (group_id, item_id, 28 features, label); only
    questions with at least one gold item are kept, as in the reference."""
    g = gold.select("query_id", "item_id").distinct().withColumn("label", F.lit(1.0))
    with_gold = gold.select("query_id").distinct()
    t = features.join(with_gold, "query_id", "left_semi")
    t = t.join(g, ["query_id", "item_id"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))
    return t.withColumnRenamed("query_id", "group_id")


def class_balance(train: DataFrame) -> DataFrame:
    """Positives, negatives, positive ratio and number of groups."""
    return train.agg(F.sum((F.col("label") == 1).cast("long")).alias("positives"),
                     F.sum((F.col("label") != 1).cast("long")).alias("negatives"),
                     F.countDistinct("group_id").alias("groups")) \
        .withColumn("positive_ratio", F.round(F.col("positives") / (F.col("positives") + F.col("negatives")), 6))


KFOLD_RANGES = 64


def _count_upto(loads: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    """How many groups of size ``n`` have been dealt when every group went to
    a load of at most ``x``, per ``x``."""
    return np.maximum((x[:, None] - loads[None, :]) // n + 1, 0).sum(axis=1)


def deal(loads: np.ndarray, n: int, i: np.ndarray) -> np.ndarray:
    """Fold of the ``i``-th of equal groups of size ``n``, each given to the
    lightest fold (the first of equals) from ``loads`` on.  A fold takes its
    groups at loads L, L + n, L + 2n ..., so the i-th group goes where the i-th
    smallest of all these loads lies: found by bisection, without dealing."""
    low, high = np.full(len(i), loads.min() - 1), loads.max() + n * (i + 1)
    while (high - low > 1).any():
        mid = (low + high) // 2
        enough = _count_upto(loads, n, mid) > i
        low, high = np.where(enough, low, mid), np.where(enough, mid, high)
    at = (high[:, None] >= loads) & ((high[:, None] - loads) % n == 0)
    place = i - _count_upto(loads, n, high - 1)
    return (at & (np.cumsum(at, axis=1) == place[:, None] + 1)).argmax(axis=1)


def loads_by_size(classes: list[tuple[int, int]], k: int) -> dict[int, np.ndarray]:
    """The folds' loads before the groups of each size are dealt, for classes
    (size, number of groups), largest size first."""
    loads, out = np.zeros(k, np.int64), {}
    for n, c in sorted(classes, reverse=True):
        out[n] = loads
        last = np.array([c - 1])
        fold = int(deal(loads, n, last)[0])
        low, high = loads.min() - 1, loads.max() + n * c
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if _count_upto(loads, n, np.array([mid]))[0] >= c else (mid, high)
        given = np.maximum((high - 1 - loads) // n + 1, 0)
        there = (high >= loads) & ((high - loads) % n == 0) & (np.arange(k) <= fold)
        loads = loads + n * (given + there)
    return out


def group_kfold(train: DataFrame, k: int = 5) -> DataFrame:
    """Fold number per group: groups in order of size (largest first, then id)
    each go to the lightest fold; k is capped by the number of groups.
    (group_id, fold).

    The dealing is worked out on classes (size, number of groups), of which
    there are as many as sizes: for each class the folds' loads before it.  A
    group's fold follows from its number in its class alone."""
    sizes = train.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    classes = [tuple(r) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()]
    before = loads_by_size(classes, max(1, min(k, sum(c for _, c in classes))))
    # groups of one size are cut into ranges of their ids, numbered range by range
    probs = [i / KFOLD_RANGES for i in range(1, KFOLD_RANGES)]
    cuts = sizes.groupBy("n").agg(F.percentile_approx("group_id", probs, 10000).alias("_cuts"))
    b = sizes.join(cuts, "n").withColumn("_b", F.aggregate("_cuts", F.lit(0), lambda a, c: a + (c < F.col("group_id"))
                                                            .cast("int"))).drop("_cuts")
    at = Window.partitionBy("n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = (b.groupBy("n", "_b").agg(F.count(F.lit(1)).alias("_c"))
           .select("n", "_b", F.coalesce(F.sum("_c").over(at), F.lit(0)).alias("_off")))
    own = Window.partitionBy("n", "_b").orderBy("group_id")
    r = b.join(off, ["n", "_b"]).select("group_id", "n", (F.col("_off") + F.row_number().over(own) - 1).alias("_i"))

    def run(batches):
        for pdf in batches:
            fold = np.zeros(len(pdf), np.int32)
            for n, rows in pdf.groupby("n").indices.items():
                fold[rows] = deal(before[n], n, pdf["_i"].to_numpy()[rows].astype(np.int64))
            yield pdf[["group_id"]].assign(fold=fold)
    return r.mapInPandas(run, "group_id long, fold int")


def standard_scale(train: DataFrame, apply_to: DataFrame, cols=FEATURE_NAMES) -> DataFrame:
    """(x - mean) / population std with statistics from ``train``; a zero
    std divides by 1.  The statistics are one aggregate row (two numbers
    per feature, bounded by the feature count), fetched once and applied
    as literals."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = apply_to
    for c in cols:
        m = stats[f"m_{c}"] or 0.0
        s = stats[f"s_{c}"] or 0.0
        out = out.withColumn(c, (F.col(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0))
    return out


def make_model(kind: str = "gradient_boosting", params: dict | None = None):
    p = dict(MODEL_PARAMS.get(kind, MODEL_PARAMS["gradient_boosting"]))
    p.update(params or {})
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label", **p)
    return GBTClassifier(featuresCol="features", labelCol="label", **p)


ROWS_PER_TRAIN_PARTITION = 25_000


def fit(train: DataFrame, kind: str = "gradient_boosting", params: dict | None = None) -> PipelineModel:
    """Assemble the 28 features and fit the tree ensemble.

    Tree learners run several jobs per tree level, so the input gets one
    partition per ``ROWS_PER_TRAIN_PARTITION`` rows: small training sets do
    not pay per-task overhead hundreds of times, large ones are spread.  The
    rows' places depend on their keys alone, so the trees' samples, and with
    them the model, do not depend on the cluster."""
    parts = max(1, -(-train.count() // ROWS_PER_TRAIN_PARTITION))
    data = train.repartition(parts, "group_id", "item_id").sortWithinPartitions("group_id", "item_id")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features"),
                            make_model(kind, params)])
    return pipe.fit(data)


def predict_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Relevance probability per candidate (column ``score``)."""
    p = model.transform(rows)
    return p.withColumn("score", vector_to_array("probability").getItem(1)) \
        .drop("features", "rawPrediction", "probability", "prediction")


def predict_topk(model: PipelineModel, rows: DataFrame, k: int = 5) -> DataFrame:
    """Best k candidates per group by predicted probability."""
    s = predict_scores(model, rows)
    return topk(s, "group_id", "score", "item_id", k).select("group_id", "item_id", "score", "rank")


def fold_metrics(scored: DataFrame) -> DataFrame:
    """All metrics of one scored validation fold as one row (the fold is
    stored once; each metric is a one-row aggregate over it)."""
    scored = scored.select("group_id", "item_id", "label", "score").checkpoint(eager=True)
    pm = pool_metrics(scored, "group_id", "label", "score", "item_id", (5, 10)).first()
    bm = binary_metrics(scored).first()
    au = auc_roc(scored).first()
    vals = {f"val_{c}": float(pm[c] or 0.0) for c in ("recall_at_5", "recall_at_10", "ndcg_at_5", "ndcg_at_10")}
    vals.update({f"val_{c}": float(bm[c] or 0.0) for c in ("accuracy", "precision", "recall", "f1")})
    vals["val_auc_roc"] = float(au["auc_roc"] or 0.0)
    return scored.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in vals.items()])


FITS_AT_ONCE = 12


def cross_validate(train: DataFrame, kind: str = "gradient_boosting", k: int = 5,
                   params: dict | None = None) -> DataFrame:
    """Grouped k-fold CV: per fold, scale with training-fold statistics,
    fit, score the held-out groups and compute every metric.  One row per
    fold (fold, val_*)."""
    return cross_validate_kinds(train, [kind], k, params)[0]


def cross_validate_kinds(train: DataFrame, kinds: list[str], k: int = 5, params: dict | None = None) -> list[DataFrame]:
    """``cross_validate`` of several kinds.  A fit is a long row of small jobs,
    so the folds of all kinds are fitted at the same time (as Spark ML's
    ``CrossValidator`` does with ``parallelism``)."""
    folds = group_kfold(train, k)
    t = stored(train.join(folds, "group_id"), "folds")
    n_folds = t.agg(F.max("fold")).first()[0] + 1

    def one(kind: str, f: int) -> DataFrame:
        tr, va = t.filter(F.col("fold") != f), t.filter(F.col("fold") == f)
        m = fit(standard_scale(tr, tr), kind, params)
        return fold_metrics(predict_scores(m, standard_scale(tr, va))).withColumn("fold", F.lit(f))

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        jobs = [[pool.submit(inheritable_thread_target(train.sparkSession)(one), kind, f) for f in range(n_folds)]
                for kind in kinds]
        return [functools.reduce(DataFrame.unionByName, [j.result() for j in own]) for own in jobs]


def cv_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population std of every fold metric (one row)."""
    cols = [c for c in per_fold.columns if c.startswith("val_")]
    return per_fold.agg(*[F.avg(c).alias(c) for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols])


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Importances normalised to sum 1, rounded to 6 d.p., sorted desc."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    tot = sum(imp) or 1.0
    rows = [(n, float(v) / tot) for n, v in zip(FEATURE_NAMES, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.select("feature", F.round("importance", 6).alias("importance")) \
        .orderBy(F.col("importance").desc(), "feature")


def save_model(model: PipelineModel, base_dir: str) -> str:
    """Persist the fitted pipeline (assembler + model) under ``base_dir``."""
    path = os.path.join(base_dir, f"ranker-{uuid.uuid4().hex[:12]}")
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
