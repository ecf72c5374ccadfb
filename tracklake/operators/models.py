"""Linear classifiers, projections and mixtures of vectors by Spark ML; fits and predictions stay distributed."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.lineage import cut, if_few
from tracklake.operators.aggregates import medians, roc_auc


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))


def fit_classifier(rows: DataFrame, vector: str, label: str, components: int | None = None, l2: float = 1e-2, rounds: int = 100) -> PipelineModel:
    """Standardised, optionally projected logistic regression with classes weighted to equal shares; unlabelled rows teach nothing."""
    known = _vectors(rows.where(F.col(label).isNotNull()), vector).withColumn("_y", F.col(label).cast("string"))
    counts = known.groupBy("_y").agg(F.count("*").alias("_n"))
    sums = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))  # one row
    weights = counts.crossJoin(F.broadcast(sums)).select("_y", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("_w"))
    stages = [StringIndexer(inputCol="_y", outputCol="_code", handleInvalid="keep"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True)]
    if components:
        stages.append(PCA(k=components, inputCol="_z", outputCol="_p"))
    stages.append(LogisticRegression(featuresCol="_p" if components else "_z", labelCol="_code", weightCol="_w", regParam=l2, maxIter=rounds))
    return Pipeline(stages=stages).fit(known.join(weights, "_y"))


def classify(model: PipelineModel, rows: DataFrame, vector: str) -> DataFrame:
    """All rows with predicted (the class as text) and probability (of each class, in the order of labels)."""
    labels = model.stages[0].labels
    out = model.transform(_vectors(rows, vector).withColumn("_y", F.lit(labels[0])))
    names = F.array(*map(F.lit, labels))
    p = F.slice(vector_to_array("probability"), 1, len(labels))
    best = F.array_position(p, F.array_max(p))
    return out.select(*rows.columns, F.element_at(names, best.cast("int")).alias("predicted"), p.alias("probability"))


def project(rows: DataFrame, vector: str, components: int, out: str = "pca") -> DataFrame:
    """Coordinates along the first principal components of the standardised vectors."""
    model = Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_z", withMean=True), PCA(k=components, inputCol="_z", outputCol="_p")]).fit(_vectors(rows, vector))
    return model.transform(_vectors(rows, vector)).select(*rows.columns, vector_to_array("_p").alias(out))


def bimodality(rows: DataFrame, value: str, least: int = 30, seed: int = 0) -> tuple[float, bool] | None:
    """By how much the information criterion falls from one normal to two, and whether by at least 10; None below `least` rows or without spread."""
    x = rows.where(F.col(value).isNotNull()).select(array_to_vector(F.array(F.col(value).cast("double"))).alias("features"))
    n, variance = rows.agg(F.count(value), F.var_pop(value)).first()
    if n < least or not variance:
        return None
    one = -n / 2 * (math.log(2 * math.pi * variance) + 1)
    two = GaussianMixture(k=2, seed=seed, maxIter=200, tol=1e-6).fit(x).summary.logLikelihood
    fall = (-2 * one + 2 * math.log(n)) - (-2 * two + 5 * math.log(n))
    return fall, fall >= 10


def robust_scaled(rows: DataFrame, vector: str, keys: list[str] | None = None, learn_from: DataFrame | None = None, eps: float = 1e-12) -> DataFrame:
    """Vectors less their components' medians, over the median absolute deviations plus eps, of each group of `keys` or of all rows; the statistics can come from other rows.

    Exact medians from counts of distinct values; a group has one row of statistics. Rows of groups without statistics get a null vector.
    """
    keys = keys or []
    e = (rows if learn_from is None else learn_from).select(*keys, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("_i", "_x"))
    m = cut(medians(e, [*keys, "_i"], "_x", "_m"))
    d = medians(e.join(if_few(m), [*keys, "_i"]).withColumn("_d", F.abs(F.col("_x") - F.col("_m"))), [*keys, "_i"], "_d", "_d")
    stats = m.join(d, [*keys, "_i"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_d"))).alias("_s"))
    scaled = F.zip_with(vector, "_s", lambda x, s: (x.cast("double") - s["_m"]) / (s["_d"] + eps))
    return (rows.join(if_few(stats), keys, "left") if keys else rows.join(F.broadcast(stats), how="left")).withColumn(vector, scaled).drop("_s")  # without keys one row


def balanced_folds(rows: DataFrame, group: str, folds: int, out: str = "fold") -> DataFrame:
    """Rows with a fold for each whole group: groups in the order of their size, the largest first, take turns. Rows without a group are left out."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    turn = F.row_number().over(Window.orderBy(F.desc("_n"), group)) - 1  # one row a group
    there = sizes.withColumn(out, turn)
    # forward and back, so that no fold always gets the larger one
    place = F.col(out) % (2 * folds)
    there = there.select(group, F.when(place < folds, place).otherwise(2 * folds - 1 - place).cast("int").alias(out))
    return rows.join(if_few(there), group)


def probe_scores(rows: DataFrame, vector: str, positive: str, group: str, folds: int = 5, rounds: int = 2000) -> DataFrame:
    """How well a linear classifier tells two kinds of rows apart that it hasn't seen: (fold, n1, n0, auc), a row for each fold with both kinds in it.

    All rows of a group are in one fold. For each fold a logistic regression (L2 with strength 1, kinds weighted to equal shares) is learnt from the other folds' vectors, scaled by their medians and
    absolute deviations, and scores the fold's. With fewer groups than folds there are as many folds as groups; with one there is none. Folds whose training rows are of one kind are left out.
    """
    x = rows.where(F.col(vector).isNotNull() & F.col(positive).isNotNull()).select(F.col(group).alias("group"), F.col(positive).cast("boolean").alias("positive"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    n_groups = x.agg(F.count_distinct("group")).first()[0]
    folds = min(folds, n_groups)
    found = rows.sparkSession.createDataFrame([], "fold int, positive boolean, score double")
    x = cut(balanced_folds(x, "group", max(folds, 1)))
    for f in range(folds) if folds > 1 else ():
        train = x.where(F.col("fold") != f)
        count = {r.positive: r.n for r in train.groupBy("positive").agg(F.count("*").alias("n")).collect()}
        if len(count) < 2:
            continue
        total = sum(count.values())
        s = robust_scaled(x, "v", learn_from=train).withColumn("x", array_to_vector("v"))
        s = s.withColumns({"y": F.col("positive").cast("double"), "w": F.when(F.col("positive"), total / (2.0 * count[True])).otherwise(total / (2.0 * count[False]))})
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / total, maxIter=rounds, tol=1e-8, standardization=False).fit(s.where(F.col("fold") != f))
        scored = model.transform(s.where(F.col("fold") == f)).select("fold", "positive", vector_to_array("probability")[1].alias("score"))
        found = found.unionByName(scored)
    return roc_auc(cut(found), ["fold"], "score", "positive").where("auc IS NOT NULL")


def probe_summary(scores: DataFrame) -> DataFrame:
    """One row: folds, the mean and deviation of the area under the curve (null for fewer than two folds), and indistinguishability, 1 - 2 * |mean - 0.5|."""
    mean = F.avg("auc")
    return scores.agg(F.count("*").alias("folds"), mean.alias("auc_mean"), F.when(F.count("*") >= 2, F.stddev_pop("auc")).alias("auc_std"), (1 - 2 * F.abs(mean - 0.5)).alias("indistinguishability"))
