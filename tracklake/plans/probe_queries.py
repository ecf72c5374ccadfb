"""Probes and robust scales of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import models
from tracklake.plans.common import rounded, table


def label_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels below five against the others; blocks of ids are the groups that stay whole."""
    e = table(spark, sf_dir, "embeddings").selectExpr("embedding", "label < 5 AS low", "cast(vec_id % 20 AS int) AS fov")
    return rounded(models.probe_summary(models.probe_scores(e, "embedding", "low", "fov")), "auc_mean", "auc_std", "indistinguishability", digits=4)


def probe_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of whole sources, nearly equal in documents."""
    return models.balanced_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5)


def robust_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label and component of vectors scaled by their label's medians and absolute deviations: mean and largest value."""
    e = models.robust_scaled(table(spark, sf_dir, "embeddings").select("label", "embedding"), "embedding", ["label"])
    e = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("mean"), F.max("v").alias("most"))
    return rounded(e, "mean", "most", digits=4)


QUERIES = {f.__name__: f for f in (label_probe, probe_folds, robust_components)}

SQL = {
    "probe_folds": """WITH s AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), t AS (SELECT source, (row_number() OVER (ORDER BY n DESC, source) - 1) % 10 AS t FROM s)
      SELECT doc_id, source, (CASE WHEN t < 5 THEN t ELSE 9 - t END)::INT AS fold FROM documents JOIN t USING (source)""",
    "robust_components": """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT label, i, median(v) AS m FROM u GROUP BY 1, 2), d AS (SELECT label, i, median(abs(v - m)) AS d FROM u JOIN m USING (label, i) GROUP BY 1, 2)
      SELECT label, i::INT AS i, round(avg((v - m) / (d + 1e-12)), 4) AS mean, round(max((v - m) / (d + 1e-12)), 4) AS most FROM u JOIN m USING (label, i) JOIN d USING (label, i) GROUP BY 1, 2""",
}
