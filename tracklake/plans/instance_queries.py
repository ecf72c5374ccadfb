"""Objects of two label images: line numbers are images, orders regions, and in the second image some pixels have gone to the next region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import instances
from tracklake.plans.common import rounded, table


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region k keeps the pixels of nine parts in ten, less with k: so IoUs lie on both sides of the thresholds."""
    li = table(spark, sf_dir, "lineitem")
    a = F.expr("l_orderkey % 31")
    return li.select(F.col("l_linenumber").alias("image"), (F.expr("l_orderkey div 31") % 97).alias("y"), (F.col("l_partkey") % 89).alias("x"), a.alias("a"), F.when(F.col("l_partkey") % 23 < a / 3, (a + 1) % 31).otherwise(a).alias("b"))


def instance_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Above one half each object has one match at most, so SQL can count pairs."""
    s = instances.instance_scores(pixels(spark, sf_dir), ["image"], "a", "b", instances.THRESHOLDS[1:])
    return rounded(s.select("image", "n_truth", "n_found", F.posexplode("precision").alias("i", "precision"), "tp", "fp", "fn", "dice"), "precision", "dice")


def instance_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = instances.instance_scores(pixels(spark, sf_dir), ["image"], "a", "b")
    p = instances.detected_by_centre(pixels(spark, sf_dir), ["image"], "y", "x", "a", "b")
    both = s.select("image", "mean_precision", "coco_map", "coco_recall").join(p, "image")
    return rounded(both, "mean_precision", "coco_map", "coco_recall", "precision", "recall", "f1")


QUERIES = {f.__name__: f for f in (instance_precision, instance_detection)}

SQL = {
    "instance_precision": f"""WITH p AS (SELECT l_linenumber AS image, l_orderkey % 31 AS a, CASE WHEN l_partkey % 23 < (l_orderkey % 31) / 3 THEN (l_orderkey % 31 + 1) % 31 ELSE l_orderkey % 31 END AS b FROM lineitem),
      c AS (SELECT image, a, b, count(*) AS n FROM p GROUP BY 1, 2, 3), na AS (SELECT image, a, sum(n) AS n FROM c WHERE a > 0 GROUP BY 1, 2), nb AS (SELECT image, b, sum(n) AS n FROM c WHERE b > 0 GROUP BY 1, 2),
      i AS (SELECT c.image, c.a, c.b, c.n / (na.n + nb.n - c.n)::DOUBLE AS iou FROM c JOIN na ON na.image = c.image AND na.a = c.a JOIN nb ON nb.image = c.image AND nb.b = c.b),
      s AS (SELECT image, (SELECT count(*) FROM na WHERE na.image = x.image) AS n_truth, (SELECT count(*) FROM nb WHERE nb.image = x.image) AS n_found FROM (SELECT DISTINCT image FROM p) x),
      best AS (SELECT na.image, coalesce(max(iou), 0) AS m FROM na LEFT JOIN i ON i.image = na.image AND i.a = na.a GROUP BY na.image, na.a UNION ALL SELECT nb.image, coalesce(max(iou), 0) FROM nb LEFT JOIN i ON i.image = nb.image AND i.b = nb.b GROUP BY nb.image, nb.b),
      d AS (SELECT image, round(avg(2 * m / (1 + m)), 6) AS dice FROM best GROUP BY image),
      t AS (SELECT unnest({list(range(9))}) AS i, unnest({list(instances.THRESHOLDS[1:])})::DOUBLE AS t),
      k AS (SELECT s.image, t.i, (SELECT count(*) FROM i WHERE i.image = s.image AND iou >= t.t) AS k, (SELECT count(*) FROM i WHERE i.image = s.image AND iou >= 0.55) AS tp FROM s, t)
      SELECT s.image, n_truth, n_found, k.i::INT AS i, round(k.k / (n_truth + n_found - k.k)::DOUBLE, 6) AS precision, tp, n_found - tp AS fp, n_truth - tp AS fn, dice FROM s JOIN k USING (image) JOIN d USING (image)""",
}
