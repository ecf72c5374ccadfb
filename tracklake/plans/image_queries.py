"""Queries on pixel-like rows, each with its SQL. Line items stand for pixels: order and part give y and x, suppliers regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import aggregates, images
from tracklake.plans.common import rounded, table


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 64).alias("y"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_linenumber") - 1).alias("z"), (F.col("l_suppkey") % 30).alias("label"), (F.col("l_partkey") % 25).alias("other"), F.col("l_extendedprice").alias("value"), "l_returnflag")


_PIXELS = "p AS (SELECT l_orderkey % 64 AS y, l_partkey % 64 AS x, l_linenumber - 1 AS z, l_suppkey % 30 AS label, l_partkey % 25 AS other, l_extendedprice AS value, l_returnflag FROM lineitem)"


def region_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = images.region_features(pixels(spark, sf_dir), ["l_returnflag"], "label", "y", "x", "value")
    return rounded(f, "centre_y", "centre_x", "mean", "std", "low", "high", "iqr", "median", "skew", "kurtosis", digits=4)


def grid_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = images.grid_sample(pixels(spark, sf_dir), "y", "x", 4)
    return rounded(g.groupBy("z").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), "mean", "std", digits=4)


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.max_projection(pixels(spark, sf_dir), ["l_returnflag"], "y", "x", "value")


def focus_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    power = pixels(spark, sf_dir).groupBy("label", "z").agg(F.stddev_pop("value").alias("power"))
    return rounded(images.best_plane(power, ["label"], "z", "power"), "lead", digits=4)


def normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = images.normalised(pixels(spark, sf_dir), ["label"], "value", F.avg("value"), F.stddev_pop("value"))
    return rounded(n.groupBy("label", "z").agg(F.avg("normalised").alias("mean"), F.max("normalised").alias("most")), "mean", "most")


def segmentation_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images.variation_of_information(pixels(spark, sf_dir), ["l_returnflag"], "label", "other"), "a_given_b", "b_given_a")


def segmentation_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    iou = aggregates.overlap_iou(p, "label", "other")
    return rounded(images.instance_dice(iou, "label", "other", p.where("label > 0").select("label").distinct(), p.where("other > 0").select("other").distinct()), "dice_label", "dice_other", "sbd")


def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return rounded(images.near_constant(li, ["l_linenumber", "l_returnflag", "l_tax", "l_partkey", "one"]), "ratio", "distinct_share")


QUERIES = {f.__name__: f for f in (region_features, grid_statistics, projections, focus_planes, normalised_values, segmentation_information, segmentation_dice, constant_columns)}

SQL = {
    "region_features": f"""WITH {_PIXELS}, m AS (SELECT l_returnflag, label, avg(value) AS mu, stddev_pop(value) AS sd FROM p WHERE label > 0 GROUP BY 1, 2)
      SELECT l_returnflag, label, count(*) AS area, round(avg(y), 4) AS centre_y, round(avg(x), 4) AS centre_x, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS low, round(max(value), 4) AS high,
      round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, round(quantile_cont(value, 0.5), 4) AS median, round(avg(pow((value - mu) / sd, 3)), 4) AS skew, round(avg(pow((value - mu) / sd, 4)) - 3, 4) AS kurtosis FROM p JOIN m USING (l_returnflag, label) GROUP BY 1, 2""",
    "grid_statistics": f"WITH {_PIXELS} SELECT z, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM p WHERE y % 4 = 0 AND x % 4 = 0 GROUP BY 1",
    "projections": f"WITH {_PIXELS} SELECT l_returnflag, y, x, max(value) AS value FROM p GROUP BY 1, 2, 3",
    "focus_planes": f"WITH {_PIXELS}, s AS (SELECT label, z, stddev_pop(value) AS power FROM p GROUP BY 1, 2) SELECT label, (array_agg(z ORDER BY power DESC, z))[1] AS plane, round(max(power) - avg(power), 4) AS lead FROM s GROUP BY 1",
    "normalised_values": f"WITH {_PIXELS}, n AS (SELECT label, z, (value - avg(value) OVER (PARTITION BY label)) / (stddev_pop(value) OVER (PARTITION BY label) + 1e-8) AS v FROM p) SELECT label, z, round(avg(v), 6) AS mean, round(max(v), 6) AS most FROM n GROUP BY 1, 2",
    "segmentation_information": f"""WITH {_PIXELS}, j AS (SELECT l_returnflag, label, other, count(*) AS n FROM p GROUP BY 1, 2, 3), s AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) AS total, sum(n) OVER (PARTITION BY l_returnflag, label) AS na, sum(n) OVER (PARTITION BY l_returnflag, other) AS nb FROM j)
      SELECT l_returnflag, round(-sum(n / total * log2(n / nb)), 6) AS a_given_b, round(-sum(n / total * log2(n / na)), 6) AS b_given_a FROM s GROUP BY 1""",
    "segmentation_dice": f"""WITH {_PIXELS}, c AS (SELECT label, other, count(*) AS n FROM p WHERE label > 0 AND other > 0 GROUP BY 1, 2), a AS (SELECT label, count(*) AS n FROM p WHERE label > 0 GROUP BY 1), b AS (SELECT other, count(*) AS n FROM p WHERE other > 0 GROUP BY 1),
      i AS (SELECT c.label, c.other, c.n / (a.n + b.n - c.n)::DOUBLE AS iou FROM c JOIN a ON a.label = c.label JOIN b ON b.other = c.other), x AS (SELECT avg(2 * m / (1 + m)) AS d FROM (SELECT coalesce(max(iou), 0) AS m FROM a LEFT JOIN i USING (label) GROUP BY label)), y AS (SELECT avg(2 * m / (1 + m)) AS d FROM (SELECT coalesce(max(iou), 0) AS m FROM b LEFT JOIN i USING (other) GROUP BY other))
      SELECT round(x.d, 6) AS dice_label, round(y.d, 6) AS dice_other, round((x.d + y.d) / 2, 6) AS sbd FROM x, y""",
    "constant_columns": """WITH l AS (SELECT 'l_linenumber' AS "column", l_linenumber::VARCHAR AS v FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem UNION ALL SELECT 'l_tax', l_tax::VARCHAR FROM lineitem UNION ALL SELECT 'l_partkey', l_partkey::VARCHAR FROM lineitem UNION ALL SELECT 'one', '1' FROM lineitem),
      c AS (SELECT "column", v, count(*) AS n FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS r FROM c), a AS (SELECT "column", coalesce(max(n) FILTER (r = 2), 0) / max(n) FILTER (r = 1)::DOUBLE AS ratio, count(*) / sum(n)::DOUBLE AS s FROM r GROUP BY 1)
      SELECT "column", round(ratio, 6) AS ratio, round(s, 6) AS distinct_share, ratio < 0.05 OR s < 0.01 AS drop FROM a""",
}
