"""Textures and shapes of regions in grids of line items' mean prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import textures
from tracklake.plans.common import rounded, table

SIDE = 24


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full grid of 24 x 24 places for each line number: the mean price of the line items that fall on a place, 0 without any; labels are slanted bands."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("image"), (F.col("l_orderkey") % SIDE).alias("y"), (F.col("l_partkey") % SIDE).alias("x")).agg(F.avg("l_extendedprice").alias("v"))
    n = spark.range(SIDE * SIDE).select((F.col("id") % SIDE).alias("x"), F.expr(f"id div {SIDE}").alias("y"))
    full = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("image")).distinct().join(F.broadcast(n))  # a grid for each image
    band = F.expr("CASE WHEN (x - 12) * (x - 12) + (y - 12) * (y - 12) > 120 THEN 0 ELSE 1 + (x + 2 * y) div 17 END").cast("long")
    return full.join(li, ["image", "y", "x"], "left").select("image", "y", "x", band.alias("label"), F.coalesce("v", F.lit(0.0)).alias("value"))


def region_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = textures.texture_features(grids(spark, sf_dir), ["image"], "label", "value", levels=8)
    return rounded(t, *[c for c in t.columns if c not in ("image", "label")])


def region_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = textures.shapes(grids(spark, sf_dir), ["image"], "label", "value")
    return rounded(s, "perimeter_area", "eccentricity", "masked_intensity", "localization", digits=4)


QUERIES = {f.__name__: f for f in (region_textures, region_shapes)}

_GRID = f"""g AS (SELECT l_linenumber AS image, l_orderkey % {SIDE} AS y, l_partkey % {SIDE} AS x, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT id % {SIDE} AS x, id // {SIDE} AS y FROM (SELECT unnest(range({SIDE * SIDE})) AS id)),
      p AS (SELECT i.image, n.y, n.x, CASE WHEN (n.x - 12) * (n.x - 12) + (n.y - 12) * (n.y - 12) > 120 THEN 0 ELSE 1 + (n.x + 2 * n.y) // 17 END AS label, coalesce(v, 0) AS value FROM (SELECT DISTINCT image FROM g) i CROSS JOIN n LEFT JOIN g ON g.image = i.image AND g.y = n.y AND g.x = n.x)"""

SQL = {
    "region_textures": f"""WITH {_GRID}, q AS (SELECT image, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM p GROUP BY 1), s AS (SELECT image, y, x, label, CASE WHEN hi > lo THEN (least(greatest(value, lo), hi) - lo) / (hi - lo) ELSE 0 END AS v FROM p JOIN q USING (image)),
      m AS (SELECT image, label, avg(v) AS mu, stddev_pop(v) AS sd FROM s WHERE label > 0 GROUP BY 1, 2),
      b AS (SELECT image, label, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, avg(pow((v - mu) / sd, 3)) AS skew, avg(pow((v - mu) / sd, 4)) - 3 AS kurtosis FROM s JOIN m USING (image, label) GROUP BY 1, 2),
      o AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
      e AS (SELECT a.image, a.label, a.y, a.x, sum(dy * (2 - abs(dx)) / 4.0::DOUBLE * c.v) AS gy, sum(dx * (2 - abs(dy)) / 4.0::DOUBLE * c.v) AS gx, sum(CASE abs(dy) + abs(dx) WHEN 0 THEN -4 WHEN 1 THEN 1 ELSE 0 END * c.v) AS lap FROM s a, o JOIN s c ON c.image = a.image AND c.y = least(greatest(a.y + dy, 0), {SIDE - 1}) AND c.x = least(greatest(a.x + dx, 0), {SIDE - 1}) WHERE a.label > 0 GROUP BY 1, 2, 3, 4),
      t AS (SELECT image, label, avg(sqrt((gy * gy + gx * gx) / 2)) AS gradient_mean, stddev_pop(sqrt((gy * gy + gx * gx) / 2)) AS gradient_std, var_pop(lap) AS laplacian_var FROM e GROUP BY 1, 2),
      l AS (SELECT image, label, y, x, least(greatest(floor(v * 8), 0), 7) AS k FROM s WHERE label > 0), w AS (SELECT a.image, a.label, a.k AS a, c.k AS b FROM l a JOIN (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) d(dy, dx) ON true JOIN l c ON c.image = a.image AND c.label = a.label AND c.y = a.y + dy AND c.x = a.x + dx),
      z AS (SELECT image, label, a, b, count(*) AS n FROM (SELECT * FROM w UNION ALL SELECT image, label, b, a FROM w) GROUP BY 1, 2, 3, 4), f AS (SELECT *, n / sum(n) OVER (PARTITION BY image, label) AS q, sum(n * a) OVER (PARTITION BY image, label) / sum(n) OVER (PARTITION BY image, label) AS mu FROM z),
      h AS (SELECT image, label, sum(q * (a - b) * (a - b)) AS contrast, sum(q * abs(a - b)) AS dissimilarity, sum(q / (1 + (a - b) * (a - b))) AS homogeneity, sum(q * q) AS asm, sqrt(sum(q * q)) AS energy, CASE WHEN sum(q * pow(a - mu, 2)) > 1e-15 THEN sum(q * (a - mu) * (b - mu)) / sum(q * pow(a - mu, 2)) ELSE 1 END AS correlation, -sum(q * ln(q)) AS entropy FROM f GROUP BY 1, 2)
      SELECT image, label, {", ".join(f"round({c}, 6) AS {c}" for c in "mean std low high p10 p25 p50 p75 p90".split())}, round(p75 - p25, 6) AS iqr, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, {", ".join(f"round({c}, 6) AS {c}" for c in "gradient_mean gradient_std laplacian_var contrast dissimilarity homogeneity asm energy correlation entropy".split())}
      FROM b JOIN t USING (image, label) LEFT JOIN h USING (image, label)""",
    "region_shapes": f"""WITH {_GRID}, r AS (SELECT * FROM p WHERE label > 0), a AS (SELECT image, label, count(*) AS area, sum(value) AS mass, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(y, x) AS xy FROM r GROUP BY 1, 2),
      s AS (SELECT a.image, a.label, count(*) AS shared FROM r a JOIN r b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2),
      o AS (SELECT y, x, 0 AS k FROM (SELECT unnest(range(-1, {SIDE + 1})) AS y), (SELECT unnest(range(-1, {SIDE + 1})) AS x)), d AS (SELECT a.image, a.label, a.value, sqrt(min(pow(a.y - o.y, 2) + pow(a.x - o.x, 2))) AS d FROM r a JOIN o ON true LEFT JOIN r b ON b.image = a.image AND b.label = a.label AND b.y = o.y AND b.x = o.x WHERE b.y IS NULL GROUP BY a.image, a.label, a.y, a.x, a.value),
      m AS (SELECT image, label, max(d) AS most FROM d GROUP BY 1, 2), l AS (SELECT image, label, avg(value * d / most) / nullif(avg(value), 0) AS localization FROM d JOIN m USING (image, label) GROUP BY 1, 2)
      SELECT image, label, area, (4 * area - coalesce(shared, 0))::BIGINT AS perimeter, round((4 * area - coalesce(shared, 0)) / area, 4) AS perimeter_area, round(CASE WHEN yy + xx > 0 THEN sqrt(greatest(0, 1 - ((yy + xx) / 2 - sqrt(pow((yy - xx) / 2, 2) + xy * xy)) / ((yy + xx) / 2 + sqrt(pow((yy - xx) / 2, 2) + xy * xy)))) ELSE 0 END, 4) AS eccentricity,
      round(mass, 4) AS masked_intensity, round(localization, 4) AS localization FROM a LEFT JOIN s USING (image, label) JOIN l USING (image, label)""",
}
