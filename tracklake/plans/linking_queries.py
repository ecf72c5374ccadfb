"""Parts as objects: price and size give a place, brands are images, and the retail price's digits a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import linking
from tracklake.plans.common import rounded, table


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.substring("p_brand", 1, 7).alias("image"), (F.col("p_partkey") % 12).cast("int").alias("t"), (F.col("p_retailprice") % 97).alias("y"), (F.col("p_size") * 2.0).alias("x"))


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linking.candidate_edges(objects(spark, sf_dir), ["image"], "t", "id", "y", "x", 9.0, 3, 2), "distance", "weight")


def linked_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    return linking.tracks_of(o, "id", linking.linked(linking.candidate_edges(o, ["image"], "t", "id", "y", "x", 9.0, 3, 2), ["image"])).select("id", "image", "t", "track")


QUERIES = {f.__name__: f for f in (link_candidates, linked_tracks)}

SQL = {
    "link_candidates": """WITH o AS (SELECT p_partkey AS id, substr(p_brand, 1, 7) AS image, (p_partkey % 12)::INT AS t, p_retailprice % 97 AS y, p_size * 2.0::DOUBLE AS x FROM part),
      e AS (SELECT a.image, a.id AS source, b.id AS target, a.t, b.t - a.t AS dt, sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) AS d FROM o a JOIN o b ON a.image = b.image AND b.t - a.t BETWEEN 1 AND 2 WHERE sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) <= 9)
      SELECT image, source, target, t, dt::INT AS dt, round(d, 6) AS distance, round(exp(-d / 9) / dt, 6) AS weight FROM e QUALIFY row_number() OVER (PARTITION BY source, dt ORDER BY d, target) <= 3""",
}
