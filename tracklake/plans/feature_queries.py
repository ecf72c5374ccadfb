"""Embeddings of the first five labels as found vectors, the others as true ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import feature_scores
from tracklake.operators.batches import STRIDES
from tracklake.plans.common import rounded, table


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("found", F.col("label") < 5)


def label_kernel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_scores.kernel_distance(_sides(spark, sf_dir), "found", "embedding", "vec_id", subsets=5, size=60), "mean", "std")


def label_manifold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = feature_scores.manifold_scores(_sides(spark, sf_dir), "found", "embedding", "vec_id", resamples=4, size=80)
    return rounded(m, *m.columns)


def label_sliced_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_scores.sliced_transport(_sides(spark, sf_dir), "found", "embedding", "vec_id", projections=4), "distance")


def neighbour_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with that of the next id."""
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return rounded(feature_scores.median_cosine(pairs, "a", "b"), "median")


QUERIES = {f.__name__: f for f in (label_kernel_distance, label_manifold_scores, label_sliced_transport, neighbour_cosine)}


def _number(*of: str) -> str:
    return f"('0x' || substr(md5('2020|' || {' || chr(124) || '.join(of)}), 1, 12))::BIGINT"


_PLACED = "p AS (SELECT label < 5 AS side, CASE WHEN label < 5 THEN 'true' ELSE 'false' END AS name, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label < 5 ORDER BY md5('2020|' || vec_id)) - 1 AS place, count(*) OVER (PARTITION BY label < 5) AS n FROM embeddings)"

SQL = {
    "label_kernel_distance": f"""WITH {_PLACED}, m AS (SELECT least(60, min(n)) AS m FROM p),
      s AS (SELECT *, [{", ".join(map(str, STRIDES))}][{_number("s", "name", "'stride'")} % {len(STRIDES)} + 1] AS stride, {_number("s", "name", "'start'")} AS start FROM p, (SELECT unnest(range(5)) AS s)),
      x AS (SELECT s, side, place, e FROM s, m WHERE (place * (stride % n) + start % n) % n < m),
      k AS (SELECT a.s, a.side AS sa, b.side AS sb, sum(CASE WHEN a.side = b.side AND a.place = b.place THEN 0 ELSE pow(list_inner_product(a.e, b.e) / len(a.e) + 1, 3) END) AS k FROM x a JOIN x b ON a.s = b.s GROUP BY ALL),
      d AS (SELECT s, sum(CASE WHEN sa = sb THEN k / (m * (m - 1)) ELSE -k / (m * m) END) AS d FROM k, m GROUP BY s)
      SELECT max(m)::BIGINT AS size, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std FROM d, m""",
    "label_manifold_scores": f"""WITH {_PLACED}, n AS (SELECT name, side, any_value(n) AS n FROM p GROUP BY ALL), q AS (SELECT r, k, name, side, {_number("r", "name", "k")} % n AS place FROM n, (SELECT unnest(range(4)) AS r), (SELECT unnest(range(80)) AS k)),
      x AS (SELECT r, k, side, e FROM q JOIN p USING (name, side, place)), d AS (SELECT a.r, a.side AS sa, a.k AS ka, b.side AS sb, b.k AS kb, list_distance(a.e, b.e) AS d FROM x a JOIN x b ON a.r = b.r),
      radius AS (SELECT r, sa AS side, ka AS k, d AS radius FROM d WHERE sa = sb QUALIFY row_number() OVER (PARTITION BY r, sa, ka ORDER BY d) = 4),
      c AS (SELECT d.r, d.sa AS side, d.ka, bool_or(d.d <= radius) AS c FROM d JOIN radius t ON t.r = d.r AND t.side = d.sb AND t.k = d.kb WHERE d.sa <> d.sb GROUP BY ALL),
      s AS (SELECT r, avg(c::INT) FILTER (side) AS p, avg(c::INT) FILTER (NOT side) AS q FROM c GROUP BY r), f AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f FROM s)
      SELECT round(avg(p), 6) AS precision_mean, round(stddev_pop(p), 6) AS precision_std, round(avg(q), 6) AS recall_mean, round(stddev_pop(q), 6) AS recall_std, round(avg(f), 6) AS f1_mean, round(stddev_pop(f), 6) AS f1_std FROM f""",
    "label_sliced_transport": f"""WITH u AS (SELECT unnest(range(4)) AS direction, unnest({feature_scores.directions(64, 4, 2020).tolist()}::DOUBLE[][]) AS u),
      v AS (SELECT direction, label < 5 AS side, list_inner_product(embedding::DOUBLE[], u) AS v, vec_id FROM embeddings, u), r AS (SELECT *, row_number() OVER (PARTITION BY direction, side ORDER BY v, vec_id) - 1 AS r, count(*) OVER (PARTITION BY direction, side) AS n FROM v),
      j AS (SELECT least((a.r + 1) * b.n, (b.r + 1) * a.n) - greatest(a.r * b.n, b.r * a.n) AS mass, a.v - b.v AS gap, a.n * b.n AS total FROM r a JOIN r b ON a.direction = b.direction AND a.side AND NOT b.side AND a.r * b.n < (b.r + 1) * a.n AND b.r * a.n < (a.r + 1) * b.n)
      SELECT round(sum(mass * gap * gap / total) / 4, 6) AS distance FROM j""",
    "neighbour_cosine": "SELECT count(*) AS n, round(median(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS median FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
