"""Clusters of embeddings and how they agree with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import clusters, scores
from tracklake.plans.common import rounded, table

EPS, LEAST = 1.16, 5


def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dbscan(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS, LEAST)


def cluster_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised mutual information and adjusted Rand index of clusters (noise is one of them) and labels."""
    c = embedding_clusters(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return rounded(scores.clustering_agreement(c.withColumn("cluster", F.coalesce("cluster", F.lit(-1))), "cluster", "label"), "nmi", "ari")


QUERIES = {f.__name__: f for f in (embedding_clusters, cluster_label_agreement)}

_CLUSTERS = f"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON list_distance(a.e, b.e) <= {EPS}),
      c AS (SELECT a FROM n GROUP BY a HAVING count(*) >= {LEAST}), l AS (SELECT n.a, n.b FROM n JOIN c x ON x.a = n.a JOIN c y ON y.a = n.b),
      r AS (SELECT a, a AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), k AS (SELECT a, min(b) AS cluster FROM r GROUP BY a),
      z AS (SELECT vec_id, label, CASE WHEN k.a IS NOT NULL THEN k.cluster ELSE (SELECT min(o.cluster) FROM n JOIN k o ON o.a = n.b WHERE n.a = vec_id) END AS cluster, k.a IS NOT NULL AS core FROM e LEFT JOIN k ON k.a = vec_id)"""

SQL = {
    "embedding_clusters": f"{_CLUSTERS} SELECT vec_id, cluster, core FROM z",
    "cluster_label_agreement": f"""{_CLUSTERS}, q AS (SELECT coalesce(cluster, -1) AS cluster, label, count(*)::DOUBLE AS c FROM z GROUP BY 1, 2), a AS (SELECT sum(c) AS c FROM q GROUP BY cluster), b AS (SELECT sum(c) AS c FROM q GROUP BY label), t AS (SELECT sum(c) AS n FROM q),
      h AS (SELECT n, (SELECT -sum(c / n * ln(c / n)) FROM q) AS h, (SELECT -sum(c / n * ln(c / n)) FROM a) AS ha, (SELECT -sum(c / n * ln(c / n)) FROM b) AS hb, (SELECT sum(c * (c - 1) / 2) FROM q) AS p, (SELECT sum(c * (c - 1) / 2) FROM a) AS pa, (SELECT sum(c * (c - 1) / 2) FROM b) AS pb FROM t)
      SELECT n::BIGINT AS n, round(2 * (ha + hb - h) / (ha + hb), 6) AS nmi, round((p - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari FROM h""",
}
