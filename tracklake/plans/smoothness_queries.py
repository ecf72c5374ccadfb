"""Smoothness of embeddings as tracks of twenty, two models in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import smoothness
from tracklake.plans.common import rounded, table


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("cast(vec_id div 20 % 2 AS int) AS model", "vec_id div 20 AS track", "vec_id % 20 AS t", "embedding")


def model_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = smoothness.smoothness(_tracks(spark, sf_dir), ["model"], ["track"], "t", "embedding", (1, 3), "euclidean", peaks=False)
    return rounded(s, *[c for c in s.columns if c not in ("model", "n")])


def model_smoothness_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = smoothness.smoothness(_tracks(spark, sf_dir), ["model"], ["track"], "t", "embedding")
    return rounded(s, *[c for c in s.columns if c not in ("model", "n")], digits=4)


def price_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each priority the tallest inner bin of fifty, flat ones by their middle."""
    return rounded(smoothness.distribution_peaks(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "histogram"), "peak", digits=4)


QUERIES = {f.__name__: f for f in (model_smoothness, model_smoothness_peaks, price_peaks)}

_N = "('0x' || substr(md5('42|' || key || '|' || k || '|{}'), 1, 12))::BIGINT"

SQL = {
    "model_smoothness": f"""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT vec_id // 20 % 2 AS model, i, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-10 THEN 1 ELSE stddev_pop(v) END AS d FROM u GROUP BY 1, 2),
      z AS (SELECT vec_id, vec_id // 20 % 2 AS model, vec_id // 20 AS track, vec_id % 20 AS t, list((v - m) / d ORDER BY u.i) AS v FROM u JOIN s ON s.i = u.i AND s.model = vec_id // 20 % 2 GROUP BY vec_id),
      x AS (SELECT *, track || '|' || t AS key, row_number() OVER (PARTITION BY model ORDER BY md5('42|' || track || '|' || t)) - 1 AS at, count(*) OVER (PARTITION BY model) AS n, row_number() OVER (PARTITION BY track ORDER BY t) AS r FROM z),
      a AS (SELECT p.*, q.v AS w, o.k FROM x p JOIN (VALUES (0, 1), (1, 3)) o(k, later) ON true JOIN x q ON q.track = p.track AND q.r = p.r + o.later),
      e AS (SELECT model, n, {_N.format("i")} % n AS i, {_N.format("j")} % (n - 1) AS j FROM a), d AS (SELECT model, 'adjacent' AS kind, list_distance(v, w) AS d FROM a UNION ALL
        SELECT e.model, 'random', list_distance(p.v, q.v) FROM e JOIN x p ON p.model = e.model AND p.at = e.i JOIN x q ON q.model = e.model AND q.at = e.j + (e.j >= e.i)::INT),
      f AS (SELECT model, kind, count(*) AS n, avg(d) AS mean, stddev_pop(d) AS std, median(d) AS median FROM d GROUP BY 1, 2)
      SELECT a.model::INT AS model, a.n, round(a.mean, 6) AS adjacent_mean, round(a.std, 6) AS adjacent_std, round(a.median, 6) AS adjacent_median, round(r.mean, 6) AS random_mean, round(r.std, 6) AS random_std, round(r.median, 6) AS random_median, round(a.mean / r.mean, 6) AS smoothness
      FROM f a JOIN f r ON a.model = r.model AND a.kind = 'adjacent' AND r.kind = 'random'""",
    "price_peaks": """WITH g AS (SELECT o_orderpriority AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY 1), h AS (SELECT p, lo, hi, n, least(49, floor((o_totalprice - lo) / (hi - lo) * 50))::INT AS b, count(*) AS c FROM orders JOIN g ON p = o_orderpriority GROUP BY ALL),
      f AS (SELECT p, lo, hi, n, b.b, coalesce(c, 0) AS c FROM g JOIN (SELECT unnest(range(50)) AS b) b ON true LEFT JOIN (SELECT p AS q, b AS hb, c FROM h) ON q = p AND hb = b.b),
      r AS (SELECT *, b - row_number() OVER (PARTITION BY p, c ORDER BY b) AS island FROM f), k AS (SELECT p, lo, hi, n, c, min(b) AS first, max(b) AS last FROM r GROUP BY p, lo, hi, n, c, island),
      m AS (SELECT k.*, x.c AS before, y.c AS after FROM k LEFT JOIN f x ON x.p = k.p AND x.b = first - 1 LEFT JOIN f y ON y.p = k.p AND y.b = last + 1), t AS (SELECT p, max(c) AS most FROM f GROUP BY p),
      best AS (SELECT m.p, arg_min((first + last) // 2, (-m.c, first)) AS b FROM m JOIN t ON t.p = m.p WHERE before < m.c AND after < m.c AND m.c >= 0.1 * most GROUP BY m.p), top AS (SELECT p, arg_min(b, (-c, b)) AS b FROM f GROUP BY p)
      SELECT g.p AS o_orderpriority, n, round(lo + (coalesce(best.b, top.b) + 0.5) * (hi - lo) / 50, 4) AS peak FROM g LEFT JOIN best ON best.p = g.p JOIN top ON top.p = g.p""",
}
