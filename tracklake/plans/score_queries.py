"""Queries of scores, each with its SQL where that can say it; tests/test_scores.py holds the others against numpy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import scores
from tracklake.plans.common import EVENTS, events, positive, rounded, table


def uncorrelated_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the vectors of each label, which components stay when pairs over 0.2 are pruned."""
    return scores.uncorrelated(table(spark, sf_dir, "embeddings"), "label", "embedding", 0.2)


def label_effective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.effective_rank(table(spark, sf_dir, "embeddings"), "label", "embedding"), "effective_rank", digits=4)


def label_frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.frechet_distance(table(spark, sf_dir, "embeddings"), "label", 1, 2, "embedding"), "distance", digits=4)


def zscored_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity", F.when(F.col("l_linenumber") < 6, F.col("l_discount")).otherwise(0.0).alias("target"))
    return rounded(scores.zscored_sides(x, ["l_returnflag"], "l_linenumber", "l_quantity", "target"), "l_quantity", "target", digits=4)


def language_source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.clustering_agreement(table(spark, sf_dir, "documents"), "lang", "source"), "nmi", "ari")


def error_indistinguishability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.indistinguishability(events(spark, sf_dir).withColumn("p", positive()), ["user_id"], "value", "p"), "indistinguishability")


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rounded(scores.score_summary(d, ["source", "lang"], "quality"), "mean_score")


def finite_tax_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(math.inf).alias("ratio"))
    return rounded(scores.finite_reduced(x, ["l_orderkey"], "ratio"), "mean")


def dense_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.dense_windows(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_tax", 0.9), "share")


def warp_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id"), (F.col("user_id") % 3).alias("cohort"), "t", "value", F.lit(60.0).alias("bar"), (F.col("t") * 1.5 - 2).alias("warped"))
    return rounded(scores.onset_comparison(e, "cohort", ["user_id"], "value", "bar", "t", "warped"), "median_unwarped", "median_warped", "difference")


def cohort_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "t", "event_type")
    first = e.where(positive()).groupBy("user_id").agg(F.min("t").alias("t_zero"), F.count("*").alias("n_errors"))
    return scores.with_cohorts(e.drop("event_type"), first, ["user_id"], "t", "t_zero", 30.0)


def routed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of price on quantity for each return flag but N, and each row predicted by its own."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    lines = x.where("l_returnflag <> 'N'").groupBy("l_returnflag").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("w"), F.regr_intercept("l_extendedprice", "l_quantity").alias("bias"))
    return rounded(scores.routed_predictions(x.drop("l_extendedprice"), lines, "l_returnflag", ["l_quantity"], ["w"], "bias"), "prediction", digits=2)


def routed_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tasks, a model for each task and return flag (none of N for one, none of A for the other), learnt from all lines: discriminants of equal variances."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    taught = x.select("l_returnflag", "l_quantity", "l_discount", F.explode(F.array(
        F.struct(F.lit("line").alias("task"), F.when(F.col("l_linenumber") < 3, "early").when(F.col("l_linenumber") < 5, "middle").otherwise("late").alias("class")),
        F.struct(F.lit("tax").alias("task"), F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("class")),
    )).alias("t")).select("l_returnflag", "l_quantity", "l_discount", "t.*").where("(task = 'line' AND l_returnflag <> 'N') OR (task = 'tax' AND l_returnflag <> 'A')")
    spread = taught.groupBy("task", "l_returnflag").agg(F.var_pop("l_quantity").alias("vq"), F.var_pop("l_discount").alias("vd"), F.count("*").alias("all"))
    centres = taught.groupBy("task", "l_returnflag", "class").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.count("*").alias("n"))
    models = centres.join(spread, ["task", "l_returnflag"]).selectExpr("task", "l_returnflag", "class", "array(q / vq, d / vd) AS w", "ln(n / all) - (q * q / vq + d * d / vd) / 2 AS b")
    r = scores.routed_classes(x.drop("l_tax"), models, "task", "l_returnflag", "class", "w", "b", ["l_quantity", "l_discount"])
    return r.select("l_orderkey", "l_linenumber", "l_returnflag", "task", "prediction", F.array_join("classes", ",").alias("classes"), F.round(F.get("probabilities", F.lit(0)), 5).alias("first_class"))


def first_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.first_positions(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 3)


def alignment_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "t", "event_type")
    return scores.alignment_queries(e, ["user_id"], F.col("event_type") != "error", 30.0, 100.0, 3, 4, 45.0, 60.0)


def resampled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as a template over their ids, every 25 ids: all components."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").cast("double").alias("at"), F.col("embedding").cast("array<double>").alias("v"))
    r = scores.resampled_template(e, "label", "at", "v", 25.0)
    return rounded(r.select("label", "step", "time", F.posexplode("v").alias("i", "x")), "time", "x", digits=4)


QUERIES = {f.__name__: f for f in (
    uncorrelated_components, label_effective_rank, label_frechet, zscored_prices, language_source_agreement, error_indistinguishability, quality_summary, finite_tax_ratio, dense_orders, warp_comparison, cohort_minutes,
    routed_prices, routed_line_classes, first_brands, alignment_queries, resampled_labels,
)}

_Z = "round(({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-8), 4) AS {c}"

SQL = {
    "zscored_prices": f"""WITH x AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_quantity, CASE WHEN l_linenumber < 6 THEN l_discount ELSE 0.0::DOUBLE END AS target FROM lineitem),
      z AS (SELECT l_orderkey, l_returnflag, l_linenumber, {_Z.format(c='l_quantity')}, {_Z.format(c='target')}, max(abs(x.target)) OVER w AS most FROM x WINDOW w AS (PARTITION BY l_returnflag, l_linenumber)) SELECT * EXCLUDE most FROM z WHERE most > 0""",
    "language_source_agreement": """WITH c AS (SELECT lang, source, count(*)::DOUBLE AS c FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), a AS (SELECT sum(c) AS c FROM c GROUP BY lang), b AS (SELECT sum(c) AS c FROM c GROUP BY source), n AS (SELECT sum(c) AS n FROM c),
      e AS (SELECT n, (SELECT -sum(c / n * ln(c / n)) FROM c) AS h, (SELECT -sum(c / n * ln(c / n)) FROM a) AS ha, (SELECT -sum(c / n * ln(c / n)) FROM b) AS hb, (SELECT sum(c * (c - 1) / 2) FROM c) AS p, (SELECT sum(c * (c - 1) / 2) FROM a) AS pa, (SELECT sum(c * (c - 1) / 2) FROM b) AS pb FROM n)
      SELECT n::BIGINT AS n, round(2 * (ha + hb - h) / (ha + hb), 6) AS nmi, round((p - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari FROM e""",
    "error_indistinguishability": f"""WITH {EVENTS}, d AS (SELECT user_id, event_type = 'error' AS p, value FROM e WHERE value IS NOT NULL), w AS (SELECT x.user_id, avg(CASE WHEN x.value > y.value THEN 1.0 WHEN x.value = y.value THEN 0.5 ELSE 0.0 END) AS auc FROM d x JOIN d y ON x.user_id = y.user_id AND x.p AND NOT y.p GROUP BY 1)
      SELECT user_id, round(1 - 2 * abs(auc - 0.5), 6) AS indistinguishability FROM (SELECT DISTINCT user_id FROM d) LEFT JOIN w USING (user_id)""",
    "quality_summary": "SELECT source, lang, round(avg(quality), 6) AS mean_score, count(quality) AS n_scores FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "finite_tax_ratio": "SELECT l_orderkey, round(avg(l_tax / l_discount) FILTER (l_discount > 0), 6) AS mean, count(*) FILTER (l_discount > 0) AS n FROM lineitem GROUP BY 1",
    "dense_orders": "SELECT l_orderkey, round(avg((l_tax <> 0)::INT), 6) AS share FROM lineitem GROUP BY 1 HAVING avg((l_tax <> 0)::INT) >= 0.9",
    "warp_comparison": f"""WITH {EVENTS}, o AS (SELECT user_id % 3 AS cohort, user_id, min(t) FILTER (value > 60) AS u, min(t * 1.5::DOUBLE - 2) FILTER (value > 60) AS w FROM e GROUP BY 1, 2), m AS (SELECT cohort, count(u) AS n_unwarped, count(w) AS n_warped, median(u)::DOUBLE AS median_unwarped, median(w)::DOUBLE AS median_warped FROM o GROUP BY 1)
      SELECT *, abs(median_warped - median_unwarped) AS difference, coalesce(abs(median_unwarped) > 0 AND abs(median_warped - median_unwarped) > 0.25 * abs(median_unwarped), false) AS diverges FROM m""",
    "cohort_minutes": f"WITH {EVENTS}, f AS (SELECT user_id, min(t) AS t_zero, count(*) AS n_errors FROM e WHERE event_type = 'error' GROUP BY 1) SELECT event_id, user_id, t, t_zero, n_errors, (t - t_zero) * 30.0::DOUBLE AS minutes FROM e LEFT JOIN f USING (user_id)",
    "routed_prices": """WITH m AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS bias FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
      SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, round(bias + w * l_quantity, 2) AS prediction FROM lineitem LEFT JOIN m USING (l_returnflag)""",
    "routed_line_classes": """WITH l AS (SELECT row_number() OVER () AS rid, * FROM lineitem), u AS (SELECT l_returnflag, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, 'line' AS task, CASE WHEN l_linenumber < 3 THEN 'early' WHEN l_linenumber < 5 THEN 'middle' ELSE 'late' END AS class FROM lineitem WHERE l_returnflag <> 'N'
        UNION ALL SELECT l_returnflag, l_quantity::DOUBLE, l_discount::DOUBLE, 'tax', CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END FROM lineitem WHERE l_returnflag <> 'A'),
      v AS (SELECT task, l_returnflag, var_pop(q) AS vq, var_pop(d) AS vd, count(*) AS every FROM u GROUP BY 1, 2), c AS (SELECT task, l_returnflag, class, avg(q) AS q, avg(d) AS d, count(*) AS n FROM u GROUP BY 1, 2, 3),
      m AS (SELECT task, l_returnflag, class, q / vq AS wq, d / vd AS wd, ln(n / every) - (q * q / vq + d * d / vd) / 2 AS b FROM c JOIN v USING (task, l_returnflag)),
      s AS (SELECT rid, task, class, b + wq * l_quantity + wd * l_discount AS z FROM l JOIN m USING (l_returnflag)),
      p AS (SELECT rid, task, arg_max(class, z) AS prediction, max(z) AS top, arg_min(z, class) AS first FROM s GROUP BY 1, 2), e AS (SELECT rid, task, sum(exp(z - top)) AS total FROM s JOIN p USING (rid, task) GROUP BY 1, 2),
      k AS (SELECT task, string_agg(DISTINCT class, ',' ORDER BY class) AS classes FROM u GROUP BY 1)
      SELECT l_orderkey, l_linenumber, l_returnflag, task, prediction, classes, round(exp(first - top) / total, 5) AS first_class FROM l CROSS JOIN k LEFT JOIN p USING (rid, task) LEFT JOIN e USING (rid, task)""",
    "first_brands": "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 3)",
    "alignment_queries": f"WITH {EVENTS} SELECT event_id, user_id, t, event_type FROM e WHERE event_type <> 'error' QUALIFY count(*) OVER (PARTITION BY user_id) >= 8",
    "resampled_labels": """WITH e AS (SELECT label, vec_id::DOUBLE AS pos, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT label, min(pos) AS lo, max(pos) AS hi, round((max(pos) - min(pos)) / 25)::INT AS n FROM e GROUP BY 1),
      g AS (SELECT label, n, unnest(range(0, n + 1))::INT AS step, lo, hi FROM s WHERE n >= 1), t AS (SELECT label, step, CASE WHEN step = n THEN hi ELSE lo + step * ((hi - lo) / n) END AS time FROM g),
      l AS (SELECT *, lead(pos) OVER w AS pos2, lead(v) OVER w AS v2, max(pos) OVER (PARTITION BY label) AS top FROM e WINDOW w AS (PARTITION BY label ORDER BY pos)),
      x AS (SELECT label, step, time, (time - pos) / (pos2 - pos) AS share, unnest(v) AS a, unnest(v2) AS b, unnest(range(len(v))) AS i FROM t JOIN l USING (label) WHERE pos2 IS NOT NULL AND time >= pos AND (time < pos2 OR (time = pos2 AND pos2 = top))),
      y AS (SELECT label, step, time, i, a + (b - a) * share AS x FROM x), n AS (SELECT label, step, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM y GROUP BY 1, 2)
      SELECT label, step, round(time, 4) AS time, i::INT AS i, round(x / n, 4) AS x FROM y JOIN n USING (label, step)""",
}
