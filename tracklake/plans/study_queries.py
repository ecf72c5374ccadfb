"""Queries of a study's steps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import study
from tracklake.plans.common import EVENTS, events, rounded, table


def inner_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "t", F.col("value").alias("y"), (F.col("event_id") % 97).cast("double").alias("x"))
    return study.inner_anchors(e, ["user_id"], "t", "y", "x", 100.0, 97.0, 5.0, 2)


def prefixed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.startswith("p_type", F.lit("STANDARD"))).groupBy("p_type").agg(F.count("*").alias("n"))


def annotation_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.concat(F.lit("/u"), F.col("user_id") % 5).alias("fov"), "t", "event_id")
    return study.annotation_subset(e, "fov", "t", ["u1", "u3"], [0, 2])


def focus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand and of all: mean, deviation, least and largest size."""
    p = table(spark, sf_dir, "part")
    g = p.groupingSets([[], [F.col("p_brand")]], F.col("p_brand"))
    return rounded(g.agg(F.avg("p_size").alias("mean"), F.stddev_pop("p_size").alias("std"), F.min("p_size").alias("min"), F.max("p_size").alias("max")), "mean", "std")


def priority_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("price"))
    return rounded(study.paired_difference(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"], "price"), "difference", digits=4)


def condition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return rounded(study.condition_pairs(c, ["c_nationkey"], "c_mktsegment", "BUILDING", "c_acctbal"), "mean", "control_mean", "difference")


def onset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return study.onset_pairs(study.onsets(e, ["user_id"], "t", F.col("value") > 60), study.onsets(e, ["user_id"], "t", F.col("event_type") == "error"), ["user_id"])


def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.registry(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source"], ["lang"], {"n_chars": "doc_id"})


def plane_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 0.37).alias("focus"), (F.col("p_partkey") % 19 + 3).cast("int").alias("depth"))
    return rounded(study.z_ranges(p, "focus", "depth", 7), "focus")


def match_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("region", F.when(F.col("value") > 80, "aligned").otherwise("pre"))
    return study.match_bounds(e, ["user_id"], "t", "region")


def event_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return study.funnel(e, [("has a value", F.col("value").isNotNull()), ("value over 20", F.col("value") > 20), ("no error", F.col("event_type") != "error"), ("even user", F.col("user_id") % 2 == 0)])


def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("t % 3 = 0")
    return rounded(study.interpolated(e, ["user_id"], "t", "value"), "value")


def label_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic labels as 1, 0 or null, on all documents."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("toxic").isNotNull(), (F.col("toxic") == 1).cast("int")).alias("signal"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 9).alias("label"), "l_quantity", F.col("l_linenumber").alias("col"))
    return rounded(study.label_centroids(px, ["l_returnflag"], "label", "l_quantity", "col"), "y", "x")


def replica_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.sharded_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 4, "r1")


def group_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.batch_plan(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_custkey", ["c_nationkey"], 8, "b1")


def stratified_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.batch_plan(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), "c_custkey", ["c_nationkey"], 10, "b2", "c_mktsegment")


def balance_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.histogram_peak(table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal"), "peak", digits=4)


def melted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each order line as rows, averaged by flag."""
    long = table(spark, sf_dir, "lineitem").unpivot(["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")
    return rounded(long.groupBy("l_returnflag", "measure").agg(F.avg("value").alias("mean")), "mean")


def scale_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference size over own size, by which an image is scaled; 1 where a size is missing or zero."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size") % 4, F.lit(0)).alias("s"))
    return rounded(p.select("p_partkey", F.coalesce(3.0 / F.col("s"), F.lit(1.0)).alias("scale")), "scale")


QUERIES = {f.__name__: f for f in (
    inner_anchors, prefixed_channels, annotation_subset, focus_stats, priority_difference, condition_pairs, onset_pairs, source_registry, plane_ranges, match_bounds, event_funnel,
    interpolated_values, label_signals, label_centroids, replica_orders, group_batches, stratified_batches, balance_peaks, melted_prices, scale_factors,
)}

SQL = {
    "inner_anchors": f"WITH {EVENTS}, i AS (SELECT user_id, t, value AS y, (event_id % 97)::DOUBLE AS x FROM e WHERE value > 5 AND value < 95 AND event_id % 97 > 5 AND event_id % 97 < 92) SELECT * FROM i a WHERE EXISTS (SELECT 1 FROM i b WHERE b.user_id = a.user_id AND b.t = a.t + 2)",
    "prefixed_channels": "SELECT p_type, count(*) AS n FROM part WHERE starts_with(p_type, 'STANDARD') GROUP BY 1",
    "annotation_subset": f"WITH {EVENTS} SELECT 'u' || (user_id % 5) AS fov, t, event_id FROM e WHERE user_id % 5 IN (1, 3) AND t NOT IN (0, 2)",
    "focus_stats": "SELECT p_brand, round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS std, min(p_size) AS min, max(p_size) AS max FROM part GROUP BY GROUPING SETS ((), (p_brand))",
    "priority_difference": """WITH o AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2), j AS (SELECT count(*) AS n, avg(a.p - b.p) AS d FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'),
      m AS (SELECT avg(p) FILTER (o_orderstatus = 'F') - avg(p) FILTER (o_orderstatus = 'O') AS u FROM o) SELECT CASE WHEN n >= 5 THEN 'paired' ELSE 'unpaired' END AS mode, n, round(CASE WHEN n >= 5 THEN d ELSE u END, 4) AS difference FROM j, m""",
    "condition_pairs": """WITH g AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS mean, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2)
      SELECT a.c_nationkey, a.c_mktsegment, round(a.mean, 6) AS mean, a.n, round(b.mean, 6) AS control_mean, b.n AS control_n, round(a.mean - b.mean, 6) AS difference FROM g a JOIN g b ON a.c_nationkey = b.c_nationkey AND b.c_mktsegment = 'BUILDING' WHERE a.c_mktsegment <> 'BUILDING'""",
    "onset_pairs": f"WITH {EVENTS}, o AS (SELECT user_id, min(t) FILTER (value > 60) AS onset_a, min(t) FILTER (event_type = 'error') AS onset_b FROM e GROUP BY 1) SELECT *, onset_b - onset_a AS delay FROM o WHERE onset_a IS NOT NULL AND onset_b IS NOT NULL",
    "source_registry": "SELECT source, count(*) AS n, coalesce(string_agg(DISTINCT lang, ';' ORDER BY lang), '') AS lang_list, arg_min(n_chars, doc_id) FILTER (n_chars IS NOT NULL) AS n_chars FROM documents GROUP BY 1",
    "plane_ranges": """WITH p AS (SELECT p_partkey, p_size * 0.37::DOUBLE AS focus, (p_partkey % 19 + 3)::INT AS depth FROM part), s AS (SELECT *, least(7, depth) AS size FROM p), z AS (SELECT *, greatest(0, least(floor(focus + 0.5)::INT - 3, depth - size))::INT AS z_start FROM s)
      SELECT p_partkey, round(focus, 6) AS focus, depth, z_start, (z_start + size)::INT AS z_stop FROM z""",
    "match_bounds": f"WITH {EVENTS}, b AS (SELECT user_id, min(t) FILTER (value > 80) AS match_start, max(t) FILTER (value > 80) AS match_stop, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1) SELECT user_id, match_start, match_stop, match_start - lo AS before, hi - match_stop AS after FROM b WHERE match_start IS NOT NULL",
    "event_funnel": """WITH c AS (SELECT count(*) AS c0, count(*) FILTER (value IS NOT NULL) AS c1, count(*) FILTER (value > 20) AS c2, count(*) FILTER (value > 20 AND event_type <> 'error') AS c3, count(*) FILTER (value > 20 AND event_type <> 'error' AND user_id % 2 = 0) AS c4 FROM events)
      SELECT 1 AS step, 'has a value' AS name, c1 AS kept, c0 - c1 AS dropped FROM c UNION ALL SELECT 2, 'value over 20', c2, c1 - c2 FROM c UNION ALL SELECT 3, 'no error', c3, c2 - c3 FROM c UNION ALL SELECT 4, 'even user', c4, c3 - c4 FROM c""",
    "interpolated_values": f"""WITH {EVENTS}, g AS (SELECT user_id, t AS a, value AS v, lead(t) OVER w AS b, lead(value) OVER w AS u FROM e WHERE t % 3 = 0 AND value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t)), f AS (SELECT *, unnest(range(a, coalesce(b, a + 1))) AS t FROM g)
      SELECT user_id, t, round(coalesce(v + (t - a)::DOUBLE / (b - a) * (u - v), v), 6) AS value FROM f""",
    "label_signals": "SELECT doc_id, CASE WHEN toxic IS NOT NULL THEN (toxic = 1)::INT END AS signal FROM documents LEFT JOIN labels USING (doc_id)",
    "label_centroids": "SELECT l_returnflag, l_suppkey % 9 AS label, round(avg(l_quantity), 6) AS y, round(avg(l_linenumber), 6) AS x, count(*) AS area FROM lineitem WHERE l_suppkey % 9 > 0 GROUP BY 1, 2",
    "replica_orders": "SELECT doc_id, ('0x' || substr(md5('r1|' || doc_id), 1, 8))::BIGINT % 4 AS replica, md5('r1|' || doc_id) AS \"order\" FROM documents",
    "group_batches": "SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('b1|' || c_custkey), c_custkey) - 1) // 8 AS batch FROM customer",
    "stratified_batches": """WITH t AS (SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY md5('b2|' || c_custkey), c_custkey) AS turn FROM customer)
      SELECT c_nationkey, c_mktsegment, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY turn, c_mktsegment) - 1) // 10 AS batch FROM t""",
    "balance_peaks": """WITH r AS (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1), h AS (SELECT c_mktsegment, lo, hi, least(49, floor((c_acctbal - lo) / (hi - lo) * 50)) AS b, count(*) AS n FROM customer JOIN r USING (c_mktsegment) GROUP BY 1, 2, 3, 4)
      SELECT c_mktsegment, round(lo + (b + 0.5) * (hi - lo) / 50, 4) AS peak, n FROM h QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, b) = 1""",
    "melted_prices": "WITH l AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME measure VALUE value) SELECT l_returnflag, measure, round(avg(value), 6) AS mean FROM l GROUP BY 1, 2",
    "scale_factors": "SELECT p_partkey, round(coalesce(3.0 / nullif(p_size % 4, 0), 1.0)::DOUBLE, 6) AS scale FROM part",
}
