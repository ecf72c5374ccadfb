"""Motion bundles, zeros, relative times, onsets, offsets, capped lineages, stored tables and summaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.lineage import new_path
from tracklake.operators import aggregates, index, joins, scores, tracks
from tracklake.plans.common import EVENTS, events, rounded, table
from tracklake.sources import tables

K = ["user_id"]


def track_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("y", F.col("event_id") % 50 * 1.0)
    b = tracks.feature_bundle(e, K, "t", "value", "y")
    return rounded(b, *[c for c in b.columns if c not in ("user_id", "n")])


def relative_event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users mod 40 are lineages; errors are annotated for even users, views are predictions."""
    e = events(spark, sf_dir).withColumn("lineage", F.col("user_id") % 40)
    z = tracks.zero_frames(e, ["lineage"], K, "t", (F.col("event_type") == "error") & (F.col("user_id") % 4 == 0), F.col("event_type") == "view", 2)
    return tracks.relative_times(e.select("event_id", "lineage", "t"), ["lineage"], "t", z, 30.0).join(z.select("lineage", "origin"), "lineage", "left")


def threshold_user_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of a user above nine tenths of the early values of the users alike (mod 7), or of those mod 2 where they are few."""
    e = events(spark, sf_dir).withColumns({"fov": F.col("user_id") % 7, "plate": F.col("user_id") % 7 % 2})
    limits = aggregates.fallback_threshold(e.where("t < 5"), "value", "fov", "plate", 0.9, 30)
    return tracks.threshold_onsets(e, K, "fov", "t", "value", limits)


def offset_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as intervals in minutes."""
    i = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("interval")).distinct()
    return index.tau_frames(i, "interval", 0.5, 1.25)


def capped_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    return index.lineage_capped(o, "o_orderpriority", "o_custkey", 7, "c7")


def subset_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users mod 3 = 1, and whether one of the next two frames but one is there too; every fifth event is missing."""
    e = events(spark, sf_dir).where("event_id % 5 <> 0").select("event_id", "user_id", "t")
    return index.subset_with_anchors(e, e.where("user_id % 3 = 1"), K, "t", (2, 3))


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an index: written with its fixed schema, a column replaced in place, and read again."""
    e = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("cell_id"), F.concat(F.lit("e"), F.col("user_id") % 3).alias("experiment"), F.col("user_id").cast("int").alias("track_id"), F.col("t").cast("int").alias("t"), F.lit("none").alias("perturbation"))
    path = new_path(spark, "index")
    tables.write_index(e, path, None)
    tables.upsert_columns(spark, path, e.where("t % 2 = 0").select("cell_id", F.upper("experiment").alias("perturbation")), ["cell_id"])
    return tables.read_index(spark, path).groupBy("experiment", "perturbation").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("tracks"), F.count("gene_name").alias("genes"))


def clock_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets of each kind of user on the clock of hours and on that of frames."""
    e = events(spark, sf_dir).withColumns({"kind": F.col("user_id") % 4, "limit": 60.0 + F.col("user_id") % 4 * 10})
    return rounded(scores.onset_spread(e, "kind", K, "value", "limit", {"hours": "hours", "frames": "t"}), "median", "spread")


def finite_ratio_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_tax") > 0, F.col("l_discount") / F.when(F.col("l_tax") > 0, F.col("l_tax"))).otherwise(F.lit(float("inf"))).alias("ratio"))
    return rounded(scores.finite_median(li, ["l_suppkey"], "ratio"), "median")


def model_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as models, flags as data sets."""
    li = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", "l_discount", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("l_quantity"))
    m = scores.metric_means(li, ["l_linenumber", "l_returnflag"], ["l_discount", "l_quantity"])
    return rounded(m, "l_discount", "l_quantity")


def fallback_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels have no ids, so fov, track and t are the keys; half of their paths start with a slash."""
    e = events(spark, sf_dir)
    rows = e.select("event_id", F.concat(F.lit("a/"), F.col("user_id") % 5).alias("fov"), F.col("user_id").alias("track_id"), "t")
    labels = e.where("event_id % 3 = 0").select(F.concat(F.when(F.col("event_id") % 2 == 0, "/").otherwise(""), F.lit("a/"), F.col("user_id") % 5).alias("fov"), F.col("user_id").alias("track_id"), "t", F.col("event_type").alias("state"))
    return joins.annotated_by_first_keys(rows, labels, [["fov", "id"], ["fov", "t", "track_id"]], ["state"], "fov").select("event_id", "fov", "state")


QUERIES = {f.__name__: f for f in (track_bundle, relative_event_times, threshold_user_onsets, offset_ranges, capped_lineages, subset_anchors, stored_index, clock_spread, finite_ratio_median, model_metric_means, fallback_annotations)}

SQL = {
    "track_bundle": f"""WITH {EVENTS}, p AS (SELECT user_id, t, value AS x, event_id % 50 * 1.0::DOUBLE AS y FROM e), s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
      v AS (SELECT *, coalesce(sqrt(dx * dx + dy * dy) / dt, 0) AS speed, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)), u AS (SELECT *, sqrt(dx * dx + dy * dy) * sqrt(px * px + py * py) AS l FROM v),
      a AS (SELECT user_id, count(*) AS n, coalesce(sum(sqrt(dx * dx + dy * dy)), 0) AS path_length, sqrt(pow(arg_max(x, t) - arg_min(x, t), 2) + pow(arg_max(y, t) - arg_min(y, t), 2)) AS net_displacement, avg(speed) AS speed_mean, stddev_pop(speed) AS speed_std, min(speed) AS speed_min, max(speed) AS speed_max,
        coalesce(avg(CASE WHEN l > 0 THEN acos(greatest(-1, least(1, (dx * px + dy * py) / l))) / dt END), 0) AS turn_mean, coalesce(max(CASE WHEN l > 0 THEN acos(greatest(-1, least(1, (dx * px + dy * py) / l))) / dt END), 0) AS turn_max FROM u GROUP BY 1)
      SELECT user_id, n, round(path_length, 6) AS path_length, round(net_displacement, 6) AS net_displacement, round(speed_mean, 6) AS speed_mean, round(speed_std, 6) AS speed_std, round(CASE WHEN path_length > 0 THEN net_displacement / path_length ELSE 0 END, 6) AS persistence, round(turn_mean, 6) AS turn_mean, round(turn_max, 6) AS turn_max, round(speed_min, 6) AS speed_min, round(speed_max, 6) AS speed_max FROM a""",
    "relative_event_times": f"""WITH {EVENTS}, x AS (SELECT *, user_id % 40 AS lineage FROM e), m AS (SELECT lineage, min(t) AS m FROM x WHERE event_type = 'error' AND user_id % 4 = 0 GROUP BY 1),
      r AS (SELECT *, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM x WHERE event_type = 'view'), q AS (SELECT lineage, user_id, g, min(t) AS s, count(*) AS n FROM r GROUP BY 1, 2, 3), f AS (SELECT lineage, min(s) AS r FROM q WHERE n >= 2 GROUP BY 1),
      z AS (SELECT coalesce(m.lineage, f.lineage) AS lineage, coalesce(m, r) AS t_zero, CASE WHEN m IS NOT NULL THEN 'annotation' ELSE 'run' END AS origin FROM m FULL JOIN f ON m.lineage = f.lineage)
      SELECT x.lineage, event_id, t, t_zero, t - t_zero AS since, ((t - t_zero) * 30.0)::DOUBLE AS minutes, t < t_zero AS before, origin FROM x LEFT JOIN z ON z.lineage = x.lineage""",
    "threshold_user_onsets": f"""WITH {EVENTS}, x AS (SELECT *, user_id % 7 AS fov, user_id % 7 % 2 AS plate FROM e), c AS (SELECT * FROM x WHERE t < 5), a AS (SELECT fov, any_value(plate) AS plate, quantile_cont(value, 0.9) AS q, count(value) AS n FROM c GROUP BY 1), b AS (SELECT plate, quantile_cont(value, 0.9) AS q, count(value) AS n FROM c GROUP BY 1), w AS (SELECT quantile_cont(value, 0.9) AS q FROM c),
      l AS (SELECT a.fov, CASE WHEN a.n >= 30 THEN a.q WHEN b.n >= 30 THEN b.q ELSE w.q END AS threshold FROM a JOIN b USING (plate), w)
      SELECT x.fov, user_id, min(t) FILTER (value > threshold) AS onset FROM x LEFT JOIN l ON l.fov = x.fov GROUP BY 1, 2""",
    "offset_ranges": "WITH i AS (SELECT DISTINCT p_size::DOUBLE AS interval FROM part) SELECT interval, round_even(30 / interval, 0)::INT AS tau_low, round_even(75 / interval, 0)::INT AS tau_high, round_even(30 / interval, 0) < round_even(75 / interval, 0) AS usable FROM i",
    "capped_lineages": "WITH d AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('c7|' || o_orderpriority || '|' || o_custkey), o_custkey) <= 7) SELECT o_orderpriority, o_custkey, o_orderkey FROM orders SEMI JOIN k USING (o_orderpriority, o_custkey)",
    "subset_anchors": f"WITH {EVENTS}, x AS (SELECT event_id, user_id, t FROM e WHERE event_id % 5 <> 0 AND user_id % 3 = 1) SELECT user_id, t, event_id, EXISTS (SELECT 1 FROM x b WHERE b.user_id = a.user_id AND b.t - a.t BETWEEN 2 AND 3) AS anchor FROM x a",
    "stored_index": f"WITH {EVENTS}, x AS (SELECT 'e' || (user_id % 3) AS experiment, CASE WHEN t % 2 = 0 THEN upper('e' || (user_id % 3)) END AS perturbation, user_id FROM e) SELECT experiment, perturbation, count(*) AS n, count(DISTINCT user_id) AS tracks, 0::BIGINT AS genes FROM x GROUP BY 1, 2",
    "clock_spread": f"""WITH {EVENTS}, f AS (SELECT user_id % 4 AS kind, user_id, min(hours) FILTER (value > 60 + user_id % 4 * 10) AS h, min(t) FILTER (value > 60 + user_id % 4 * 10) AS t FROM e GROUP BY 1, 2), l AS (SELECT kind, 'hours' AS clock, h AS onset FROM f UNION ALL SELECT kind, 'frames', t FROM f)
      SELECT kind, clock, count(onset) AS n, round(quantile_cont(onset, 0.5), 6) AS median, round(quantile_cont(onset, 0.75) - quantile_cont(onset, 0.25), 6) AS spread FROM l GROUP BY 1, 2""",
    "finite_ratio_median": "SELECT l_suppkey, count(*) FILTER (l_tax > 0) AS n, round(median(l_discount / l_tax) FILTER (l_tax > 0), 6) AS median FROM lineitem GROUP BY 1",
    "model_metric_means": "SELECT l_linenumber, l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS l_discount, round(avg(l_quantity) FILTER (l_quantity > 5), 6) AS l_quantity FROM lineitem GROUP BY 1, 2",
    "fallback_annotations": f"WITH {EVENTS} SELECT event_id, 'a/' || (user_id % 5) AS fov, CASE WHEN event_id % 3 = 0 THEN event_type END AS state FROM e",
}
