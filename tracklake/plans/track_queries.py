"""Queries on tracks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.operators import aggregates, tracks
from tracklake.plans.common import EVENTS, events, positive, rounded, table

K = ["user_id"]


def event_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of high values per hour around each user's first error, with its Wilson interval."""
    e = events(spark, sf_dir)
    onset = F.min(F.when(positive(), F.col("hours"))).over(Window.partitionBy("user_id"))
    rel = e.withColumn("rel", F.col("hours") - onset).where("rel IS NOT NULL")
    return rounded(aggregates.population_curve(rel, "rel", F.col("value") > 50, -240.0, 240.0, 24.0, 5), "fraction", "ci_low", "ci_high")


def continuous_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.continuous_curve(events(spark, sf_dir), "hours", "value", 0.0, 720.0, 24.0), "mean", "median", "std", "q25", "q75")


def curve_onset_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events(spark, sf_dir).withColumn("time", F.floor(F.col("hours") / 24) - 5).groupBy("event_type", "time").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    out = aggregates.onset_and_peak(c, ["event_type"], "time", "v", "n", (-5, -1), 1.0, 3)
    return rounded(out, "baseline", "amplitude", "auc")


def track_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("y", F.sqrt(F.col("value").cast("double") + 1))
    return rounded(tracks.displacement(e, K, "t", "value", "y"), "path_length", "net_displacement", "speed_mean", "speed_std", "persistence")


def track_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("y", F.col("t") * 10.0)
    return rounded(tracks.angular_velocity(e, K, "t", "value", "y"), "turn_mean", "turn_max")


def track_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.crossing(events(spark, sf_dir), K, "t", "value", 90.0), "most")


def positive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.runs(events(spark, sf_dir), K, "t", F.col("value") > 40)


def first_positive_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.first_run(events(spark, sf_dir), K, "t", F.col("value") > 40, 3)


def track_oscillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.oscillation(events(spark, sf_dir).withColumn("threshold", F.lit(60.0)), K, "t", "value", "threshold"), "amplitude")


def shifted_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.shift_onset(events(spark, sf_dir), K, "t", positive(), -2).select("event_id", "t", "shifted")


def track_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.smoothness(events(spark, sf_dir), K, "t", "value"), "mean_abs_diff")


def turn_lag_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    p = tracks.lag_pairs(c, ["conv_id"], "turn", "size")
    return rounded(p.groupBy("lag").agg(F.count("*").alias("n"), F.avg(F.abs("difference")).alias("mean_abs")), "mean_abs")


def turn_lag_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    p = tracks.lag_pairs(c, ["conv_id"], "turn", "size").withColumn("gap", F.abs("difference"))
    return rounded(aggregates.agreement(p, ["conv_id"], "lag", "gap"), "pearson", "spearman", "mae", "within_1", "within_2")


def half_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.normalised_half_time(events(spark, sf_dir), K, "t", "value", [0.25, 0.5, 0.9])


def baseline_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.baseline_change(events(spark, sf_dir), K, "t", "value", 5).select("event_id", "change"), "change")


def division_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("t").alias("start")).withColumn("zero", F.lit(3))
    return tracks.division_regime(e, "user_id", "start", "zero", 2, 2)


def track_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.cohorts(events(spark, sf_dir), K, "t", "event_type", "error", F.col("user_id") % 11 == 0, F.col("user_id") % 7 == 0, 2)


def track_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.timing(events(spark, sf_dir), K, "t", F.col("value") > 70)


_RUNS = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n1 FROM e), i AS (SELECT *, n1 - row_number() OVER (PARTITION BY user_id ORDER BY t) AS island FROM r WHERE {0}), runs AS (SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n FROM i GROUP BY user_id, island)"
_PAIRS = "c AS (SELECT *, length(text) AS size FROM conversations), p AS (SELECT a.conv_id, b.turn - a.turn AS lag, b.size - a.size AS difference FROM c a JOIN c b USING (conv_id) WHERE b.turn > a.turn)"

QUERIES = {f.__name__: f for f in (
    event_onsets, continuous_curve, curve_onset_peak, track_displacement, track_turns, track_crossing, positive_runs, first_positive_run, track_oscillation, shifted_onsets,
    track_smoothness, turn_lag_differences, turn_lag_rank_correlation, half_times, baseline_changes, division_regimes, track_cohorts, track_timing,
)}

SQL = {
    "event_onsets": f"""WITH {EVENTS}, o AS (SELECT *, hours - min(CASE WHEN event_type = 'error' THEN hours END) OVER (PARTITION BY user_id) AS rel FROM e),
      b AS (SELECT floor((rel + 240) / 24)::BIGINT AS bin, count(*) AS n, count(*) FILTER (value > 50) AS p FROM o WHERE rel >= -240 AND rel < 240 GROUP BY 1),
      s AS (SELECT bin, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(p, 0) / nullif(n, 0)::DOUBLE AS f FROM range(20) t(bin) LEFT JOIN b USING (bin)),
      z AS (SELECT *, 1.959963984540054::DOUBLE AS z FROM s)
      SELECT bin, -240.0::DOUBLE + bin * 24 AS bin_start, n, p AS n_positive, CASE WHEN n >= 5 THEN round(f, 6) END AS fraction,
      CASE WHEN n >= 5 THEN round((f + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(f*(1-f)/n + z*z/(4.0*n*n)) / (1 + z*z/n), 6) END AS ci_low,
      CASE WHEN n >= 5 THEN round((f + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(f*(1-f)/n + z*z/(4.0*n*n)) / (1 + z*z/n), 6) END AS ci_high FROM z""",
    "continuous_curve": f"""WITH {EVENTS} SELECT floor(hours / 24)::BIGINT AS bin, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std,
      round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM e WHERE hours < 720 GROUP BY 1""",
    "curve_onset_peak": f"""WITH {EVENTS}, c AS (SELECT event_type, floor(hours / 24)::BIGINT - 5 AS time, avg(value) AS v, count(*) AS n FROM e GROUP BY 1, 2),
      b AS (SELECT event_type, coalesce(avg(v) FILTER (time >= -5 AND time < -1 AND n >= 3), 0) AS base, stddev_samp(v) FILTER (time >= -5 AND time < -1 AND n >= 3) AS sd, max(v) FILTER (time >= 0) AS top FROM c GROUP BY 1),
      l AS (SELECT *, lag(time) OVER w AS pt, lag(v) OVER w AS pv FROM c JOIN b USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY time))
      SELECT event_type, round(any_value(base), 6) AS baseline, min(time) FILTER (time >= 0 AND n >= 3 AND v > base + sd) AS onset, min(time) FILTER (time >= 0 AND v = top) AS peak_time,
      round(any_value(top) - any_value(base), 6) AS amplitude, min(time) FILTER (time >= 0 AND v > base + (top - base) / 2) AS t50, round(sum((v + pv - 2 * base) / 2 * (time - pt)) FILTER (time >= 0 AND pt >= 0), 6) AS auc FROM l GROUP BY 1""",
    "track_displacement": f"""WITH {EVENTS}, q AS (SELECT user_id, t, value AS x, sqrt(value + 1) AS y FROM e), d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t)),
      s AS (SELECT *, sqrt(dx*dx + dy*dy) AS len, coalesce(sqrt(dx*dx + dy*dy) / greatest(dt, 1e-6), 0) AS speed FROM d),
      a AS (SELECT user_id, count(*) AS n, coalesce(sum(len), 0) AS p, sqrt(pow(arg_max(x, t) - arg_min(x, t), 2) + pow(arg_max(y, t) - arg_min(y, t), 2)) AS net, avg(speed) AS m, stddev_pop(speed) AS sd FROM s GROUP BY 1)
      SELECT user_id, n, round(p, 6) AS path_length, round(net, 6) AS net_displacement, round(m, 6) AS speed_mean, round(sd, 6) AS speed_std, round(CASE WHEN p > 0 THEN net / p ELSE 0 END, 6) AS persistence FROM a""",
    "track_turns": f"""WITH {EVENTS}, d AS (SELECT user_id, t, value - lag(value) OVER w AS dx, (t - lag(t) OVER w) * 10.0::DOUBLE AS dy, t - lag(t) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
      p AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)), l AS (SELECT *, sqrt(dx*dx + dy*dy) * sqrt(px*px + py*py) AS len FROM p),
      a AS (SELECT user_id, CASE WHEN len > 0 THEN acos(greatest(-1, least(1, (dx*px + dy*py) / len))) / dt END AS turn FROM l)
      SELECT user_id, round(coalesce(avg(turn), 0), 6) AS turn_mean, round(coalesce(max(turn), 0), 6) AS turn_max FROM a GROUP BY 1""",
    "track_crossing": f"""WITH {EVENTS}, s AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS rise FROM e), m AS (SELECT *, max(rise) OVER (PARTITION BY user_id) AS top FROM s)
      SELECT user_id, min(t) FILTER (value >= 90) AS t_cross, min(t) FILTER (rise = top) AS t_steepest, round(max(value), 6) AS most, count(*) AS n, count(*) FILTER (value >= 90) AS n_above FROM m GROUP BY 1""",
    "positive_runs": f"WITH {EVENTS}, {_RUNS.format('value > 40')} SELECT * FROM runs",
    "first_positive_run": f"WITH {EVENTS}, {_RUNS.format('value > 40')} SELECT user_id, min(start) AS t_run, arg_min(n, start) AS run_length FROM runs WHERE n >= 3 GROUP BY 1",
    "track_oscillation": f"""WITH {EVENTS}, {_RUNS.format('value > 60')}, s AS (SELECT *, lag(value > 60) OVER w AS was, lead(t) OVER w - t AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
      l AS (SELECT user_id, max(stop - start) AS longest FROM runs GROUP BY 1)
      SELECT user_id, count(*) FILTER (value > 60 AND NOT coalesce(was, false)) AS edges, coalesce(sum(dt) FILTER (value > 60), 0)::BIGINT AS dwell, round(coalesce(max(value - 60) FILTER (value > 60), 0), 6) AS amplitude,
      coalesce(any_value(longest), 0) AS longest FROM s LEFT JOIN l USING (user_id) GROUP BY 1""",
    "shifted_onsets": f"WITH {EVENTS} SELECT event_id, t, t >= min(CASE WHEN event_type = 'error' THEN t END) OVER (PARTITION BY user_id) - 2 AS shifted FROM e",
    "track_smoothness": f"""WITH {EVENTS}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS d FROM e), c AS (SELECT user_id, sign(d) <> lag(sign(d)) OVER (PARTITION BY user_id ORDER BY t) AS ch FROM d WHERE d <> 0),
      n AS (SELECT user_id, count(*) FILTER (ch) AS k FROM c GROUP BY 1) SELECT user_id, round(avg(abs(d)), 6) AS mean_abs_diff, coalesce(any_value(k), 0) AS sign_changes FROM d LEFT JOIN n USING (user_id) GROUP BY 1""",
    "turn_lag_differences": f"WITH {_PAIRS} SELECT lag, count(*) AS n, round(avg(abs(difference)), 6) AS mean_abs FROM p GROUP BY 1",
    "turn_lag_rank_correlation": f"""WITH {_PAIRS}, g AS (SELECT conv_id, lag, abs(difference) AS gap FROM p),
      r AS (SELECT *, rank() OVER (PARTITION BY conv_id ORDER BY lag) + (count(*) OVER (PARTITION BY conv_id, lag) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY conv_id ORDER BY gap) + (count(*) OVER (PARTITION BY conv_id, gap) - 1) / 2.0 AS rb FROM g),
      a AS (SELECT conv_id, count(*) AS n, CASE WHEN stddev_pop(lag) > 0 AND stddev_pop(gap) > 0 THEN corr(lag, gap) END AS pearson, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra::DOUBLE, rb::DOUBLE) END AS spearman, avg(abs(lag - gap)) AS mae,
      avg((abs(lag - gap) <= 1)::INT) AS w1, avg((abs(lag - gap) <= 2)::INT) AS w2 FROM r GROUP BY 1)
      SELECT conv_id, n, CASE WHEN n >= 3 THEN round(pearson, 6) END AS pearson, CASE WHEN n >= 3 THEN round(spearman, 6) END AS spearman, CASE WHEN n >= 3 THEN round(mae, 6) END AS mae, CASE WHEN n >= 3 THEN round(w1, 6) END AS within_1, CASE WHEN n >= 3 THEN round(w2, 6) END AS within_2 FROM a""",
    "half_times": f"WITH {EVENTS}, s AS (SELECT *, value / nullif(max(value) OVER (PARTITION BY user_id), 0) AS f FROM e) SELECT user_id, min(t) FILTER (f >= 0.25) AS t_25, min(t) FILTER (f >= 0.5) AS t_50, min(t) FILTER (f >= 0.9) AS t_90 FROM s GROUP BY 1",
    "baseline_changes": f"WITH {EVENTS} SELECT event_id, round(value - avg(CASE WHEN t < 5 THEN value END) OVER (PARTITION BY user_id), 6) AS change FROM e",
    "division_regimes": f"""WITH {EVENTS}, s AS (SELECT user_id, event_type, min(t) AS start FROM e GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) AS n FROM s), d AS (SELECT user_id, min(start) FILTER (n = 2) AS d FROM o GROUP BY 1)
      SELECT user_id, CASE WHEN d IS NULL THEN 'none' WHEN d < 1 THEN 'pre' WHEN d <= 5 THEN 'during' ELSE 'post' END AS regime FROM d""",
    "track_cohorts": f"""WITH {EVENTS}, {_RUNS.format("event_type = 'error'")}, f AS (SELECT user_id FROM runs WHERE n >= 2 GROUP BY 1), a AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS p, count(event_type) AS n FROM e GROUP BY 1)
      SELECT a.user_id, CASE WHEN a.user_id % 11 = 0 THEN 'mock' WHEN a.user_id % 7 = 0 THEN 'productive' WHEN p = 0 THEN 'bystander' WHEN f.user_id IS NOT NULL THEN 'unannotated_productive' WHEN (n - p) / n::DOUBLE >= 0.8 THEN 'bystander' ELSE 'abortive' END AS cohort FROM a LEFT JOIN f USING (user_id)""",
    "track_timing": f"""WITH {EVENTS}, p AS (SELECT user_id, min(t) AS onset, max(t) AS last, count(*) AS n FROM e WHERE value > 70 GROUP BY 1), k AS (SELECT user_id, CASE WHEN count(*) > 1 THEN 1.0 ELSE 30.0 END::DOUBLE AS interval FROM e GROUP BY 1)
      SELECT user_id, onset, interval, n * interval AS total, last - onset + interval AS span FROM p JOIN k USING (user_id)""",
}
