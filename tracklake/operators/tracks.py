"""Operators on tracks: rows of one entity in time order. Every one is a window or an aggregate on the track's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(rows: DataFrame, keys: list[str], order: list[str], out: str = "t") -> DataFrame:
    """Numbers the rows of each track from 0 in the given order."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def steps(rows: DataFrame, keys: list[str], t: str, x: str, y: str, eps: float = 1e-6) -> DataFrame:
    """Adds dx, dy, dt to the row before and speed; the first row of a track has speed 0."""
    w = Window.partitionBy(*keys).orderBy(t)
    out = rows.withColumns({"dx": F.col(x) - F.lag(x).over(w), "dy": F.col(y) - F.lag(y).over(w), "dt": F.col(t) - F.lag(t).over(w)})
    return out.withColumn("speed", F.coalesce(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) / F.greatest(F.col("dt").cast("double"), F.lit(eps)), F.lit(0.0)))


def displacement(rows: DataFrame, keys: list[str], t: str, x: str, y: str) -> DataFrame:
    """Of each track: n, path_length, net_displacement, persistence (net / path, 0 without a path), mean and population deviation of the speed."""
    s = steps(rows, keys, t, x, y)
    ends = F.sqrt((F.max_by(x, t) - F.min_by(x, t)) ** 2 + (F.max_by(y, t) - F.min_by(y, t)) ** 2)
    out = s.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)), F.lit(0.0)).alias("path_length"), ends.alias("net_displacement"),
        F.avg("speed").alias("speed_mean"), F.stddev_pop("speed").alias("speed_std"),
    )
    return out.withColumn("persistence", F.when(F.col("path_length") > 0, F.col("net_displacement") / F.col("path_length")).otherwise(0.0))


def angular_velocity(rows: DataFrame, keys: list[str], t: str, x: str, y: str) -> DataFrame:
    """Of each track: mean and largest turn per time between successive steps; 0 below three points or where a step has no length."""
    w = Window.partitionBy(*keys).orderBy(t)
    s = steps(rows, keys, t, x, y).withColumns({"px": F.lag("dx").over(w), "py": F.lag("dy").over(w)})
    length = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) * F.sqrt(F.col("px") ** 2 + F.col("py") ** 2)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("dx") * F.col("px") + F.col("dy") * F.col("py")) / length))
    s = s.withColumn("turn", F.when(length > 0, F.acos(cosine) / F.col("dt")))
    return s.groupBy(*keys).agg(F.coalesce(F.avg("turn"), F.lit(0.0)).alias("turn_mean"), F.coalesce(F.max("turn"), F.lit(0.0)).alias("turn_max"))


def crossing(rows: DataFrame, keys: list[str], t: str, value: str, threshold: float) -> DataFrame:
    """Of each track: first t at or above the threshold, t of the steepest rise (the first of ties), the largest value, n and n above."""
    w = Window.partitionBy(*keys).orderBy(t)
    s = rows.withColumn("rise", F.col(value) - F.lag(value).over(w))
    steep = F.min(F.when(F.col("rise") == F.col("most"), F.col(t)))
    s = s.withColumn("most", F.max("rise").over(Window.partitionBy(*keys)))
    return s.groupBy(*keys).agg(
        F.min(F.when(F.col(value) >= threshold, F.col(t))).alias("t_cross"), steep.alias("t_steepest"), F.max(value).alias("most"),
        F.count("*").alias("n"), F.count(F.when(F.col(value) >= threshold, 1)).alias("n_above"),
    )


def runs(rows: DataFrame, keys: list[str], t: str, positive: Column) -> DataFrame:
    """Maximal runs of rows for which `positive` holds: keys, start, stop, n. Null counts as not positive."""
    w = Window.partitionBy(*keys).orderBy(t)
    s = rows.withColumn("_p", F.coalesce(positive, F.lit(False))).withColumn("_n", F.row_number().over(w))
    s = s.where("_p").withColumn("_island", F.col("_n") - F.row_number().over(w))
    return s.groupBy(*keys, "_island").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n")).drop("_island")


def first_run(rows: DataFrame, keys: list[str], t: str, positive: Column, least: int) -> DataFrame:
    """Of each track that has one: where the first run of at least `least` positives starts, and its length."""
    found = runs(rows, keys, t, positive).where(F.col("n") >= least)
    return found.groupBy(*keys).agg(F.min("start").alias("t_run"), F.min_by("n", "start").alias("run_length"))


def oscillation(rows: DataFrame, keys: list[str], t: str, value: str, threshold: str) -> DataFrame:
    """Of each track: rising edges (one more if it starts above), time above, largest amplitude above the threshold, longest run above."""
    w = Window.partitionBy(*keys).orderBy(t)
    above = F.col(value) > F.col(threshold)
    s = rows.withColumn("above", above).withColumns({"was": F.lag("above").over(w), "dt": F.lead(t).over(w) - F.col(t)})
    base = s.groupBy(*keys).agg(
        F.count(F.when(F.col("above") & ~F.coalesce("was", F.lit(False)), 1)).alias("edges"), F.coalesce(F.sum(F.when(F.col("above"), F.col("dt"))), F.lit(0)).alias("dwell"),
        F.coalesce(F.max(F.when(F.col("above"), F.col(value) - F.col(threshold))), F.lit(0.0)).alias("amplitude"),
    )
    longest = runs(rows, keys, t, above).groupBy(*keys).agg(F.max(F.col("stop") - F.col("start")).alias("longest"))
    return base.join(longest, keys, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def shift_onset(rows: DataFrame, keys: list[str], t: str, positive: Column, by: int, out: str = "shifted") -> DataFrame:
    """Labels after moving each track's onset by `by` frames: positive from there on, null where a track has no onset."""
    onset = F.min(F.when(positive, F.col(t))).over(Window.partitionBy(*keys))
    return rows.withColumn(out, F.col(t) >= onset + by)


def smoothness(rows: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Of each track: mean absolute difference of neighbours, and how often the sign of differences changes, zeros left out."""
    w = Window.partitionBy(*keys).orderBy(t)
    s = rows.withColumn("d", F.col(value) - F.lag(value).over(w))
    mean = s.groupBy(*keys).agg(F.avg(F.abs("d")).alias("mean_abs_diff"))
    moved = s.where("d <> 0").withColumn("changed", F.signum("d") != F.lag(F.signum("d")).over(w))
    return mean.join(moved.groupBy(*keys).agg(F.count(F.when(F.col("changed"), 1)).alias("sign_changes")), keys, "left").withColumn("sign_changes", F.coalesce("sign_changes", F.lit(0)))


def lag_pairs(rows: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """All pairs of rows of a track, earlier first: keys, lag, difference. Tracks are short; keys bound the join."""
    a, b = rows.select(*keys, F.col(t).alias("t_a"), F.col(value).alias("a")), rows.select(*keys, F.col(t).alias("t_b"), F.col(value).alias("b"))
    return a.join(b, keys).where("t_b > t_a").select(*keys, (F.col("t_b") - F.col("t_a")).alias("lag"), (F.col("b") - F.col("a")).alias("difference"))


def normalised_half_time(rows: DataFrame, keys: list[str], t: str, value: str, taus: list[float]) -> DataFrame:
    """Of each track a column for each tau: first t at which value over the track's largest reaches tau."""
    s = rows.withColumn("share", F.col(value) / F.nullif(F.max(value).over(Window.partitionBy(*keys)), F.lit(0.0)))
    return s.groupBy(*keys).agg(*[F.min(F.when(F.col("share") >= tau, F.col(t))).alias(f"t_{round(100 * tau)}") for tau in taus])


def baseline_change(rows: DataFrame, keys: list[str], t: str, value: str, first: int) -> DataFrame:
    """Adds the difference to the mean of the track's first `first` rows."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(t))
    s = rows.withColumn("_place", place)
    base = F.avg(F.when(F.col("_place") <= first, F.col(value))).over(Window.partitionBy(*keys))
    return s.withColumn("change", F.col(value) - base).drop("_place")


def division_regime(track_starts: DataFrame, lineage: str, start: str, t_zero: str, pre: int, post: int) -> DataFrame:
    """Of each lineage: none, pre, during or post, by the second earliest track start against t_zero."""
    w = Window.partitionBy(lineage).orderBy(start)
    second = track_starts.withColumn("_n", F.row_number().over(w)).groupBy(lineage).agg(F.min(F.when(F.col("_n") == 2, F.col(start))).alias("d"), F.min(t_zero).alias("z"))
    regime = F.when(F.col("d").isNull(), "none").when(F.col("d") < F.col("z") - pre, "pre").when(F.col("d") <= F.col("z") + post, "during").otherwise("post")
    return second.select(lineage, regime.alias("regime"))


def cohorts(rows: DataFrame, keys: list[str], t: str, label: str, positive: str, control: Column, manual: Column, least: int, negative_share: float = 0.8) -> DataFrame:
    """Of each track: mock (control), productive (manual), bystander (never positive, or mostly negative), unannotated_productive (a run of `least` positives) or abortive."""
    pos = F.col(label) == positive
    stats = rows.groupBy(*keys).agg(F.bool_or(control).alias("control"), F.bool_or(manual).alias("manual"), F.count(F.when(pos, 1)).alias("p"), F.count(label).alias("n"))
    run = first_run(rows, keys, t, pos, least)
    c = stats.join(run, keys, "left")
    kind = (
        F.when(F.col("control"), "mock").when(F.col("manual"), "productive").when(F.col("p") == 0, "bystander")
        .when(F.col("t_run").isNotNull(), "unannotated_productive").when((F.col("n") - F.col("p")) / F.col("n") >= negative_share, "bystander").otherwise("abortive")
    )
    return c.select(*keys, kind.alias("cohort"))


def timing(rows: DataFrame, keys: list[str], t: str, positive: Column, default_interval: float = 30.0) -> DataFrame:
    """Of each track with a positive row: onset, modal interval (the smallest of ties), total time positive, span."""
    w = Window.partitionBy(*keys).orderBy(t)
    s = rows.withColumn("dt", F.col(t) - F.lag(t).over(w)).withColumn("p", F.coalesce(positive, F.lit(False)))
    a = s.groupBy(*keys).agg(F.min(F.when(F.col("p"), F.col(t))).alias("onset"), F.max(F.when(F.col("p"), F.col(t))).alias("last"), F.count(F.when(F.col("p"), 1)).alias("n"), F.coalesce(F.mode("dt", True).cast("double"), F.lit(default_interval)).alias("interval"))
    return a.where("n > 0").select(*keys, "onset", "interval", (F.col("n") * F.col("interval")).alias("total"), (F.col("last") - F.col("onset") + F.col("interval")).alias("span"))


def feature_bundle(rows: DataFrame, keys: list[str], t: str, x: str, y: str) -> DataFrame:
    """Of each track all motion features in one row: those of `displacement` and `angular_velocity`, and least and greatest speed. Tracks of one row have zeros."""
    s = steps(rows, keys, t, x, y).groupBy(*keys).agg(F.min("speed").alias("speed_min"), F.max("speed").alias("speed_max"))
    return displacement(rows, keys, t, x, y).join(angular_velocity(rows, keys, t, x, y), keys).join(s, keys)


def zero_frames(rows: DataFrame, lineage: list[str], track: list[str], t: str, annotated: Column, predicted: Column, least: int) -> DataFrame:
    """Of each lineage its zero: the first annotated frame of its tracks, or else the first frame of the earliest run of `least` predicted ones; and which of both. Lineages without either are left out."""
    manual = rows.where(annotated).groupBy(*lineage).agg(F.min(t).alias("_m"))
    found = first_run(rows, [*lineage, *track], t, F.coalesce(predicted, F.lit(False)), least).groupBy(*lineage).agg(F.min("t_run").alias("_r"))
    z = manual.join(found, lineage, "full_outer")
    return z.select(*lineage, F.coalesce("_m", "_r").alias("t_zero"), F.when(F.col("_m").isNotNull(), "annotation").otherwise("run").alias("origin"))


def relative_times(rows: DataFrame, lineage: list[str], t: str, zeros: DataFrame, interval: float) -> DataFrame:
    """Rows with t_zero, frames and minutes since it, and whether they are before it; all null for lineages without a zero."""
    z = rows.join(zeros.select(*lineage, "t_zero"), lineage, "left")
    return z.withColumns({"since": F.col(t) - F.col("t_zero"), "minutes": (F.col(t) - F.col("t_zero")) * interval, "before": F.col(t) < F.col("t_zero")})


def threshold_onsets(rows: DataFrame, keys: list[str], fov: str, t: str, signal: str, thresholds: DataFrame) -> DataFrame:
    """Of each track the first frame whose signal exceeds the threshold of its field of view (columns fov, threshold); null where it never does or there is no threshold."""
    x = rows.join(thresholds.select(fov, "threshold"), fov, "left")
    return x.groupBy(fov, *keys).agg(F.min(F.when(F.col(signal) > F.col("threshold"), F.col(t))).alias("onset"))
