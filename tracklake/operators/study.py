"""Steps of a study of tracks: selections, pairings of conditions, registries, batch plans and match bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.lineage import running
from tracklake.operators.index import hashed_order


def inner_anchors(rows: DataFrame, keys: list[str], t: str, y: str, x: str, height: float, width: float, half: float, step: int) -> DataFrame:
    """Rows strictly inside of the border whose track is there `step` frames later too."""
    inside = rows.where((F.col(y) > half) & (F.col(y) < height - half) & (F.col(x) > half) & (F.col(x) < width - half))
    later = inside.select(*keys, (F.col(t) - step).alias(t)).distinct()
    return inside.join(later, [*keys, t], "left_semi")


def annotation_subset(rows: DataFrame, fov: str, t: str, fovs: list[str], excluded: list[int]) -> DataFrame:
    """Rows of the given fields of view, whose names may start with a slash, without the excluded frames."""
    return rows.withColumn(fov, F.regexp_replace(fov, "^/+", "")).where(F.col(fov).isin(*fovs) & ~F.col(t).isin(*excluded))


def paired_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str, least: int = 5) -> DataFrame:
    """One row: paired if at least `least` keys are on both sides, then the mean difference over them, else that of the means; and how many keys meet."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys).agg(F.count("*").alias("n"), F.avg(F.col("_a") - F.col("_b")).alias("_d"))
    means = a.agg(F.avg(value).alias("_ma")).crossJoin(b.agg(F.avg(value).alias("_mb")))  # one row each
    paired = F.col("n") >= least
    return both.crossJoin(means).select(F.when(paired, "paired").otherwise("unpaired").alias("mode"), "n", F.when(paired, F.col("_d")).otherwise(F.col("_ma") - F.col("_mb")).alias("difference"))


def condition_pairs(rows: DataFrame, within: list[str], condition: str, control: str, value: str) -> DataFrame:
    """Each condition but the control against it, within groups: means and their difference."""
    g = rows.where(F.col(condition).isNotNull()).groupBy(*within, condition).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    base = g.where(F.col(condition) == control).select(*within, F.col("mean").alias("control_mean"), F.col("n").alias("control_n"))
    return g.where(F.col(condition) != control).join(base, within).withColumn("difference", F.col("mean") - F.col("control_mean"))


def onsets(rows: DataFrame, keys: list[str], t: str, above: Column) -> DataFrame:
    """Of each track the first frame where the condition holds; tracks without one are left out."""
    return rows.where(above).groupBy(*keys).agg(F.min(t).alias("onset"))


def onset_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Onsets of the same track in two channels, and by how much the second is later."""
    return a.select(*keys, F.col("onset").alias("onset_a")).join(b.select(*keys, F.col("onset").alias("onset_b")), keys).withColumn("delay", F.col("onset_b") - F.col("onset_a"))


def registry(rows: DataFrame, keys: list[str], lists: list[str], firsts: dict[str, str]) -> DataFrame:
    """A row for each group: the sorted distinct values of `lists`, and of each column of `firsts` the first one that is given, in the order of its other column."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.array_join(F.array_sort(F.collect_set(c)), ";").alias(f"{c}_list") for c in lists], *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(o))).alias(c) for c, o in firsts.items()])


def z_ranges(rows: DataFrame, focus: str, depth: str, window: int) -> DataFrame:
    """A window of `window` planes around the focus, moved to fit the depth; where the depth is smaller, all planes."""
    size = F.least(F.lit(window), F.col(depth))
    start = F.greatest(F.lit(0), F.least(F.floor(F.col(focus) + 0.5).cast("int") - F.expr(f"{window} div 2"), F.col(depth) - size))
    return rows.withColumns({"z_start": start.cast("int"), "z_stop": (start + size).cast("int")})


def match_bounds(rows: DataFrame, keys: list[str], t: str, region: str, aligned: str = "aligned") -> DataFrame:
    """Of each track the first and last frame of its aligned region, and how many frames lie before and after; tracks without one are left out."""
    inside = F.col(region) == aligned
    b = rows.groupBy(*keys).agg(F.min(F.when(inside, F.col(t))).alias("match_start"), F.max(F.when(inside, F.col(t))).alias("match_stop"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    return b.where("match_start IS NOT NULL").select(*keys, "match_start", "match_stop", (F.col("match_start") - F.col("_lo")).alias("before"), (F.col("_hi") - F.col("match_stop")).alias("after"))


def funnel(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """How many rows are left after each step, and how many it drops, all counted in one pass."""
    passed, counts = F.lit(True), [F.count("*").cast("long").alias("c0")]
    for i, (_, condition) in enumerate(steps):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count(F.when(passed, 1)).cast("long").alias(f"c{i + 1}"))
    names = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("name"), F.col(f"c{i + 1}").alias("kept"), (F.col(f"c{i}") - F.col(f"c{i + 1}")).alias("dropped")) for i, (n, _) in enumerate(steps)])
    return rows.agg(*counts).select(F.inline(names))


def interpolated(rows: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """A row for each frame from a track's first to its last, with the value by linear interpolation between the given ones."""
    own = Window.partitionBy(*keys).orderBy(t)
    given = rows.where(F.col(value).isNotNull()).select(*keys, t, value, F.lead(t).over(own).alias("_t"), F.lead(value).over(own).alias("_v"))
    filled = given.withColumn("_at", F.explode(F.sequence(F.col(t).cast("long"), F.coalesce(F.col("_t") - 1, F.col(t)).cast("long"))))
    share = (F.col("_at") - F.col(t)) / (F.col("_t") - F.col(t))
    return filled.select(*keys, F.col("_at").alias(t), F.coalesce(F.col(value) + share * (F.col("_v") - F.col(value)), F.col(value)).alias(value))


def label_centroids(pixels: DataFrame, keys: list[str], label: str, y: str, x: str) -> DataFrame:
    """Tracks of one frame from a label image: the centroid and size of each label; 0 is background."""
    return pixels.where(F.col(label) > 0).groupBy(*keys, label).agg(F.avg(y).alias("y"), F.avg(x).alias("x"), F.count("*").alias("area"))


def sharded_order(rows: DataFrame, key: str, replicas: int, seed: str) -> DataFrame:
    """Every row with its replica and its order there, both by a seeded hash, so each replica reads a permutation of a share of its own."""
    h = hashed_order(seed, key)
    return rows.withColumns({"replica": F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(replicas)), "order": h})


def batch_plan(rows: DataFrame, key: str, group: list[str], size: int, seed: str, stratum: str | None = None) -> DataFrame:
    """Batches of one group each: group columns, batch, key. Within a group rows come in hashed order; with a stratum, strata take turns, so that a
    batch holds nearly as many rows of each as there are left. The last batch of a group may be smaller.

    Rows are numbered by running counts over ranges of the hashed order (of turns and strata), so a group may be of any size. Keys are distinct.
    """
    x = rows.withColumns({"_o": F.struct(hashed_order(seed, key).alias("h"), F.col(key).alias("k")), "_one": F.lit(1)})
    if stratum is not None:
        x = running(x, [*group, stratum], "_o", {"_turn": "_one"}).withColumn("_o", F.struct("_turn", F.col(stratum).alias("s")))
    x = running(x, group, "_o", {"_place": "_one"})
    return x.select(*group, *[stratum] * bool(stratum), key, F.expr(f"(_place - 1) div {size}").alias("batch"))


def histogram_peak(rows: DataFrame, keys: list[str], value: str, bins: int = 50) -> DataFrame:
    """Of each group the centre of its fullest histogram bin (the first of several) and how many rows it has."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins))
    h = rows.join(ends, keys).where(F.col(value).isNotNull()).groupBy(*keys, "_lo", "_hi", F.coalesce(b, F.lit(0)).alias("_b")).agg(F.count("*").alias("n"))
    best = h.groupBy(*keys, "_lo", "_hi").agg(F.max(F.struct("n", (-F.col("_b")).alias("b"))).alias("m"))
    return best.select(*keys, (F.col("_lo") + (0.5 - F.col("m.b")) * (F.col("_hi") - F.col("_lo")) / bins).alias("peak"), F.col("m.n").alias("n"))
