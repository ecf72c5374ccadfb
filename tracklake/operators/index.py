"""The observation index: schema and keys, borders, lineages, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, IntegerType, ShortType, StringType, StructField, StructType

from tracklake.functions.lineage import cut

#: Column names and types of the index.
CELL_INDEX = StructType([
    StructField("cell_id", StringType()),
    StructField("experiment", StringType()),
    StructField("store_path", StringType()),
    StructField("tracks_path", StringType()),
    StructField("fov", StringType()),
    StructField("well", StringType()),
    StructField("y", FloatType()),
    StructField("x", FloatType()),
    StructField("z", ShortType()),
    StructField("perturbation", StringType()),
    StructField("channel_name", StringType()),
    StructField("t", IntegerType()),
    StructField("track_id", IntegerType()),
    StructField("global_track_id", StringType()),
    StructField("lineage_id", StringType()),
    StructField("parent_track_id", IntegerType()),
    StructField("hours_post_perturbation", FloatType()),
    StructField("interval_minutes", FloatType()),
    StructField("gene_name", StringType()),
    StructField("reporter", StringType()),
    StructField("sgRNA", StringType()),
    StructField("microscope", StringType()),
    StructField("marker", StringType()),
    StructField("organelle", StringType()),
    StructField("pixel_size_xy_um", FloatType()),
    StructField("pixel_size_z_um", FloatType()),
    StructField("T_shape", IntegerType()),
    StructField("C_shape", IntegerType()),
    StructField("Z_shape", IntegerType()),
    StructField("Y_shape", IntegerType()),
    StructField("X_shape", IntegerType()),
    StructField("z_focus_mean", FloatType()),
    StructField("norm_mean", FloatType()),
    StructField("norm_std", FloatType()),
    StructField("norm_median", FloatType()),
    StructField("norm_iqr", FloatType()),
    StructField("norm_max", FloatType()),
    StructField("norm_min", FloatType()),
])


def conform(rows: DataFrame, schema: StructType = CELL_INDEX) -> DataFrame:
    """The schema's columns in order, cast; missing ones are null, NaN becomes null."""
    have = set(rows.columns)
    return rows.select(*[(F.when(~F.isnan(F.col(f.name).cast("double")), F.col(f.name)) if f.dataType == FloatType() and f.name in have else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def problems(rows: DataFrame, required: list[str], key: list[str]) -> DataFrame:
    """What is wrong with a table, as (problem, detail): missing columns, duplicate keys, columns that are null throughout."""
    missing = [c for c in required if c not in rows.columns]
    there = [c for c in required if c in rows.columns]
    spark = rows.sparkSession
    out = spark.createDataFrame([("missing column", c) for c in missing], "problem string, detail string")
    if all(c in rows.columns for c in key):
        twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate key").alias("problem"), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("detail"))
        out = out.union(twice)
    counts = rows.agg(*[F.count(c).alias(c) for c in there]).select(F.explode(F.create_map(*[x for c in there for x in (F.lit(c), F.col(c))])).alias("detail", "n"))
    return out.union(counts.where("n = 0").select(F.lit("all null").alias("problem"), "detail"))


def clamp_borders(rows: DataFrame, y: str, x: str, height: Column, width: Column, patch: tuple[int, int], max_shift: int | None = None) -> DataFrame:
    """Drops centroids outside of the image, moves the others so that a patch fits, and drops those that would move over `max_shift` (a quarter of the longer side unless given; 0: none may move)."""
    half_y, half_x = patch[0] // 2, patch[1] // 2
    shift = max(patch[0] // 4, patch[1] // 4) if max_shift is None else max_shift
    inside = rows.where((F.col(y) >= 0) & (F.col(y) < height) & (F.col(x) >= 0) & (F.col(x) < width))
    moved = inside.withColumns({"y_clamp": F.greatest(F.lit(half_y), F.least(F.col(y), height - half_y)), "x_clamp": F.greatest(F.lit(half_x), F.least(F.col(x), width - half_x))})
    return moved.where(F.greatest(F.abs(F.col(y) - F.col("y_clamp")), F.abs(F.col(x) - F.col("x_clamp"))) <= shift)


def roots(nodes: DataFrame, node: str, parent: str, most: int = 64) -> DataFrame:
    """Root ancestor and depth of every node, by pointer doubling: each round joins once and doubles the distance covered.

    A parent that isn't there makes its child a root. Nodes on or below a cycle get the least node of the cycle's walk they end in after `most` doublings,
    never an endless loop.
    """
    known = nodes.select(F.col(node).alias("_p"))
    up = nodes.select(F.col(node).alias("n"), F.col(parent).alias("_p")).join(known.withColumn("_there", F.lit(1)), "_p", "left")
    up = up.select("n", F.when(F.col("_there").isNotNull(), F.col("_p")).otherwise(F.col("n")).alias("root"), F.when(F.col("_there").isNotNull() & (F.col("_p") != F.col("n")), 1).otherwise(0).alias("depth"))
    for _ in range(most):
        next_ = up.alias("a").join(up.select(F.col("n").alias("_n"), F.col("root").alias("_r"), F.col("depth").alias("_d")).alias("b"), F.col("a.root") == F.col("_n"))
        next_ = next_.select("a.n", F.col("_r").alias("root"), (F.col("a.depth") + F.col("_d")).alias("depth"), (F.col("_r") != F.col("a.root")).alias("moved"))
        next_ = cut(next_)
        if next_.where("moved").isEmpty():
            return next_.select(F.col("n").alias(node), "root", "depth")
        up = next_.drop("moved")
    return up.select(F.col("n").alias(node), F.least("n", "root").alias("root"), "depth")


def branches(nodes: DataFrame, node: str, parent: str, most: int = 64) -> DataFrame:
    """Each root-to-leaf branch as (leaf, position, node), position 0 the root; shared ancestors come once for each branch.

    Ancestors are gathered by pointer doubling, so a branch of n nodes takes about log2 n joins. A parent that isn't there ends the branch, and
    so does a node that is in it already.
    """
    n = nodes.select(F.col(node).alias("n"), F.col(parent).alias("p"))
    leaves = n.join(n.select(F.col("p").alias("n")).distinct(), "n", "left_anti").select("n")
    up = n.select("n", F.array("n").alias("path"), F.col("p").alias("top"))
    for _ in range(most):
        above = up.select(F.col("n").alias("top"), F.col("path").alias("_path"), F.col("top").alias("_top"))
        up = up.join(above, "top", "left").withColumn("longer", F.array_union("path", F.coalesce("_path", F.array().cast(up.schema["path"].dataType))))
        whole = F.size("longer") == F.size("path") + F.size("_path")  # else the walk has met itself
        up = cut(up.select("n", F.col("longer").alias("path"), F.when(whole, F.col("_top")).alias("top")))
        if up.where("top IS NOT NULL").isEmpty():
            break
    out = up.join(leaves, "n", "left_semi").select(F.col("n").alias("leaf"), F.posexplode(F.reverse("path")).alias("position", "node"))
    return out.select("leaf", "position", "node")


def hashed_order(seed: str, *keys: str) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def capped_sample(rows: DataFrame, groups: list[str], key: str, most: int, seed: str) -> DataFrame:
    """At most `most` rows of each group, by hashed order."""
    w = Window.partitionBy(*groups).orderBy(hashed_order(seed, key), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def stratified_sample(rows: DataFrame, stratum: str, key: str, total: int, seed: str) -> DataFrame:
    """total / strata rows of each stratum; the last stratum takes what is left over. Where rows are too few, they come again (copy counts)."""
    s = rows.select(stratum).distinct().withColumns({"_i": F.row_number().over(Window.orderBy(stratum)), "_k": F.count("*").over(Window.partitionBy())})  # a row for each stratum
    s = s.withColumn("quota", F.expr(f"{total} div _k + if(_i = _k, {total} - ({total} div _k) * _k, 0)")).select(stratum, "quota")
    w = Window.partitionBy(stratum)
    r = rows.join(F.broadcast(s), stratum).withColumns({"_n": F.row_number().over(w.orderBy(hashed_order(seed, key), key)), "_of": F.count("*").over(w)})
    r = r.withColumn("copies", F.expr("quota div _of + if(_n <= quota % _of, 1, 0)")).where("copies > 0")
    return r.drop("_n", "_of", "quota")


def split_units(rows: DataFrame, scope: list[str], unit: str, share: float, seed: str) -> DataFrame:
    """Adds split: within each scope, max(1, int(units * share)) whole units train, the others validate."""
    units = rows.select(*scope, unit).distinct()
    w = Window.partitionBy(*scope)
    u = units.withColumns({"_n": F.row_number().over(w.orderBy(hashed_order(seed, unit), unit)), "_k": F.count("*").over(w)})
    u = u.select(*scope, unit, F.when(F.col("_n") <= F.greatest(F.lit(1), F.floor(F.col("_k") * share)), "train").otherwise("val").alias("split"))
    return rows.join(u, [*scope, unit])


def tau_weights(low: int, high: int, rate: float) -> Column:
    """Array of (tau, probability), probability falling exponentially over low..high."""
    taus = F.sequence(F.lit(low), F.lit(high))
    raw = F.transform(taus, lambda t: F.exp(-rate * (t - low) / max(high - low, 1)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(taus, raw, lambda t, w: F.struct(t.alias("tau"), (w / total).alias("p")))


def windows(rows: DataFrame, t_size: str, z_size: str, t_window: int, z_window: int) -> DataFrame:
    """All (t, z) starts of sliding windows over an image's axes."""
    t = rows.where((F.col(t_size) >= t_window) & (F.col(z_size) >= z_window)).withColumn("t", F.explode(F.sequence(F.lit(0), F.col(t_size) - t_window)))
    return t.withColumn("z", F.explode(F.sequence(F.lit(0), F.col(z_size) - z_window)))


def encode_labels(rows: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Labels as their places among the sorted distinct ones, from 0; null stays null. Labels are few and broadcast only if Spark finds them small."""
    codes = rows.where(F.col(label).isNotNull()).select(label).distinct().withColumn(out, F.row_number().over(Window.orderBy(label)) - 1)
    return rows.join(codes, label, "left")


def tau_frames(intervals: DataFrame, interval: str, low_hours: float, high_hours: float) -> DataFrame:
    """Ranges of offsets in frames for intervals in minutes: hours are rounded to frames, halves to even; usable says whether the range has more than one offset."""
    frames = lambda hours: F.bround(F.lit(hours * 60.0) / F.col(interval)).cast("int")
    return intervals.withColumns({"tau_low": frames(low_hours), "tau_high": frames(high_hours)}).withColumn("usable", F.col("tau_low") < F.col("tau_high"))


def lineage_capped(rows: DataFrame, store: str, lineage: str, most: int, seed: str) -> DataFrame:
    """All rows of at most `most` lineages of each store, by hashed order; rows without a lineage are left out."""
    held = rows.where(F.col(lineage).isNotNull()).select(store, lineage).distinct()
    place = F.row_number().over(Window.partitionBy(store).orderBy(hashed_order(seed, store, lineage), lineage))  # a row for each lineage, no more than `most` of a task go on
    return rows.join(held.withColumn("_place", place).where(F.col("_place") <= most).drop("_place"), [store, lineage], "left_semi")


def subset_with_anchors(rows: DataFrame, keep: DataFrame, track: list[str], t: str, taus: tuple[int, int], anchors: DataFrame | None = None) -> DataFrame:
    """The rows of the kept tracks, with anchor: whether a row is among given anchors (track and t), or, without these, whether its track goes on at an offset within taus."""
    own = rows.join(keep.select(*track).distinct(), track, "left_semi")
    if anchors is None:
        later = own.select(*track, F.explode(F.sequence(F.lit(taus[0]), F.lit(taus[1]))).alias("_d"), F.col(t).alias("_t"))
        anchors = later.select(*track, (F.col("_t") - F.col("_d")).alias(t))
    return own.join(anchors.select(*track, t).distinct().withColumn("anchor", F.lit(True)), [*track, t], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
