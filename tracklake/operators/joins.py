"""Joins of tracks, annotations and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Left join that keeps one right row a key, the first in `order`, and takes only columns that left lacks; matched says whether there was one."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    one = right.withColumn("_n", first).where("_n = 1").select(*keys, *[c for c in columns if c not in left.columns], F.lit(True).alias("matched"))
    return left.join(one, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], row: str, y: str, x: str, value: str, tolerance: float = 4.0) -> DataFrame:
    """Of the right rows with equal keys, the value of the one nearest by Chebyshev distance, within tolerance, else null; ties take the smaller value. `row` identifies left rows.

    Both sides are put in squares as wide as the tolerance, and a right row also in the eight around its own, so only near rows meet.
    """
    side = tolerance if tolerance > 0 else 1.0
    square = lambda c, d=0: (F.floor(F.col(c) / side) + d).cast("long")
    around = F.explode(F.array(*[F.struct(square(y, i).alias("_by"), square(x, j).alias("_bx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    r = right.select(*keys, F.col(y).alias("_y"), F.col(x).alias("_x"), F.col(value).alias("_v"), around.alias("_s")).select(*keys, "_y", "_x", "_v", "_s.*")
    d = F.greatest(F.abs(F.col(y) - F.col("_y")), F.abs(F.col(x) - F.col("_x")))
    near = left.withColumns({"_by": square(y), "_bx": square(x)}).join(r, [*keys, "_by", "_bx"]).withColumn("distance", d).where(F.col("distance") <= tolerance)
    best = near.groupBy(row).agg(F.min(F.struct("distance", "_v")).alias("b")).select(row, F.col("b.distance").alias("distance"), F.col("b._v").alias(value))
    return left.join(best, row, "left")


def temporal_pairs(rows: DataFrame, keys: list[str], t: str, tau: int, columns: list[str]) -> DataFrame:
    """Each row with the row of its track `tau` frames later, whose columns get the prefix next_."""
    later = rows.select(*keys, (F.col(t) - tau).alias(t), *[F.col(c).alias(f"next_{c}") for c in columns])
    return rows.join(later, [*keys, t])


def valid_anchors(rows: DataFrame, keys: list[str], t: str, low: int, high: int) -> DataFrame:
    """Rows whose track has another row low..high frames later, itself left out; an equi semi join on the frames that would do."""
    wanted = rows.withColumn("_want", F.explode(F.sequence(F.col(t) + low, F.col(t) + high))).where(F.col("_want") != F.col(t))
    there = rows.select(*keys, F.col(t).alias("_want")).distinct()
    return wanted.join(there, [*keys, "_want"], "left_semi").drop("_want").distinct()


def group_anchors(rows: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """Rows that share the columns with at least one other; null keys belong to no group."""
    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    return whole.withColumn("_n", F.count("*").over(Window.partitionBy(*columns))).where(F.col("_n") >= least).drop("_n")


def negatives(anchors: DataFrame, rows: DataFrame, scope: list[str], track: str, t: str, tau: int, seed: str) -> DataFrame:
    """Of each anchor, one row of another track of the same scope `tau` frames later, chosen by a seeded hash of both tracks.

    Candidates are ranked per (scope, frame) once, then each anchor takes the next track on that ring, so no pairs are made.
    """
    order = F.md5(F.concat(F.lit(seed), F.col(track).cast("string")))
    w = Window.partitionBy(*scope, t)
    ring = rows.withColumn("_i", F.row_number().over(w.orderBy(order, track))).withColumn("_n", F.count("*").over(w))
    ring = ring.select(*scope, (F.col(t) - tau).alias(t), "_i", "_n", F.col(track).alias("_track"))
    own = anchors.join(ring.withColumnRenamed("_track", track), [*scope, t, track], "left")
    pick = F.when(F.col("_i").isNull(), 1).otherwise(F.col("_i") % F.col("_n") + 1)
    own = own.withColumn("_pick", pick).drop("_i", "_n")
    chosen = ring.select(*scope, t, F.col("_i").alias("_pick"), F.col("_track").alias("negative"))
    return own.join(chosen, [*scope, t, "_pick"]).where(F.col("negative") != F.col(track)).drop("_pick")


def first_match(rows: DataFrame, lookup: DataFrame, key: str, label: str, order: str, default: str = "unknown") -> DataFrame:
    """The label of the first lookup row for the key, or the default."""
    one = lookup.groupBy(key).agg(F.min_by(label, order).alias(label))
    return rows.join(one, key, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def per_channel(rows: DataFrame, channels: DataFrame, scope: str, well: str, wells: str) -> DataFrame:
    """A row for each channel of the row's scope that has no list of wells or lists the row's well."""
    return rows.join(channels, scope).where((F.size(wells) == 0) | F.expr(f"array_contains({wells}, {well})")).drop(wells)


def merge_metrics(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer 1:1 join; keys must be unique on both sides."""
    for name, side in (("left", a), ("right", b)):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{name} keys aren't unique")
    return a.join(b, keys, "full")


def folded_lookup(rows: DataFrame, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """All distinct values of a key as one ;-list, and whether there are any."""
    one = lookup.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ";").alias(out))
    return rows.join(one, key, "left").withColumns({out: F.coalesce(out, F.lit("")), f"has_{out}": F.col(out).isNotNull()})


def alias_match(names: DataFrame, aliases: DataFrame, name: str, alias: str, label: str, order: str) -> DataFrame:
    """The label of the first alias that a name contains, ignoring case, or null.

    Names are taken apart into their substrings of the lengths that aliases have, which meet the aliases by an equi join.
    """
    lengths = [r.n for r in aliases.select(F.length(alias).alias("n")).where("n > 0").distinct().collect()]  # as many as the longest alias has letters
    substrings = [f"transform(sequence(1, greatest(length({name}) - {n - 1}, 1)), i -> substring(lower({name}), i, {n}))" for n in lengths]
    part = F.expr(f"flatten(array({', '.join(substrings)}))") if lengths else F.array().cast("array<string>")
    parts = names.select(name).distinct().select(name, F.explode(F.array_distinct(part)).alias("_part"))
    hit = parts.join(aliases.withColumn("_part", F.lower(alias)), "_part")
    one = hit.groupBy(name).agg(F.min_by(label, order).alias(label))
    return names.join(one, name, "left")


def register(paths: DataFrame, records: DataFrame, templates: DataFrame, dataset: str, fov: str, well: str, columns: list[str]) -> DataFrame:
    """What to do with each position: updated (its record exists), created (from the well's template) or unmatched, with the columns to write."""
    known = records.select(dataset, fov, *[F.col(c).alias(f"own_{c}") for c in columns], F.lit(1).alias("_known"))
    base = templates.select(dataset, well, *[F.col(c).alias(f"well_{c}") for c in columns], F.lit(1).alias("_base"))
    j = paths.join(known, [dataset, fov], "left").join(base, [dataset, well], "left")
    action = F.when(F.col("_known").isNotNull(), "updated").when(F.col("_base").isNotNull(), "created").otherwise("unmatched")
    return j.select(dataset, well, fov, action.alias("action"), *[F.coalesce(f"own_{c}", F.when(F.col("_known").isNull(), F.col(f"well_{c}"))).alias(c) for c in columns])


def spine_labels(tracks: DataFrame, intervals: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """A row for each frame before..after of a track: positive inside an interval [t_on, t_off], negative outside, '' for tracks without intervals."""
    spine = tracks.select(*keys, F.explode(F.sequence(before, after)).alias("t"))
    held = intervals.select(*keys, F.explode(F.sequence("t_on", "t_off")).alias("t")).distinct().withColumn("_in", F.lit(True))
    given = intervals.select(*keys).distinct().withColumn("_given", F.lit(True))
    j = spine.join(held, [*keys, "t"], "left").join(given, keys, "left")
    label = F.when(F.col("_given").isNull(), "").when(F.col("_in"), "positive").otherwise("negative")
    return j.select(*keys, "t", label.alias("label"))


def pairwise(groups: DataFrame, within: list[str], name: str, columns: list[str]) -> DataFrame:
    """Unordered pairs of group rows that share `within`: name_a < name_b. Groups are aggregated rows, few of each kind."""
    a = groups.select(*within, F.col(name).alias(f"{name}_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = groups.select(*within, F.col(name).alias(f"{name}_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, within).where(F.col(f"{name}_a") < F.col(f"{name}_b"))


def labelled(rows: DataFrame, label: str, unknown: tuple[str, ...] = ("", "unknown")) -> DataFrame:
    """Rows whose label is given: not null, empty or unknown."""
    return rows.where(F.col(label).isNotNull() & ~F.col(label).isin(*unknown))


def matches_any(column: str, patterns: list[str]) -> Column:
    """Whether a column contains one of the patterns, literally."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.contains(F.col(column), F.lit(p))
    return found


def annotated_by_first_keys(rows: DataFrame, labels: DataFrame, key_sets: list[list[str]], columns: list[str], path: str | None = None) -> DataFrame:
    """Rows with columns of the labels, joined by the first set of keys that both tables have; leading slashes of the path column are taken off on both sides. Of labels
    with the same keys one counts, that which sorts first. Raises ValueError if no set fits."""
    keys = next((k for k in key_sets if set(k) <= set(rows.columns) & set(labels.columns)), None)
    if keys is None:
        raise ValueError(f"no set of keys is in both tables: {key_sets}")
    if path:
        rows, labels = (d.withColumn(path, F.regexp_replace(path, "^/+", "")) if path in d.columns else d for d in (rows, labels))
    first = labels.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in columns])
    return rows.drop(*columns).join(first, keys, "left")
