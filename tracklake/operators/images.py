"""Image operators on pixel rows (keys, z, y, x, value, label): features of regions, projections, overlap of segmentations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_sample(pixels: DataFrame, y: str, x: str, spacing: int) -> DataFrame:
    """Every n-th pixel in y and x, as the statistic asks for; the filter reaches the scan."""
    return pixels.where((F.col(y) % spacing == 0) & (F.col(x) % spacing == 0))


def region_features(pixels: DataFrame, keys: list[str], label: str, y: str, x: str, value: str) -> DataFrame:
    """Of each region but the background 0: area, centre, box, and mean, deviation, extremes, quartile range, population skewness and excess kurtosis of its values."""
    v = F.col(value).cast("double")
    p = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return pixels.where(F.col(label) > 0).groupBy(*keys, label).agg(
        F.count("*").alias("area"), F.avg(y).alias("centre_y"), F.avg(x).alias("centre_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.min(x).alias("min_x"), F.max(x).alias("max_x"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), (F.element_at(p, 3) - F.element_at(p, 1)).alias("iqr"), F.element_at(p, 2).alias("median"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"),
    )


def max_projection(pixels: DataFrame, keys: list[str], y: str, x: str, value: str) -> DataFrame:
    return pixels.groupBy(*keys, y, x).agg(F.max(value).alias(value))


def best_plane(planes: DataFrame, keys: list[str], z: str, power: str) -> DataFrame:
    """The plane with most power, the first of ties, and how far it leads the mean."""
    return planes.groupBy(*keys).agg(F.min_by(z, F.struct(-F.col(power), F.col(z))).alias("plane"), (F.max(power) - F.avg(power)).alias("lead"))


def normalised(pixels: DataFrame, keys: list[str], value: str, subtract: Column, divide: Column, eps: float = 1e-8) -> DataFrame:
    """(value - subtract) / (divide + eps) with aggregates over each group's window, such as its mean and deviation."""
    w = Window.partitionBy(*keys)
    return pixels.withColumn("normalised", (F.col(value) - subtract.over(w)) / (divide.over(w) + eps))


def variation_of_information(pixels: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Conditional entropies H(a | b) and H(b | a) in bits of two labellings of the same pixels."""
    joint = pixels.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    joint = joint.withColumns({"all": F.sum("n").over(w), "n_a": F.sum("n").over(Window.partitionBy(*keys, a)), "n_b": F.sum("n").over(Window.partitionBy(*keys, b))})
    p = F.col("n") / F.col("all")
    return joint.groupBy(*keys).agg((-F.sum(p * F.log2(F.col("n") / F.col("n_b")))).alias("a_given_b"), (-F.sum(p * F.log2(F.col("n") / F.col("n_a")))).alias("b_given_a"))


def instance_dice(ious: DataFrame, a: str, b: str, labels_a: DataFrame, labels_b: DataFrame) -> DataFrame:
    """Symmetric best dice: of each side's labels the mean of 2 i / (1 + i), i the best IoU or 0, then the mean of both sides."""
    def side(labels: DataFrame, k: str) -> DataFrame:
        best = labels.join(ious.groupBy(k).agg(F.max("iou").alias("i")), k, "left")
        return best.agg(F.avg(2 * F.coalesce("i", F.lit(0.0)) / (1 + F.coalesce("i", F.lit(0.0)))).alias(f"dice_{k}"))

    both = side(labels_a, a).crossJoin(side(labels_b, b))  # one row each
    return both.withColumn("sbd", (F.col(f"dice_{a}") + F.col(f"dice_{b}")) / 2)


def near_constant(rows: DataFrame, columns: list[str], frequency_cut: float = 0.05, unique_cut: float = 0.01) -> DataFrame:
    """Of each column: second over first value frequency, distinct share, and whether the column should go."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    # the two most frequent values by aggregation: a column has any number of values
    first = counts.groupBy("column").agg(F.max(F.struct("n", "value")).alias("_f"), F.sum("n").alias("_all"), F.count("*").alias("_values"))
    rest = counts.join(F.broadcast(first.select("column", "_f")), "column").where(~F.col("value").eqNullSafe(F.col("_f.value"))).groupBy("column").agg(F.max("n").alias("_second"))
    out = first.join(rest, "column", "left").select("column", (F.coalesce("_second", F.lit(0)) / F.col("_f.n")).alias("ratio"), (F.col("_values") / F.col("_all")).alias("distinct_share"))
    return out.withColumn("drop", (F.col("ratio") < frequency_cut) | (F.col("distinct_share") < unique_cut))
