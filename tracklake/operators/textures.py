"""Texture and shape of the regions of label images, by joins of pixels with their neighbours. Pixels are rows (image, y, x, label, value); label 0 is background."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stretched(pixels: DataFrame, image: list[str], value: str, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Values of each image clipped to its percentiles and brought to 0 to 1; images without spread become 0."""
    p = pixels.groupBy(*image).agg(F.percentile(F.col(value).cast("double"), F.array(F.lit(low / 100), F.lit(high / 100))).alias("_p"))
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    v = F.when(hi > lo, (F.least(F.greatest(F.col(value), lo), hi) - lo) / (hi - lo)).otherwise(0.0)
    return pixels.join(F.broadcast(p) if not image else p, image).withColumn(value, v).drop("_p") if image else pixels.crossJoin(F.broadcast(p)).withColumn(value, v).drop("_p")  # one row


def _moved(pixels: DataFrame, image: list[str], moves: list[tuple[int, int]], columns: dict[str, str]) -> DataFrame:
    """Every pixel once for each move (m, y, x): the place it is a neighbour of, with columns under other names."""
    to = F.array(*[F.struct(F.lit(i).alias("m"), (F.col("y") - dy).cast("long").alias("y"), (F.col("x") - dx).cast("long").alias("x")) for i, (dy, dx) in enumerate(moves)])
    return pixels.select(*image, *[F.col(c).alias(n) for c, n in columns.items()], F.explode(to).alias("_to")).select(*image, *columns.values(), "_to.*")


def co_occurrence(pixels: DataFrame, image: list[str], label: str, value: str, levels: int = 32, distance: int = 1) -> DataFrame:
    """Of each region: contrast, dissimilarity, homogeneity, asm, energy, correlation and entropy (natural) of its symmetric matrix of grey levels side by side.

    Values from 0 to 1 are cut into `levels`; the neighbours are those at the distance to the right, below and on both diagonals, within the same region, counted together.
    Regions without such a pair have nulls. Correlation is 1 for regions of one level. A region's matrix has at most levels ** 2 entries.
    """
    level = F.least(F.greatest(F.floor(F.col(value) * levels), F.lit(0)), F.lit(levels - 1)).cast("int")
    p = pixels.where(F.col(label) > 0).select(*image, "y", "x", F.col(label).alias("_label"), level.alias("_a"))
    d = distance
    other = _moved(p, image, [(0, d), (d, 0), (d, d), (d, -d)], {"_label": "_label", "_a": "_b"})
    pairs = p.withColumns({c: F.col(c).cast("long") for c in "yx"}).join(other, [*image, "_label", "y", "x"]).groupBy(*image, "_label", "_a", "_b").agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.select(*image, "_label", F.col("_b").alias("_a"), F.col("_a").alias("_b"), "n")).groupBy(*image, "_label", "_a", "_b").agg(F.sum("n").alias("n"))
    key = [*image, "_label"]
    # a symmetric matrix: both sides have the same mean and variance
    s = both.groupBy(*key).agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("_a")) / F.sum("n")).alias("mean"))
    q, gap = F.col("n") / F.col("all"), (F.col("_a") - F.col("_b")).cast("double")
    a, b = F.col("_a") - F.col("mean"), F.col("_b") - F.col("mean")
    f = both.join(s, key).groupBy(*key).agg(
        F.sum(q * gap * gap).alias("contrast"), F.sum(q * F.abs(gap)).alias("dissimilarity"), F.sum(q / (1 + gap * gap)).alias("homogeneity"), F.sum(q * q).alias("asm"), F.sqrt(F.sum(q * q)).alias("energy"),
        F.when(F.sum(q * a * a) > 1e-15, F.sum(q * a * b) / F.sum(q * a * a)).otherwise(1.0).alias("correlation"), (-F.sum(q * F.ln(q))).alias("entropy"),
    )
    labels = p.select(*key).distinct()
    return labels.join(f, key, "left").withColumnRenamed("_label", label)


def edges(pixels: DataFrame, image: list[str], label: str, value: str) -> DataFrame:
    """Of each region: mean and population deviation of the gradient (the root of the mean square of both Sobel filters, each over 4) and the variance of the Laplacian of its pixels.

    At the border of the image the nearest pixel stands in for a missing one. Images are full grids: a row for every place.
    """
    size = pixels.groupBy(*image).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    p = pixels.select(*image, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(label).alias("_label"), F.col(value).cast("double").alias("_v"))
    moves = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    want = p.join(size, image) if image else p.crossJoin(F.broadcast(size))  # one row
    to = F.array(*[F.struct(F.lit(i).alias("m"), F.least(F.greatest(F.col("y") + dy, F.col("_y0")), F.col("_y1")).alias("y"), F.least(F.greatest(F.col("x") + dx, F.col("_x0")), F.col("_x1")).alias("x")) for i, (dy, dx) in enumerate(moves)])
    want = want.select(*image, F.col("y").alias("_py"), F.col("x").alias("_px"), "_label", F.explode(to).alias("_to")).where("_label > 0").select(*image, "_py", "_px", "_label", "_to.*")
    near = want.join(p.select(*image, "y", "x", "_v"), [*image, "y", "x"])
    weights = {
        "gy": {(dy, dx): dy * (2 - abs(dx)) / 4 for dy, dx in moves},
        "gx": {(dy, dx): dx * (2 - abs(dy)) / 4 for dy, dx in moves},
        "lap": {(dy, dx): {0: -4.0, 1: 1.0, 2: 0.0}[abs(dy) + abs(dx)] for dy, dx in moves},
    }
    w = {k: F.element_at(F.array(*[F.lit(float(v[m])) for m in moves]), F.col("m") + 1) for k, v in weights.items()}
    per = near.groupBy(*image, "_label", "_py", "_px").agg(*[F.sum(w[k] * F.col("_v")).alias(k) for k in w])
    g = F.sqrt((F.col("gy") ** 2 + F.col("gx") ** 2) / 2)
    out = per.groupBy(*image, "_label").agg(F.avg(g).alias("gradient_mean"), F.stddev_pop(g).alias("gradient_std"), F.var_pop("lap").alias("laplacian_var"))
    return out.withColumnRenamed("_label", label)


def texture_features(pixels: DataFrame, image: list[str], label: str, value: str, levels: int = 32) -> DataFrame:
    """Of each region, on values stretched to 0 to 1 by image: mean, std, min, max, percentiles 10 to 90, iqr, skewness and excess kurtosis (population), gradient_mean, gradient_std, laplacian_var
    and the seven measures of `co_occurrence`. Percentiles and moments of a region come from one aggregation."""
    p = stretched(pixels, image, value)
    v, at = F.col(value), [10, 25, 50, 75, 90]
    q = F.percentile(v, F.array(*[F.lit(k / 100) for k in at]))
    base = p.where(F.col(label) > 0).groupBy(*image, label).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), *[q[i].alias(f"p{k}") for i, k in enumerate(at)], (q[3] - q[1]).alias("iqr"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"),
    )
    return base.join(edges(p, image, label, value), [*image, label]).join(co_occurrence(p, image, label, value, levels), [*image, label])


def squared_depths(inside: np.ndarray) -> np.ndarray:
    """Squared distance of each inner pixel to the nearest pixel that isn't inside, exact, in two passes: along columns, then for each row the least over columns. Infinite where all are inside."""
    h, w = inside.shape
    up = np.where(inside, np.inf, 0.0)
    for y in range(1, h):
        up[y] = np.minimum(up[y], up[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        up[y] = np.minimum(up[y], up[y + 1] + 1)
    squares, gap = up**2, (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    return np.stack([(row[None, :] + gap).min(1) for row in squares])


def shapes(pixels: DataFrame, image: list[str], label: str, value: str) -> DataFrame:
    """Of each region: area, perimeter (edges of its pixels towards other labels or beyond the image), perimeter_area, eccentricity (of the ellipse with its second moments), masked_intensity
    (the sum of its values) and localization: the mean of value times depth over the mean value, depth being the distance to the nearest place outside of the region, over the greatest depth.

    Perimeter, area and moments are sums over joins with neighbours; the distance transform is one region's box in a task.
    """
    p = pixels.where(F.col(label) > 0).select(*image, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(label).alias("_label"), F.col(value).cast("double").alias("_v"))
    key = [*image, "_label"]
    other = _moved(p, image, [(0, 1), (1, 0), (0, -1), (-1, 0)], {"_label": "_label"})
    shared = p.join(other, [*key, "y", "x"]).groupBy(*key).agg(F.count("*").alias("_shared"))
    s = p.groupBy(*key).agg(F.count("*").alias("area"), F.sum("_v").alias("masked_intensity"), F.var_pop("y").alias("_yy"), F.var_pop("x").alias("_xx"), F.covar_pop("y", "x").alias("_xy")).join(shared, key, "left")
    half, root = (F.col("_yy") + F.col("_xx")) / 2, F.sqrt(((F.col("_yy") - F.col("_xx")) / 2) ** 2 + F.col("_xy") ** 2)
    perimeter = 4 * F.col("area") - F.coalesce("_shared", F.lit(0))
    s = s.select(*key, "area", perimeter.alias("perimeter"), (perimeter / F.col("area")).alias("perimeter_area"), F.when(half + root > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - (half - root) / (half + root)))).otherwise(0.0).alias("eccentricity"), "masked_intensity")
    kinds = dict(p.dtypes)

    def depth(key: tuple, table: pa.Table) -> pa.Table:
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "_v"))
        inside = np.zeros((y.max() - y.min() + 3, x.max() - x.min() + 3), bool)
        at = (y - y.min() + 1, x - x.min() + 1)
        inside[at] = True
        d = np.sqrt(squared_depths(inside))[at]
        found = float((v * d / d.max()).mean() / v.mean()) if v.mean() else None
        return pa.Table.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], pa.array([found], pa.float64())], names=[*image, "_label", "localization"])

    local = p.groupBy(*key).applyInArrow(depth, ", ".join([*[f"`{k}` {kinds[k]}" for k in key], "localization double"]))
    return s.join(local, key).withColumnRenamed("_label", label)
