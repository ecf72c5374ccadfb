"""How smooth tracks of vectors are against random pairs, for many models at once, and where distributions peak."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.lineage import cut, if_few, running
from tracklake.operators.aggregates import medians
from tracklake.operators.batches import draw
from tracklake.operators.index import hashed_order
from tracklake.operators.vectors import cosine_distance, squared_distance


def zscored(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Vectors as z scores of their components within groups (population deviation; below 1e-10 it counts as 1)."""
    e = rows.select(*keys, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_d"))
    s = e.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", F.when(F.col("_d") < 1e-10, 1.0).otherwise(F.col("_d")).alias("_d")))).alias("_s"))
    return rows.join(if_few(s), keys).withColumn(vector, F.zip_with(vector, "_s", lambda x, c: (x.cast("double") - c["_m"]) / c["_d"])).drop("_s")


def local_peak(at: np.ndarray, height: np.ndarray, share: float = 0.1) -> float:
    """Where the highest local maximum inside of the range is, of those with at least `share` of the greatest height; the middle of a flat one. Without any: where the height is greatest."""
    best = None
    i = 1
    while i < len(height) - 1:
        if height[i] > height[i - 1]:
            j = i
            while j + 1 < len(height) and height[j + 1] == height[i]:
                j += 1
            if j + 1 < len(height) and height[j + 1] < height[i] and height[i] >= share * height.max() and (best is None or height[i] > height[best]):
                best = (i + j) // 2
            i = j
        i += 1
    return float(at[int(np.argmax(height)) if best is None else best])


def distribution_peaks(rows: DataFrame, keys: list[str], value: str, method: str = "density", bins: int = 50, fine: int = 8192, points: int = 1000) -> DataFrame:
    """Of each group: n, and the peak of its values: of a histogram of `bins` bins (its centre), or of a normal kernel density (bandwidth n ** (-1 / 5) deviations), taken at `points`
    places from the least to the greatest value. Null and non-finite values are left out; a group of one value has that as its peak.

    Values are counted in bins where they are (for the density in `fine` of them, each value shared between the two nearest bin centres), so what a task holds of a group is its bins.
    """
    x = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(*keys, F.col(value).cast("double").alias("_x"))
    ends = x.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n"), F.stddev_samp("_x").alias("_d"))
    x = x.join(if_few(ends), keys)
    width = F.col("_hi") - F.col("_lo")
    if method == "histogram":
        b = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) / width * bins))).otherwise(0)
        x = x.select(*keys, "_lo", "_hi", "_n", "_d", b.cast("int").alias("_b"), F.lit(1.0).alias("_w"))
    else:
        at = F.when(width > 0, (F.col("_x") - F.col("_lo")) / width * (fine - 1)).otherwise(0.0)
        low = F.least(F.floor(at), F.lit(fine - 2))
        both = F.array(F.struct(low.cast("int").alias("_b"), (low + 1 - at).alias("_w")), F.struct((low + 1).cast("int").alias("_b"), (at - low).alias("_w")))
        x = x.select(*keys, "_lo", "_hi", "_n", "_d", F.inline(both))
    held = x.groupBy(*keys, "_lo", "_hi", "_n", "_d", "_b").agg(F.sum("_w").alias("_w"))
    kinds = dict(held.dtypes)

    def peak(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi, n, d = (table.column(c)[0].as_py() for c in ("_lo", "_hi", "_n", "_d"))
        b, w = table.column("_b").to_numpy(), table.column("_w").to_numpy()
        if hi == lo:
            found = lo
        elif method == "histogram":
            height = np.bincount(b, w, bins)
            found = local_peak(lo + (np.arange(bins) + 0.5) * (hi - lo) / bins, height)
        else:
            places, centres, h = np.linspace(lo, hi, points), lo + b * (hi - lo) / (fine - 1), d * n ** (-0.2)
            height = np.concatenate([(np.exp(-0.5 * ((p[:, None] - centres) / h) ** 2) * w).sum(1) for p in np.array_split(places, 20)])
            found = local_peak(places, height)
        return pa.Table.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], pa.array([n], pa.int64()), pa.array([found], pa.float64())], names=[*keys, "n", "peak"])

    return held.groupBy(*keys).applyInArrow(peak, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, peak double"]))


def track_distances(rows: DataFrame, models: list[str], track: list[str], t: str, vector: str, offsets: tuple[int, ...] = (1,), metric: str = "cosine", seed: str = "42") -> DataFrame:
    """(models, kind, distance) of z scored vectors: adjacent, between a row of a track and the one `offset` rows later; and as many random, between two different rows of the model.

    Rows of a model are numbered in a hashed order; the pair for an adjacent distance follows from a digest of its row, so pairs are made by joins on numbers. Models with one row have no random pairs.
    """
    distance = cosine_distance if metric == "cosine" else lambda a, b: F.sqrt(squared_distance(a, b))
    x = zscored(rows.where(F.col(vector).isNotNull()).select(*dict.fromkeys([*models, *track, t]), F.col(vector).alias("_v")), models, "_v")
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*track, t]])
    x = running(x.withColumn("_key", key).withColumns({"_o": hashed_order(seed, "_key"), "_one": F.lit(1)}), models, "_o", {"_at": "_one"})
    x = cut(x.withColumn("_at", F.col("_at") - 1).drop("_o", "_one"))
    own = Window.partitionBy(*dict.fromkeys([*models, *track])).orderBy(t)
    steps = x.withColumn("_later", F.array(*[F.lead("_v", k).over(own) for k in offsets])).select("*", F.posexplode("_later").alias("_k", "_next")).where("_next IS NOT NULL")
    near = steps.select(*models, F.lit("adjacent").alias("kind"), distance("_v", "_next").alias("distance"))
    sizes = x.groupBy(*models).agg(F.count("*").alias("_all")).where("_all > 1")
    pairs = steps.select(*models, "_key", "_k").join(if_few(sizes), models)
    i = draw(seed, "_key", "_k", F.lit("i")) % F.col("_all")
    j = draw(seed, "_key", "_k", F.lit("j")) % (F.col("_all") - 1)
    pairs = pairs.withColumn("_i", i).withColumn("_j", j).select(*models, F.col("_i").alias("_at"), (F.col("_j") + (F.col("_j") >= F.col("_i")).cast("int")).alias("_to"))
    far = pairs.join(x.select(*models, "_at", F.col("_v").alias("_a")), [*models, "_at"]).drop("_at").withColumnRenamed("_to", "_at").join(x.select(*models, "_at", F.col("_v").alias("_b")), [*models, "_at"])
    return near.unionByName(far.select(*models, F.lit("random").alias("kind"), distance("_a", "_b").alias("distance")))


def smoothness(rows: DataFrame, models: list[str], track: list[str], t: str, vector: str, offsets: tuple[int, ...] = (1,), metric: str = "cosine", seed: str = "42", peaks: bool = True) -> DataFrame:
    """A row for each model: n, and of adjacent and random distances mean, std, median and peak (of a density); smoothness (the ratio of both means) and dynamic_range (the
    difference of both peaks). Models without adjacent rows have none. peaks=False leaves the peaks and the range out."""
    d = cut(track_distances(rows, models, track, t, vector, offsets, metric, seed))
    keys = [*models, "kind"]
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std")).join(medians(d, keys, "distance"), keys)
    names = ["mean", "std", "median"]
    if peaks:
        s, names = s.join(distribution_peaks(d, keys, "distance").drop("n"), keys), [*names, "peak"]
    side = lambda kind: [F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}") for c in names]
    out = s.groupBy(*models).agg(F.max(F.when(F.col("kind") == "adjacent", F.col("n"))).alias("n"), *side("adjacent"), *side("random"))
    out = out.withColumn("smoothness", F.col("adjacent_mean") / F.col("random_mean"))
    return out.withColumn("dynamic_range", F.col("random_peak") - F.col("adjacent_peak")) if peaks else out
