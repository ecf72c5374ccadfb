"""Operators on embedding vectors, in array functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: str, b: str) -> Column:
    return 1 - dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, out: str = "centre") -> DataFrame:
    """Mean vector of each group, by component, so that partial sums are combined before the shuffle."""
    parts = rows.select(*keys, F.posexplode(vector).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias(out))


def component_stats(rows: DataFrame, vector: str) -> DataFrame:
    """Of each component: mean, population deviation (below 1e-10 it is 1), median and median absolute deviation."""
    e = rows.select(F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    s = e.groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", F.lit(0.5)).alias("median"))
    m = e.join(s.select("i", "median"), "i").groupBy("i").agg(F.percentile(F.abs(F.col("v") - F.col("median")), F.lit(0.5)).alias("mad"))
    return s.join(m, "i").withColumn("std", F.when(F.col("std") < 1e-10, 1.0).otherwise(F.col("std")))


def standardised(rows: DataFrame, vector: str, unit: bool = False) -> DataFrame:
    """Vectors as z scores of their components, and if asked of length 1. The statistics are one row, of sums that each task makes for itself."""
    e = rows.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))
    s = e.withColumn("std", F.when(F.col("std") < 1e-10, 1.0).otherwise(F.col("std"))).agg(F.array_sort(F.collect_list(F.struct("i", "mean", "std"))).alias("_s"))
    z = F.zip_with(vector, "_s", lambda v, s_: (v - s_["mean"]) / s_["std"])
    out = rows.crossJoin(F.broadcast(s)).withColumn(vector, z).drop("_s")
    return out.withColumn("_n", norm(vector)).withColumn(vector, F.transform(vector, lambda v: v / F.greatest("_n", F.lit(1e-12)))).drop("_n") if unit else out


def step_distances(rows: DataFrame, keys: list[str], t: str, vector: str) -> DataFrame:
    """Cosine distance of each row to the row before it in its track, rows without one left out."""
    w = Window.partitionBy(*keys).orderBy(t)
    return rows.withColumn("_before", F.lag(vector).over(w)).where("_before IS NOT NULL").withColumn("distance", cosine_distance(vector, "_before")).drop("_before")


def distance_from_group(rows: DataFrame, group: str, baseline: str | int, vector: str) -> DataFrame:
    """Cosine distance of every row to the mean vector of the baseline group. The mean is one row."""
    centre = mean_vectors(rows.where(F.col(group) == baseline).withColumn("_k", F.lit(1)), ["_k"], vector).select("centre")
    return rows.crossJoin(F.broadcast(centre)).withColumn("distance", cosine_distance(vector, "centre")).drop("centre")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def nearest_neighbours(queries: DataFrame, rows: DataFrame, row: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """Of each query its k nearest of all rows by squared distance, itself left out, ties by id: row, neighbour, rank, d2.

    Exact, in blocks: each block of queries meets each block of rows in a task of its own, which returns k rows a query; these
    are then ranked together.
    """
    def blocks(side: DataFrame, n: int) -> DataFrame:
        return side.select(F.col(row).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(row), F.lit(n)).alias("own"))

    nq, nr = (max(1, -(-side.count() // block)) for side in (queries, rows))
    q = blocks(queries, nq).select("id", "v", F.col("own").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nr - 1).cast("long"))).alias("rb"), F.lit(1).alias("kind"))
    r = blocks(rows, nr).select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"), F.col("own").alias("rb"), F.lit(0).alias("kind"))

    def best(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        a, b = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))
        if a.num_rows and b.num_rows:
            x, y, x_id, y_id = _matrix(a.column("v")), _matrix(b.column("v")), a.column("id").to_numpy(), b.column("id").to_numpy()
            for i in range(len(x)):
                d = ((y - x[i]) ** 2).sum(1)
                others = np.flatnonzero(y_id != x_id[i])
                own = others[np.lexsort((y_id[others], d[others]))[:k]]
                out.append((np.full(len(own), x_id[i]), y_id[own], d[own]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.empty(0) for c in range(3)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["id", "neighbour", "d2"])

    found = q.unionByName(r).groupBy("qb", "rb").applyInArrow(best, "id long, neighbour long, d2 double")
    w = Window.partitionBy("id").orderBy("d2", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias(row), "neighbour", "rank", "d2")


def median_bandwidth(rows: DataFrame, row: str, vector: str, most: int = 1000, seed: str = "h") -> DataFrame:
    """One row: the median of squared distances between `most` rows at most, by hashed order (the statistic's own sample, so one task holds it)."""
    held = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(row).cast("string"))), row).limit(most).select(F.col(vector).cast("array<double>").alias("v"))

    def median(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"))
        d = np.concatenate([((x[i + 1 :] - x[i]) ** 2).sum(1) for i in range(len(x) - 1)]) if len(x) > 1 else np.zeros(1)
        return pa.table({"bandwidth": pa.array([float(np.median(d))])})

    return held.groupBy().applyInArrow(median, "bandwidth double")


def mmd2(rows: DataFrame, group: str, a: str | int, b: str | int, row: str, vector: str, block: int = 2048) -> DataFrame:
    """Unbiased squared maximum mean discrepancy of two groups, all rows, with the kernel exp(-d2 / (2 h)), h the median heuristic.

    Kernel sums come from pairs of blocks, each a task that returns three sums and counts; no pairs of rows are made.
    """
    x = rows.where(F.col(group).isin(a, b))
    h = median_bandwidth(x, row, vector).first()[0]
    n = max(1, -(-x.count() // block))
    own = x.select((F.col(group) == a).alias("first"), F.col(row).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(row), F.lit(n)).alias("own"))
    sent = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("other")).select("first", "id", "v", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        p, q = key[0].as_py(), key[1].as_py()
        at, v, first, ids = table.column("own").to_numpy(), _matrix(table.column("v")), table.column("first").to_numpy(zero_copy_only=False).astype(bool), table.column("id").to_numpy()
        i, j, out = np.flatnonzero(at == p), np.flatnonzero(at == q), np.zeros((3, 2))
        for s in range(0, len(i), 256):
            part = i[s : s + 256]
            d = np.maximum((v[part] ** 2).sum(1)[:, None] + (v[j] ** 2).sum(1) - 2 * v[part] @ v[j].T, 0)
            k, use = np.exp(-d / (2 * h)), ids[part][:, None] != ids[j]
            f, g = first[part][:, None], first[j]
            for n_, mask in enumerate((f & g, ~f & ~g, f != g)):
                m = mask & use
                out[n_] += (k[m].sum(), m.sum())
        return pa.Table.from_arrays([pa.array([x]) for x in out.ravel()], names=["xx", "nx", "yy", "ny", "xy", "n"])

    s = sent.groupBy("p", "q").applyInArrow(sums, "xx double, nx double, yy double, ny double, xy double, n double")
    s = s.agg(*[(F.sum(c) / F.sum(d)).alias(c) for c, d in (("xx", "nx"), ("yy", "ny"), ("xy", "n"))])
    return s.select(F.lit(h).alias("bandwidth"), "xx", "yy", "xy", (F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("mmd2"))
