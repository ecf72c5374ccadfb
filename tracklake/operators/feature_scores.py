"""How far two sets of vectors, found and true, are apart: kernel distance on subsets, precision and recall of their manifolds, sliced transport, cosines of pairs.

Rows of each side are numbered in a hashed order once. A subset or a resample is a set of numbers that follows from its own number alone, so it is a group of bounded size, whatever
the table's; all subsets are scored at the same time, each in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions.lineage import cut, running
from tracklake.operators.batches import STRIDES, draw
from tracklake.operators.index import hashed_order
from tracklake.operators.vectors import cosine_distance, norm


def _finite(vector: str):
    v = F.transform(vector, lambda x: x.cast("double"))
    return F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), v)


def _placed(rows: DataFrame, found: str, vector: str, row: str, seed: str) -> tuple[DataFrame, dict[bool, int]]:
    """(side, place, v) of rows with a side and a finite vector, and how many rows each side has. Places start at 0 on each side."""
    x = rows.select(F.col(found).cast("boolean").alias("side"), _finite(vector).alias("v"), F.col(row).alias("_row")).where("side IS NOT NULL AND v IS NOT NULL")
    x = running(x.select("side", "v", "_row", hashed_order(seed, "_row").alias("_o"), F.lit(1).alias("_one")), ["side"], "_o", {"place": "_one"})
    x = cut(x.select("side", (F.col("place") - 1).alias("place"), "v"))
    n = {r.side: r.n for r in x.groupBy("side").agg(F.count("*").alias("n")).collect()}
    return x, {s: n.get(s, 0) for s in (True, False)}


def _matrices(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors found and true, in the order of their places in the group."""
    table = table.sort_by("slot")
    side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
    v = np.array(table.column("v").to_pylist(), np.float64)
    return v[side], v[~side]


def kernel_distance(rows: DataFrame, found: str, vector: str, row: str, subsets: int = 100, size: int = 1000, least: int = 16, seed: str = "2020") -> DataFrame:
    """One row: size (of a subset), mean and std over subsets of the unbiased squared discrepancy with the kernel (x * y / d + 1) ** 3; null where a side has fewer than `least` rows.

    A subset has as many rows of either side, drawn without replacement: those whose place, times a prime plus an offset, modulo the side's rows, is below the size.
    """
    x, n = _placed(rows, found, vector, row, seed)
    m = min(size, *n.values())
    if m < max(2, least):
        return rows.sparkSession.createDataFrame([(m, None, None)], "size long, mean double, std double")
    total = F.when(F.col("side"), n[True]).otherwise(n[False])
    s = x.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(subsets - 1))))
    stride = F.element_at(F.array(*map(F.lit, STRIDES)), (draw(seed, "subset", "side", F.lit("stride")) % len(STRIDES)).cast("int") + 1)
    s = s.withColumn("slot", (F.col("place") * (stride % total) + draw(seed, "subset", "side", F.lit("start")) % total) % total).where(F.col("slot") < m)

    def score(key: tuple, table: pa.Table) -> pa.Table:
        a, b = _matrices(table)
        kernel = lambda p, q: (p @ q.T / p.shape[1] + 1) ** 3
        own = lambda k: (k.sum() - np.trace(k)) / (m * (m - 1))
        return pa.table({"subset": [key[0].as_py()], "d": [float(own(kernel(a, a)) + own(kernel(b, b)) - 2 * kernel(a, b).mean())]}, schema=pa.schema([("subset", pa.int32()), ("d", pa.float64())]))

    return s.select("subset", "side", "slot", "v").groupBy("subset").applyInArrow(score, "subset int, d double").agg(F.lit(m).cast("long").alias("size"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))


def manifold_scores(rows: DataFrame, found: str, vector: str, row: str, neighbours: int = 3, resamples: int = 10, size: int = 1000, seed: str = "2020") -> DataFrame:
    """One row: means and deviations over bootstrap resamples of precision (the share of found vectors within some true vector's distance to its k-th neighbour),
    recall (the other way round) and f1. A resample draws `size` rows of each side with replacement; a row drawn twice is its own neighbour."""
    x, n = _placed(rows, found, vector, row, seed)
    names = ["precision", "recall", "f1"]
    if not min(n.values()) or size <= neighbours:
        return rows.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"{c}_{k}") for c in names for k in ("mean", "std")])
    spark = rows.sparkSession
    slots = spark.range(resamples * size * 2).select(F.expr(f"cast(id div {2 * size} AS int)").alias("resample"), F.expr(f"cast((id div 2) % {size} AS int)").alias("slot"), (F.col("id") % 2 == 0).alias("side"))
    total = F.when(F.col("side"), n[True]).otherwise(n[False])
    drawn = slots.withColumn("place", draw(seed, "resample", "side", "slot") % total).join(x, ["side", "place"])

    def score(key: tuple, table: pa.Table) -> pa.Table:
        a, b = _matrices(table)

        def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return np.stack([np.sqrt(((q - r) ** 2).sum(1)) for r in p])

        def covered(p: np.ndarray, q: np.ndarray) -> float:
            radius = np.partition(far(q, q), neighbours, axis=1)[:, neighbours]  # itself is the nearest
            return float((far(p, q) <= radius).any(1).mean())

        precision, recall = covered(a, b), covered(b, a)
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        return pa.table({"precision": [precision], "recall": [recall], "f1": [f1]})

    per = drawn.select("resample", "side", "slot", "v").groupBy("resample").applyInArrow(score, "precision double, recall double, f1 double")
    return per.agg(*[f(c).alias(f"{c}_{k}") for c in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))])


def directions(dimensions: int, projections: int, seed: int) -> np.ndarray:
    """Unit vectors, evenly spread over all directions."""
    d = np.random.default_rng(seed).normal(size=(projections, dimensions))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def sliced_transport(rows: DataFrame, found: str, vector: str, row: str, projections: int = 64, seed: int = 2020) -> DataFrame:
    """One row: distance, the mean over random directions of the squared distance that moves the found vectors' projections to the true ones'; null if a side is empty.

    Exact for sides of any sizes n and m: a side's r-th smallest value holds the r-th of its equal parts of the mass, and parts of both sides that overlap are compared. The values of a
    direction are numbered by running counts over ranges, so no task holds a direction. Rows with non-finite vectors are left out.
    """
    x = rows.select(F.col(found).cast("boolean").alias("side"), _finite(vector).alias("v"), F.col(row).alias("_row")).where("side IS NOT NULL AND v IS NOT NULL")
    first = x.select(F.size("v").alias("d")).first()
    n = {r.side: r.n for r in x.groupBy("side").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return rows.sparkSession.createDataFrame([(None,)], "distance double")
    onto = directions(first.d, projections, seed)
    values = F.array(*[F.aggregate(F.zip_with("v", F.array(*map(F.lit, u.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a) for u in onto]) if projections * first.d <= 4096 else None
    if values is None:  # many numbers: as data, not as an expression

        def project(batches):
            for b in batches:
                if b.num_rows:
                    p = np.array(b.column("v").to_pylist(), np.float64) @ onto.T
                    yield pa.RecordBatch.from_arrays([b.column("side"), b.column("_row").cast(pa.string()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["side", "_row", "ps"])

        x = x.mapInArrow(project, "side boolean, _row string, ps array<double>")
    else:
        x = x.select("side", F.col("_row").cast("string").alias("_row"), values.alias("ps"))
    x = x.select("side", "_row", F.posexplode("ps").alias("direction", "value"))
    x = running(x.withColumns({"_o": F.struct("value", "_row"), "_one": F.lit(1)}), ["direction", "side"], "_o", {"rank": "_one"})
    x = x.select("direction", "side", (F.col("rank") - 1).alias("rank"), "value")
    a, b = n[True], n[False]
    # in units of 1 / (a * b) a found value has the mass from rank * b on, a true one that from rank * a on
    left = x.where("side").select("direction", F.col("rank").alias("i"), F.col("value").alias("x"), F.explode(F.expr(f"sequence((rank * {b}L) div {a}, ((rank + 1) * {b}L - 1) div {a})")).alias("j"))
    both = left.join(x.where("NOT side").select("direction", F.col("rank").alias("j"), F.col("value").alias("y")), ["direction", "j"])
    mass = F.least((F.col("i") + 1) * b, (F.col("j") + 1) * a) - F.greatest(F.col("i") * b, F.col("j") * a)
    return both.agg((F.sum(mass * (F.col("x") - F.col("y")) ** 2) / (float(a) * b * projections)).alias("distance"))


def median_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, and the median cosine of pairs of vectors; pairs with a null, zero or non-finite vector are left out. The median is that of counts of distinct values."""
    p = pairs.select(_finite(a).alias("a"), _finite(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").where((norm("a") > 0) & (norm("b") > 0))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - cosine_distance("a", "b")))
    counts = running(p.select(cosine.alias("c")).groupBy("c").agg(F.count("*").alias("n")), [], "c", {"upto": "n"})
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    held = counts.crossJoin(F.broadcast(total)).where("2 * upto >= all AND 2 * (upto - n) <= all")  # one or two values
    return held.agg(F.coalesce(F.first("all"), F.lit(0)).alias("n"), F.avg("c").alias("median"))
