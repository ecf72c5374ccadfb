"""Rank tests, exact tests and permutation tests by group. Ranks and sums are Spark's; a few scalars a group end in a small function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracklake.operators.aggregates import ranked


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def _fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def p(a: int, b: int, c: int, d: int) -> float:
        row, other, column = a + b, c + d, a + c
        total = choose(row + other, column)
        return min(1.0, sum(math.exp(choose(row, k) + choose(other, column - k) - total) for k in range(a, min(row, column) + 1)))

    return pd.Series([p(*map(int, x)) for x in zip(a, b, c, d, strict=True)])


def mann_whitney(rows: DataFrame, keys: list[str], value: str, first: str) -> DataFrame:
    """Of each group: n1, n0, U of the rows where `first` holds, and its two-sided p by the normal approximation with ties and continuity."""
    r = ranked(rows, keys, value, "_r", "_t")
    a = r.groupBy(*keys).agg(F.count(F.when(F.col(first), 1)).alias("n1"), F.count(F.when(~F.col(first), 1)).alias("n0"), F.sum(F.when(F.col(first), F.col("_r"))).alias("s"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("ties"))
    n = (F.col("n1") + F.col("n0")).cast("double")
    u, mean = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0") / 2
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    a = a.withColumn("u", u).withColumn("z", F.when((F.col("n1") > 0) & (F.col("n0") > 0) & (sd > 0), F.greatest(F.lit(0.0), F.abs(u - mean) - 0.5) / sd))
    return a.select(*keys, "n1", "n0", "u", _two_sided("z").alias("p"))


def wilcoxon(rows: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """Signed-rank test of each group: n without zeros, W of the positive differences, two-sided p by the normal approximation with ties."""
    r = rows.where(F.col(difference).isNotNull() & (F.col(difference) != 0)).withColumn("_a", F.abs(difference))
    r = ranked(r, keys, "_a", "_r", "_t")
    a = r.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col(difference) > 0, F.col("_r")).otherwise(0.0)).alias("w"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return a.withColumn("z", F.when(sd > 0, (F.col("w") - n * (n + 1) / 4) / sd)).select(*keys, "n", "w", _two_sided("z").alias("p"))


def fisher(rows: DataFrame, keys: list[str], treated: str, positive: str) -> DataFrame:
    """One-sided exact test of each group's 2 x 2 table: whether treated rows are positive more often."""
    t, p = F.col(treated), F.col(positive)
    c = rows.groupBy(*keys).agg(*[F.count(F.when(k, 1)).alias(n) for n, k in (("a", t & p), ("b", t & ~p), ("c", ~t & p), ("d", ~t & ~p))])
    return c.withColumn("p", _fisher_greater("a", "b", "c", "d"))


def mmd_permutation(rows: DataFrame, keys: list[str], first: str, vector: str, row: str, most: int = 1000, permutations: int = 200, seed: int = 42) -> DataFrame:
    """Of each group: n1, n0, bandwidth (median heuristic), unbiased squared MMD, p and effect by permuting labels.

    `most` rows of each side by hashed order take part: a cap of the statistic, which makes a group's memory bounded.
    """
    from tracklake.operators.index import capped_sample

    held = capped_sample(rows.where(F.col(first).isNotNull()), [*keys, first], row, most, str(seed)).select(*keys, F.col(first).alias("_f"), F.col(row).alias("_row"), F.col(vector).alias("_v"))
    kinds = dict(rows.dtypes)

    def test(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        x, f = np.array(table.column("_v").to_pylist(), np.float64), table.column("_f").to_numpy(zero_copy_only=False).astype(bool)
        n, m = int(f.sum()), int((~f).sum())
        found: list = [n, m, None, None, None, None]
        if n > 1 and m > 1:
            d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0)
            h = float(np.median(d[np.triu_indices(len(x), 1)])) + 1e-12
            k = np.exp(-d / (2 * h))
            np.fill_diagonal(k, 0)

            def value(f: np.ndarray) -> float:
                w = np.where(f, 1.0, 0.0)
                a, b = w @ k @ w, (1 - w) @ k @ (1 - w)
                return a / (n * (n - 1)) + b / (m * (m - 1)) - 2 * (w @ k @ (1 - w)) / (n * m)

            rng, observed = np.random.default_rng(seed), value(f)
            null = np.array([value(rng.permutation(f)) for _ in range(permutations)])
            found = [n, m, h, observed, float(((null >= observed).sum() + 1) / (permutations + 1)), (observed - null.mean()) / (null.std() + 1e-12)]
        names = [*keys, "n1", "n0", "bandwidth", "mmd2", "p", "z"]
        types = [*[s.type for s in key], pa.int64(), pa.int64(), *[pa.float64()] * 4]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip([*[s.as_py() for s in key], *found], types, strict=True)], names=names)

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n1 long, n0 long, bandwidth double, mmd2 double, p double, z double"])
    return held.groupBy(*keys).applyInArrow(test, schema)
