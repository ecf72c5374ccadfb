"""Whether two conditions differ in their vectors: maximum mean discrepancy with permuted labels, for many groups, comparisons and time bins in one job."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions.lineage import cut, running
from tracklake.operators.aggregates import benjamini_hochberg
from tracklake.operators.batches import STRIDES
from tracklake.operators.clusters import _matrix
from tracklake.operators.index import hashed_order
from tracklake.operators.vectors import mean_vectors


def centred(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Vectors less the mean vector of their group; rows with a null key are left out. The means are one row a group."""
    means = mean_vectors(rows, keys, vector, "_mean")
    return rows.join(means, keys).withColumn(vector, F.zip_with(vector, "_mean", lambda v, m: v.cast("double") - m)).drop("_mean")


def _number(*of: object) -> int:
    return int(hashlib.md5("|".join(map(str, of)).encode()).hexdigest()[:12], 16)


def permuted(place: np.ndarray, total: int, first: int, permutation: int, seed: str) -> np.ndarray:
    """Which places have the first label in a permutation: those whose place, times a prime plus an offset, modulo the total, is below their number. A bijection, so they
    are as many as in the data; places are a hashed order of the rows, so they say nothing of them."""
    stride, start = STRIDES[_number(seed, permutation, "stride") % len(STRIDES)] % total, _number(seed, permutation, "start") % total
    return (place * stride + start) % total < first


def mmd_tests(rows: DataFrame, keys: list[str], condition: str, comparisons: list[tuple[str, str, str]], vector: str, row: str, time: str | None = None, edges: list[float] | None = None, centre: list[str] | None = None, aliases: dict[str, str] | None = None, permutations: int = 200, least: int = 2, shared_bandwidth: bool = False, sample: int = 1000, seed: str = "42", block: int = 8192) -> DataFrame:
    """Of each group, time bin and comparison (name, a, b) of conditions: n_a, n_b, bandwidth, unbiased squared discrepancy mmd2, p, z, effect (mmd2 / bandwidth) and q.

    The kernel is exp(-d2 / (2 * bandwidth)), the bandwidth the median of squared distances between `sample` rows at most, by hashed order; with shared_bandwidth
    one for all comparisons of a group and bin. p is (1 + permutations that are as large) / (1 + permutations), z the distance from their mean in their
    deviations, q the false discovery rate over all rows of the result. Conditions can have aliases; bins are [edge, next edge); `centre` takes
    the mean of each group of those columns off first (batch effects). Comparisons with fewer than `least` rows on a side have nulls.

    All rows take part. Rows are numbered in a hashed order and dealt to blocks; each pair of blocks is a task (dealt to a partition of its own, by hash) that returns three kernel sums for each permutation,
    whose labels follow from a row's number alone. Row ids are distinct within a group; rows with null keys, condition, time or vector are left out.
    """
    c = F.col(condition).cast("string")
    if aliases:
        c = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), c), c)
    x = rows.where(F.col(vector).isNotNull()).select(*keys, *[k for k in centre or [] if k not in keys], c.alias("_c"), F.col(row).cast("long").alias("_row"), F.transform(vector, lambda v: v.cast("double")).alias("_v"), *([F.col(time).alias("_t")] if time else []))
    if centre:
        x = centred(x, centre, "_v")
    scope = [*keys, "comparison"]
    if time:
        if not edges:
            raise ValueError("time bins need their edges")
        bins = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(edges, edges[1:], strict=False)])
        x = x.withColumn("bin", F.try_element_at(F.transform(F.filter(bins, lambda b: (F.col("_t") >= b["lo"]) & (F.col("_t") < b["hi"])), lambda b: b["lo"]), F.lit(1)) if len(edges) > 1 else F.lit(None)).where("bin IS NOT NULL")
        scope = [*keys, "bin", "comparison"]
    named = F.array(*[F.struct(F.lit(n).alias("comparison"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in comparisons])
    for k in keys:
        x = x.where(F.col(k).isNotNull())
    x = x.withColumn("_p", F.explode(F.filter(named, lambda s: (s["a"] == F.col("_c")) | (s["b"] == F.col("_c"))))).withColumns({"comparison": F.col("_p.comparison"), "_first": F.col("_p.a") == F.col("_c")})
    x = x.select(*scope, "_row", "_v", "_first", hashed_order(seed, "_row").alias("_o"), F.lit(1).alias("_one"))
    x = running(x, scope, "_o", {"_place": "_one"})
    sizes = x.groupBy(*scope).agg(F.count("*").alias("_all"), F.count_if("_first").alias("n_a"), F.count_if(~F.col("_first")).alias("n_b"))
    x = cut(x.join(sizes, scope).where((F.col("n_a") >= max(2, least)) & (F.col("n_b") >= max(2, least))).withColumn("_place", F.col("_place") - 1))
    kinds = dict(x.dtypes)

    def median(key: tuple, table: pa.Table) -> pa.Table:
        _, at = np.unique(table.column("_row").to_numpy(), return_index=True)
        v = np.array(table.column("_v").to_pylist(), np.float64)[at]
        d = np.concatenate([((v[i + 1 :] - v[i]) ** 2).sum(1) for i in range(len(v) - 1)]) if len(v) > 1 else np.zeros(1)
        return pa.Table.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], pa.array([max(float(np.median(d)), 1e-12)])], names=[*wide, "bandwidth"])

    wide = [k for k in scope if not (shared_bandwidth and k == "comparison")]
    each = max(2, sample // len(comparisons)) if shared_bandwidth else sample
    schema = lambda names: ", ".join(f"`{k}` {kinds[k]}" for k in names)
    held = x.where(F.col("_place") < each).select(*wide, "_row", "_v") if wide else x.where(F.col("_place") < each).select(F.lit(0).alias("_g"), "_row", "_v")
    wide = wide or ["_g"]
    kinds["_g"] = "int"
    widths = held.groupBy(*wide).applyInArrow(median, f"{schema(wide)}, bandwidth double")
    x = x if wide != ["_g"] else x.withColumn("_g", F.lit(0))
    x = x.join(cut(widths), wide)

    last = F.expr(f"(_all - 1) div {block}")
    sent = x.withColumn("_own", F.expr(f"_place div {block}")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    sent = sent.select(*scope, "_v", "_first", "_place", "_all", "n_a", "bandwidth", "_own", F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q"))

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        own, v, place = table.column("_own").to_numpy(), _matrix(table.column("_v")), table.column("_place").to_numpy()
        first, total, n, h = table.column("_first").to_numpy(zero_copy_only=False).astype(bool), table.column("_all")[0].as_py(), table.column("n_a")[0].as_py(), table.column("bandwidth")[0].as_py()
        labels = np.stack([first, *[permuted(place, total, n, b, seed) for b in range(1, permutations + 1)]], 1).astype(np.float64)
        p, q = key[-2].as_py(), key[-1].as_py()
        i, j = np.flatnonzero(own == p), np.flatnonzero(own == q)
        out = np.zeros((3, permutations + 1))
        middle = v.mean(0)
        v = v - middle  # far from the origin products would lose the differences
        norm = (v**2).sum(1)
        for s in range(0, len(i), 512):
            part = i[s : s + 512]
            k = np.exp(-np.maximum(norm[part][:, None] + norm[j] - 2 * v[part] @ v[j].T, 0) / (2 * h))
            k[place[part][:, None] == place[j]] = 0
            f, g = labels[part], labels[j]
            with_first, with_all = k @ g, k.sum(1)
            aa = (f * with_first).sum(0)
            a_all = f.T @ with_all
            all_a = with_first.sum(0)
            out += [aa, with_all.sum() - a_all - all_a + aa, a_all + all_a - 2 * aa]
        out *= np.array([1.0, 1.0, 0.5])[:, None] if p == q else np.array([2.0, 2.0, 1.0])[:, None]
        names = [*scope, "_b", "_aa", "_bb", "_ab"]
        keys_ = [pa.array([k.as_py()] * (permutations + 1), k.type) for k in key[:-2]]
        return pa.Table.from_arrays([*keys_, pa.array(range(permutations + 1), pa.int32()), *[pa.array(o) for o in out]], names=names)

    blocks = F.expr(f"(_all + {block - 1}) div {block}")
    tasks = sizes.agg(F.sum(blocks * (blocks + 1) / 2)).first()[0] or 1  # so many that merging small partitions can't bring many pairs of blocks into one task
    sent = sent.repartition(int(max(1, min(tasks, 20_000))), *scope, "_p", "_q")
    parts = sent.groupBy(*scope, "_p", "_q").applyInArrow(sums, f"{schema(scope)}, _b int, _aa double, _bb double, _ab double")
    per = parts.groupBy(*scope, "_b").agg(*[F.sum(s).alias(s) for s in ("_aa", "_bb", "_ab")]).join(sizes, scope)
    na, nb = F.col("n_a"), F.col("n_b")
    per = per.withColumn("_m", F.col("_aa") / (na * (na - 1)) + F.col("_bb") / (nb * (nb - 1)) - 2 * F.col("_ab") / (na * nb))
    observed = per.where("_b = 0").select(*scope, F.col("_m").alias("mmd2"))
    null = per.where("_b > 0").join(observed, scope).groupBy(*scope).agg(F.first("mmd2").alias("mmd2"), ((F.count_if(F.col("_m") >= F.col("mmd2")) + 1) / (F.count("*") + 1)).alias("p"), ((F.first("mmd2") - F.avg("_m")) / (F.stddev_pop("_m") + 1e-12)).alias("z"))
    widths_of = x.select(*scope, "bandwidth").distinct()
    out = sizes.select(*scope, "n_a", "n_b").join(widths_of, scope, "left").join(null, scope, "left").withColumn("effect", F.col("mmd2") / F.col("bandwidth"))
    return benjamini_hochberg(cut(out), "p")
