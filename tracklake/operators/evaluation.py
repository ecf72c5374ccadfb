"""Evaluation of predictions, sampling plans and record grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.lineage import cut
from tracklake.operators.clusters import _matrix
from tracklake.operators.index import hashed_order


def image_agreement(rows: DataFrame, keys: list[str], predicted: str, truth: str) -> DataFrame:
    """Of each group: Pearson correlation, root mean square error over the truth's range, and peak signal-to-noise ratio."""
    p, t = F.col(predicted).cast("double"), F.col(truth).cast("double")
    a = rows.groupBy(*keys).agg(F.corr(p, t).alias("pcc"), F.avg((p - t) ** 2).alias("mse"), (F.max(t) - F.min(t)).alias("range"))
    return a.select(*keys, "pcc", (F.sqrt("mse") / F.nullif("range", F.lit(0.0))).alias("nrmse"), (10 * F.log10(F.col("range") ** 2 / F.nullif("mse", F.lit(0.0)))).alias("psnr"))


def classification_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Of each class: precision, recall, F1 and support; from the counts of (truth, predicted) pairs."""
    c = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    by_t = c.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    by_p = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("claimed"))
    j = by_t.join(by_p, "label", "full").na.fill(0, ["support", "hit", "claimed"])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    j = j.withColumns({"precision": ratio("hit", "claimed"), "recall": ratio("hit", "support")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.select("label", "precision", "recall", f1.alias("f1"), "support")


def branch_onsets(branches: DataFrame, onsets: DataFrame, node: str, onset: str) -> DataFrame:
    """Of each node the least onset over a root-to-leaf branch; where branches share a node the one with the greatest leaf counts. Nodes of branches without onset are left out."""
    b = branches.join(onsets.select(F.col(node).alias("node"), F.col(onset).alias("_o")), "node", "left")
    per = b.withColumn("_m", F.min("_o").over(Window.partitionBy("leaf"))).where("_m IS NOT NULL")
    return per.groupBy("node").agg(F.max_by("_m", "leaf").alias("t_perturb"))


def crop_windows(rows: DataFrame, keys: list[str], t: str, onset: Column, before: int, after: int) -> DataFrame:
    """Of each track with `before` frames ahead of its onset and `after` behind: onset, start and stop of the crop."""
    a = rows.groupBy(*keys).agg(F.min(F.when(onset, F.col(t))).alias("onset"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    a = a.where((F.col("onset") - before >= F.col("_lo")) & (F.col("onset") + after <= F.col("_hi")))
    return a.select(*keys, "onset", (F.col("onset") - before).alias("start"), (F.col("onset") + after).alias("stop"))


def positive_picks(rows: DataFrame, keys: list[str], t: str, row: str, match: str, low: int, high: int) -> DataFrame:
    """Of each anchor the row low..high frames later: the nearest with equal `match`, else the nearest; anchors without any are left out."""
    a = rows.select(*keys, F.col(row).alias("anchor"), F.col(match).alias("_m"), F.col(t).alias("_t"), F.explode(F.sequence(F.col(t) + low, F.col(t) + high)).alias(t))
    j = a.join(rows.select(*keys, t, F.col(row).alias("positive"), F.col(match).alias("_n")), [*keys, t])
    best = F.min_by("positive", F.struct((~F.col("_m").eqNullSafe(F.col("_n"))).cast("int"), F.col(t) - F.col("_t")))
    return j.groupBy("anchor").agg(best.alias("positive"))


def group_folds(rows: DataFrame, group: str, folds: int, seed: str) -> DataFrame:
    """Adds fold: whole groups, dealt out in hashed order. Ranks are over the groups, not the rows."""
    g = rows.select(group).distinct().withColumn("_r", F.row_number().over(Window.orderBy(hashed_order(seed, group), group)))
    return rows.join(g.select(group, (F.col("_r") % folds).alias("fold")), group)


def enriched_sample(rows: DataFrame, groups: list[str], time: str, key: str, focal: float, width: float, inside: int, outside: int, seed: str) -> DataFrame:
    """Of each group `inside` rows within `width` of the focal time and `outside` others, by hashed order; part says which."""
    part = F.when(F.abs(F.col(time) - focal) <= width, "focal").otherwise("other")
    r = rows.withColumn("part", part)
    w = Window.partitionBy(*groups, "part").orderBy(hashed_order(seed, key), key)
    r = r.withColumn("_n", F.row_number().over(w))
    return r.where((F.col("_n") <= inside) & (F.col("part") == "focal") | (F.col("_n") <= outside) & (F.col("part") == "other")).drop("_n")


def cycled(datasets: DataFrame, dataset: str, key: str) -> DataFrame:
    """Rows numbered within their dataset, the shorter ones repeated until they are as long as the longest: dataset, place, key."""
    r = datasets.select(dataset, key, (F.row_number().over(Window.partitionBy(dataset).orderBy(key)) - 1).alias("_i"))
    sizes = r.groupBy(dataset).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))
    s = r.join(sizes, dataset).crossJoin(F.broadcast(most))  # one row
    again = F.expr("sequence(0L, (_most - 1 - _i) div _n)")
    return s.where("_i < _most").select(dataset, F.explode(again).alias("_k"), "_i", "_n", key).select(dataset, (F.col("_k") * F.col("_n") + F.col("_i")).alias("place"), key)


def grouped_records(records: DataFrame, dataset: str, marker: str, well: str, first: list[str], order: str) -> DataFrame:
    """One row for each dataset, or for each marker of it where it has several: name, first given attributes, sorted wells, rows."""
    several = F.size(F.collect_set(marker).over(Window.partitionBy(dataset))) > 1
    r = records.withColumn("name", F.when(several & F.col(marker).isNotNull(), F.concat_ws("_", dataset, marker)).otherwise(F.col(dataset)))
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return r.groupBy("name").agg(*firsts, F.array_join(F.array_sort(F.collect_set(well)), ",").alias("wells"), F.count("*").alias("n"))


def retrieval_precision(queries: DataFrame, rows: DataFrame, row: str, label: str, vector: str, sample: int = 1024, group: int = 256, chunk: int = 16_384, share: int = 50_000) -> DataFrame:
    """Of each query the average precision of ranking all other rows by distance, equal labels being right.

    A stated set of queries meets all rows: groups of queries meet chunks of rows in tasks, which return, for each query and range of scores, the distinct scores with their counts as arrays. Ranges hold about
    `share` rows, by quantiles of the query's distances to a hashed sample, and are ranked one by one, after counts of the ranges before them; so no query's ranking lies in one task. Ids are distinct,
    vectors are of one length; those that are null or hold nulls are left out.
    """
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    of = lambda df, asks: df.where(fine).select(F.col(row).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_v"), F.lit(asks).alias("_asks"))
    r, q = of(rows, False), of(queries, True)
    kind, n, asked = dict(r.dtypes)["_id"], r.count(), q.count()
    parts, chunks, ranges = max(1, -(-asked // group)), max(1, -(-n // chunk)), max(1, -(-n // share))
    some = _matrix(r.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_v").toArrow().column(0))

    def scores(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of the columns of x; equal vectors get equal scores, and NaN comes first."""
        out = np.zeros(x.shape[1])
        for a, b in zip(x, v.tolist(), strict=True):
            out += (a - b) ** 2
        return np.where(np.isnan(out), np.inf, -out)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        asks, ids, v = table.column("_asks").to_numpy(zero_copy_only=False), table.column("_id").combine_chunks(), _matrix(table.column("_v"))
        same = ids.dictionary_encode().indices.to_numpy()
        kinds = table.column("_label").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        others, x, base = np.flatnonzero(~asks), np.ascontiguousarray(v[~asks].T), np.ascontiguousarray(some.T)
        of, places, values, n_, p_ = [], [], [], [], []
        for i in np.flatnonzero(asks).tolist():
            keep = same[others] != same[i]
            s, right = scores(x, v[i])[keep], ((kinds[others] == kinds[i]) & (kinds[i] >= 0))[keep]
            distinct, at = np.unique(s, return_inverse=True)
            total, hits = np.bincount(at, minlength=len(distinct)), np.bincount(at, right, minlength=len(distinct)).astype(np.int64)
            edges = np.sort(scores(base, v[i]))[[len(some) * k // ranges for k in range(1, ranges)]] if ranges > 1 else np.zeros(0)
            cuts = [0, *np.searchsorted(distinct, edges).tolist(), len(distinct)]
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if lo < hi:
                    of.append(i)
                    places.append(k)
                    values.append(distinct[lo:hi])
                    n_.append(total[lo:hi])
                    p_.append(hits[lo:hi])
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(a) for a in x])), pa.int32()), pa.array(np.concatenate(x) if x else [], t))
        return pa.Table.from_arrays([ids.take(pa.array(of, pa.int64())), pa.array(places, pa.int32()), lists(values, pa.float64()), lists(n_, pa.int64()), lists(p_, pa.int64())], names=["_id", "_range", "_s", "_n", "_p"])

    to = lambda n, seed: F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = r.select("*", every(parts).alias("_part"), to(chunks, 1).alias("_chunk")).unionByName(q.select("*", to(parts, 2).alias("_part"), every(chunks).alias("_chunk")))
    found = sent.repartition(min(parts * chunks, 20_000), "_part", "_chunk").groupBy("_part", "_chunk").applyInArrow(meet, f"_id {kind}, _range int, _s array<double>, _n array<long>, _p array<long>")
    add = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b))
    before = Window.partitionBy("_id").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    if ranges > 1:
        counted = cut(found.groupBy("_id", "_range").agg(add("_n").alias("n"), add("_p").alias("p")))
        counted = counted.select("_id", "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in ("n", "p")])
        found = found.join(counted.hint("merge"), ["_id", "_range"])
    else:
        found = found.select("*", F.lit(0).cast("long").alias("_before_n"), F.lit(0).cast("long").alias("_before_p"))

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        s, n_, p_ = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("_s", "_n", "_p"))
        distinct, at = np.unique(-s, return_inverse=True)
        n_, p_ = (np.bincount(at, c, minlength=len(distinct)) for c in (n_, p_))
        upto, hits = table.column("_before_n")[0].as_py() + np.cumsum(n_), table.column("_before_p")[0].as_py() + np.cumsum(p_)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], key[0].type), pa.array([int(p_.sum())]), pa.array([float((p_ * hits / upto).sum())])], names=["_id", "p", "s"])

    ranked = found.groupBy("_id", "_range").applyInArrow(rank, f"_id {kind}, p long, s double")
    return ranked.groupBy(F.col("_id").alias(row)).agg((F.sum("s") / F.nullif(F.sum("p"), F.lit(0))).alias("ap"))
