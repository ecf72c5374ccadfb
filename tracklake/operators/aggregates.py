"""Aggregates: distributions, population curves, ranks, agreement and significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.lineage import cut, if_few, running

#: Of the standard normal distribution, for 95 %.
Z95 = 1.959963984540054


def stats(value: Column) -> list[Column]:
    """The bundle min, max, mean, population deviation, median, iqr, p1, p5, p95, p99 and two ranges."""
    p = F.percentile(value, F.array(*map(F.lit, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))))
    at = lambda i: F.element_at(p, i)
    return [
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), at(4).alias("median"), (at(5) - at(3)).alias("iqr"),
        at(1).alias("p1"), at(2).alias("p5"), at(6).alias("p95"), at(7).alias("p99"), (at(6) - at(2)).alias("p95_p5"), (at(7) - at(1)).alias("p99_p1"),
    ]


def level_stats(rows: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Mean, deviation and count over all, by a, by b and by both, in one pass."""
    g = rows.groupingSets([[], [F.col(a)], [F.col(b)], [F.col(a), F.col(b)]], F.col(a), F.col(b))
    return g.agg(F.grouping_id().alias("level"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def wilson(positive: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; null without observations."""
    p, n = positive / n, n.cast("double")
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)


def population_curve(rows: DataFrame, time: str, positive: Column, start: float, stop: float, width: float, least: int = 1) -> DataFrame:
    """Of each left-closed bin of the spine start..stop, empty ones too: n, n_positive, fraction and its Wilson interval, null below `least` rows."""
    spine = rows.sparkSession.range(round((stop - start) / width)).select(F.col("id").alias("bin"))
    b = F.floor((F.col(time) - start) / width)
    hit = rows.where((F.col(time) >= start) & (F.col(time) < stop)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.count(F.when(positive, 1)).alias("n_positive"))
    c = spine.join(hit, "bin", "left").na.fill(0, ["n", "n_positive"])
    low, high = wilson(F.col("n_positive"), F.nullif(F.col("n"), F.lit(0)))
    enough = F.col("n") >= least
    return c.select("bin", (start + F.col("bin") * width).alias("bin_start"), "n", "n_positive", F.when(enough, F.col("n_positive") / F.nullif(F.col("n"), F.lit(0))).alias("fraction"), F.when(enough, low).alias("ci_low"), F.when(enough, high).alias("ci_high"))


def continuous_curve(rows: DataFrame, time: str, value: str, start: float, stop: float, width: float) -> DataFrame:
    """Of each bin with rows: n, mean, median, population deviation and quartiles."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    b = F.floor((F.col(time) - start) / width).alias("bin")
    return rows.where((F.col(time) >= start) & (F.col(time) < stop)).groupBy(b).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.element_at(p, 2).alias("median"), F.stddev_pop(value).alias("std"), F.element_at(p, 1).alias("q25"), F.element_at(p, 3).alias("q75"))


def onset_and_peak(curve: DataFrame, keys: list[str], time: str, value: str, n: str, baseline: tuple[float, float], sigmas: float = 2.0, least: int = 1) -> DataFrame:
    """Of each curve: baseline mean, onset (first time >= 0 above mean + sigmas * sample deviation), first peak, amplitude, half-maximum time, area above the baseline by trapezoids."""
    w = Window.partitionBy(*keys)
    inside = (F.col(time) >= baseline[0]) & (F.col(time) < baseline[1]) & (F.col(n) >= least)
    c = curve.withColumns({"base": F.coalesce(F.avg(F.when(inside, F.col(value))).over(w), F.lit(0.0)), "sd": F.stddev_samp(F.when(inside, F.col(value))).over(w)})
    post = F.col(time) >= 0
    c = c.withColumn("top", F.max(F.when(post, F.col(value))).over(w))
    o = w.orderBy(time)
    c = c.withColumn("part", F.when(post & (F.lag(time).over(o) >= 0), (F.col(value) + F.lag(value).over(o) - 2 * F.col("base")) / 2 * (F.col(time) - F.lag(time).over(o))))
    return c.groupBy(*keys).agg(
        F.first("base").alias("baseline"), F.min(F.when(post & (F.col(n) >= least) & (F.col(value) > F.col("base") + sigmas * F.col("sd")), F.col(time))).alias("onset"),
        F.min(F.when(post & (F.col(value) == F.col("top")), F.col(time))).alias("peak_time"), (F.max("top") - F.first("base")).alias("amplitude"),
        F.min(F.when(post & (F.col(value) > F.col("base") + (F.col("top") - F.col("base")) / 2), F.col(time))).alias("t50"), F.sum("part").alias("auc"),
    )


def ranked(rows: DataFrame, keys: list[str], value: str, out: str, ties: str | None = None) -> DataFrame:
    """Rows with the rank of their value in the group, ties sharing their mean rank, and how many share it; rows with a null value or key are left out.

    Ranks come from counts of distinct values and running sums over ranges of them, so a group isn't sorted in one task.
    """
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_many"))
    g = running(g, keys, value, {"_upto": "_many"}).withColumn(out, F.col("_upto") - (F.col("_many") - 1) / 2.0)
    g = g.select(*keys, value, out, *([F.col("_many").alias(ties)] if ties else []))
    return rows.join(g, [*keys, value])


def roc_auc(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve of each group from average ranks; null where a class is missing. `positive` is a boolean column.

    Ranks come from counts of distinct scores and running sums over ranges of them, so a group isn't sorted in one task.
    """
    r = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    g = r.groupBy(*keys, score).agg(F.count(F.when(F.col(positive), 1)).alias("_p"), F.count("*").alias("_n"))
    g = running(g, keys, score, {"_upto": "_n"})
    rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0
    a = g.groupBy(*keys).agg(F.sum("_p").alias("n1"), F.sum(F.col("_n") - F.col("_p")).alias("n0"), F.sum(F.col("_p") * rank).alias("s"))
    return a.select(*keys, "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def average_precision(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Sum of precision times the gain in recall over distinct scores, from the highest."""
    g = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.when(F.col(positive), 1)).alias("p"), F.count("*").alias("n"))
    g = running(g, keys, score, {"tp": "p", "all": "n"}, descending=True)
    return g.groupBy(*keys).agg((F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.nullif(F.sum("p"), F.lit(0))).alias("ap"))


def agreement(rows: DataFrame, keys: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """Of each group: n, Pearson, Spearman, mean absolute error, shares within 1 and 2; null below `least` pairs."""
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = ranked(ranked(r, keys, a, "_ra"), keys, b, "_rb")
    gap = F.abs(F.col(a) - F.col(b))
    out = r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), F.avg(gap).alias("mae"), F.avg((gap <= 1).cast("double")).alias("within_1"), F.avg((gap <= 2).cast("double")).alias("within_2"))
    return out.select(*keys, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("pearson", "spearman", "mae", "within_1", "within_2")])


def medians(rows: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """The exact median of each group, the mean of both middle values where their number is even; nulls are left out.

    It is found among counts of distinct values by running sums over ranges, so a group may be of any size.
    """
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    g = running(g, keys, value, {"_upto": "_n"})
    total = g.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    g = g.join(if_few(total), keys) if keys else g.crossJoin(F.broadcast(total))  # one row
    return g.where("2 * _upto >= _all AND 2 * (_upto - _n) <= _all").groupBy(*keys).agg(F.avg(value).alias(out))


def benjamini_hochberg(rows: DataFrame, p: str, keys: list[str] | None = None, out: str = "q") -> DataFrame:
    """Adds q values within the groups of `keys`; a null p ranks as 1 and stays null.

    Equal p values have one q, that of their last rank, so distinct ones with counts are ranked, by running sums over ranges; the least
    value of later ranks is taken within a range first, then over ranges.
    """
    groups = keys or []
    r = rows.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    d = running(r.groupBy(*groups, "_p").agg(F.count("*").alias("_n")), groups, "_p", {"_rank": "_n"})
    total = d.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    d = d.join(total, groups) if groups else d.crossJoin(F.broadcast(total))  # one row
    d = d.withColumn("_v", F.col("_p") * F.col("_all") / F.col("_rank")).repartitionByRange(*groups, "_p").withColumn("_part", F.spark_partition_id())
    d = cut(d)
    after = Window.partitionBy(*groups).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    later = d.groupBy(*groups, "_part").agg(F.min("_v").alias("_least")).select(*groups, "_part", F.min("_least").over(after).alias("_later"))
    own = Window.partitionBy(*groups, "_part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)  # frames to the end are worked out anew for each row
    d = d.withColumn("_own", F.min("_v").over(own)).join(later, [*groups, "_part"]).select(*groups, "_p", F.least(F.lit(1.0), "_own", F.coalesce("_later", F.lit(1.0))).alias("_q"))
    return r.join(d, [*groups, "_p"]).withColumn(out, F.when(F.col(p).isNotNull(), F.col("_q"))).select(*rows.columns, out)


def fallback_threshold(control: DataFrame, value: str, fine: str, coarse: str, q: float = 0.95, least: int = 30) -> DataFrame:
    """Of each fine group: the percentile of its own control rows if there are `least`, else of its coarse group's, else of all."""
    def level(*by: str) -> DataFrame:
        tag = by[0] if by else "all"
        return control.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias(f"q_{tag}"), F.count(value).alias(f"n_{tag}"))

    g = control.select(fine, coarse).distinct().join(level(fine), fine).join(level(coarse), coarse).crossJoin(F.broadcast(level()))  # one row
    t = F.when(F.col(f"n_{fine}") >= least, F.col(f"q_{fine}")).when(F.col(f"n_{coarse}") >= least, F.col(f"q_{coarse}")).otherwise(F.col("q_all"))
    source = F.when(F.col(f"n_{fine}") >= least, F.lit("fine")).when(F.col(f"n_{coarse}") >= least, F.lit("coarse")).otherwise(F.lit("all"))
    return g.select(fine, coarse, t.alias("threshold"), source.alias("level"))


def otsu(rows: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """Otsu threshold of each group's histogram: the centre of the bin where the variance between the two sides is largest; a constant group gives its value."""
    w = Window.partitionBy(*keys)
    ends = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    h = rows.join(ends, keys).where("hi > lo").groupBy(*keys, "lo", "hi", b.alias("bin")).agg(F.count("*").alias("n"))
    h = h.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    o = w.orderBy("bin")
    h = h.withColumns({"c": F.sum("n").over(o), "m": F.sum(F.col("n") * F.col("centre")).over(o), "all": F.sum("n").over(w), "mean": F.sum(F.col("n") * F.col("centre")).over(w)})
    h = h.withColumn("between", (F.col("mean") * F.col("c") - F.col("m") * F.col("all")) ** 2 / (F.col("c") * (F.col("all") - F.col("c")) + 1e-10))
    best = h.withColumn("_r", F.row_number().over(w.orderBy(F.desc("between"), "bin"))).where("_r = 1").select(*keys, F.col("centre").alias("threshold"))
    return best.union(ends.where("hi = lo").select(*keys, F.col("lo").alias("threshold")))


def confusion(rows: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Of each group: tp, fp, fn, tn, precision, recall, accuracy, dice, iou; a zero denominator gives 0. Both columns are boolean."""
    t, p = F.col(truth), F.col(predicted)
    c = rows.groupBy(*keys).agg(*[F.count(F.when(k, 1)).alias(n) for n, k in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))])
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select(*keys, "tp", "fp", "fn", "tn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(2 * tp, 2 * tp + fp + fn).alias("dice"), safe(tp, tp + fp + fn).alias("iou"))


def overlap_iou(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Of each pair of labels that meet: intersection and IoU of their row sets; 0 is background."""
    both = rows.where((F.col(a) > 0) & (F.col(b) > 0)).groupBy(a, b).agg(F.count("*").alias("common"))
    in_a, in_b = rows.where(F.col(a) > 0).groupBy(a).agg(F.count("*").alias("n_a")), rows.where(F.col(b) > 0).groupBy(b).agg(F.count("*").alias("n_b"))
    return both.join(in_a, a).join(in_b, b).select(a, b, "common", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("iou"))


def impact(scores: DataFrame, case: str, fold: str, score: str, baseline: str) -> DataFrame:
    """Of each case: mean paired change against the baseline case over shared folds, its standard error, and helps, hurts or uncertain (a score that rises without a case says the case hurts)."""
    base = scores.where(F.col(case) == baseline).select(fold, F.col(score).alias("_base"))
    d = scores.where(F.col(case) != baseline).join(base, fold).groupBy(case).agg(F.avg(F.col(score) - F.col("_base")).alias("delta"), (F.stddev_samp(F.col(score) - F.col("_base")) / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("folds"))
    kind = F.when((F.col("folds") < 2) | F.col("sem").isNull() | (F.col("sem") == 0), "uncertain").when(F.col("delta") > F.col("sem"), "hurts").when(F.col("delta") < -F.col("sem"), "helps").otherwise("uncertain")
    return d.withColumn("impact", kind)
