"""Scores of features and clusters: moments of vectors, pruning, ranks, distances of groups, agreement of clusterings, templates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.lineage import if_few
from tracklake.operators.aggregates import medians, roc_auc
from tracklake.operators.vectors import mean_vectors


def moments(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """For each group and pair of components i <= j: n, the sums of both and of their products.

    Rows without a vector or with components that aren't finite are left out; all others have one length. A task adds up its
    own rows and returns d * (d + 1) / 2 sums a group when it ends, so no more than that is held and shuffled.
    """
    kind = rows.schema[group].dataType
    finite = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < math.inf)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}  # of each group: n, sums, products
        type_of = None
        for batch in batches:
            if not batch.num_rows:
                continue
            type_of = batch.schema.field(0).type
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            of, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            for c in np.unique(of):
                m = x[of == c]
                n, s, q = sums.get(names[c], (0, 0.0, 0.0))
                sums[names[c]] = (n + len(m), s + m.sum(0), q + m.T @ m)
        for name, (n, s, q) in sums.items():
            i, j = np.triu_indices(len(s))
            columns = [pa.array([name] * len(i), type_of), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([n] * len(i), pa.int64()), pa.array(s[i]), pa.array(s[j]), pa.array(q[i, j])]
            yield pa.RecordBatch.from_arrays(columns, ["g", "i", "j", "n", "si", "sj", "sij"])

    schema = f"g {kind.simpleString()}, i int, j int, n long, si double, sj double, sij double"
    parts = finite.select(group, F.col(vector).cast("array<double>")).mapInArrow(add, schema)
    return parts.groupBy("g", "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "si", "sj", "sij"))).withColumnRenamed("g", group)


def comoments(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """For each group and pair of components i <= j: n, the means mi and mj of both, and cij, the sum of the products of their deviations.

    A first pass takes each group's means (one row a group), a second adds up products of what is left of the vectors, so a common offset, however
    large, costs no digits. Rows are left out as in `moments`.
    """
    finite = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < math.inf))).select(F.col(group).alias("_g"), F.col(vector).cast("array<double>").alias("_v"))
    # a null group is a group as well, so means are joined null safe
    centres = mean_vectors(finite, ["_g"], "_v", "_m").withColumnRenamed("_g", "_k")
    few = if_few(centres)
    less = finite.join(few, F.col("_g").eqNullSafe(F.col("_k"))).select(F.col("_g").alias(group), F.zip_with("_v", "_m", lambda v, m: v - m).alias("_v"))
    s = moments(less, group, "_v")
    mean = lambda k: F.element_at("_m", F.col(k) + 1) + F.col(f"s{k}") / F.col("n")
    s = s.join(few, F.col(group).eqNullSafe(F.col("_k")))
    return s.select(group, "i", "j", "n", mean("i").alias("mi"), mean("j").alias("mj"), (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")).alias("cij"))


def correlations(sums: DataFrame, group: str) -> DataFrame:
    """Pearson's r of each pair of different components, from comoments; 0 where one of them is constant."""
    own = sums.where("i = j").select(group, F.col("i").alias("_c"), F.col("cij").alias("_v"))
    a, b = own.withColumnsRenamed({group: "_ga", "_c": "_ca", "_v": "va"}), own.withColumnsRenamed({group: "_gb", "_c": "_cb", "_v": "vb"})
    pairs = sums.where("i < j").join(a, (F.col(group).eqNullSafe(F.col("_ga"))) & (F.col("i") == F.col("_ca"))).join(b, (F.col(group).eqNullSafe(F.col("_gb"))) & (F.col("j") == F.col("_cb")))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cij") / F.sqrt(F.col("va") * F.col("vb"))))
    return pairs.select(group, "i", "j", F.when((F.col("va") > 1e-12) & (F.col("vb") > 1e-12), r).otherwise(0.0).alias("r"))


def uncorrelated(rows: DataFrame, group: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """For each group and component, kept: from the strongest pair over the threshold down, the component goes that has the larger sum of |r| to those still there; the later one on a tie.
    A lone component stays."""
    sums = comoments(rows, group, vector)
    kind = rows.schema[group].dataType.simpleString()

    def prune(p: pd.DataFrame) -> pd.DataFrame:
        c = _square(p, "cij")
        d, v = len(c), np.diag(c)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.where((v[:, None] > 1e-12) & (v > 1e-12), np.abs(c / np.sqrt(v[:, None] * v)), 0.0)
        np.fill_diagonal(r, 0)
        kept = np.ones(d, bool)
        i, j = np.triu_indices(d, 1)
        order = np.lexsort((j, i, -r[i, j]))
        for i, j in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if r[i, j] <= threshold:
                break
            if kept[i] and kept[j]:
                a, b = r[i, kept].sum(), r[j, kept].sum()
                kept[j if abs(a - b) <= 1e-8 + 1e-5 * abs(b) or b > a else i] = False
        return pd.DataFrame({group: [p[group].iloc[0]] * d, "component": np.arange(d), "kept": kept})

    return sums.groupBy(group).applyInPandas(prune, f"{group} {kind}, component int, kept boolean")  # d * (d + 1) / 2 rows a group


def _square(p: pd.DataFrame, value: str = "sij") -> np.ndarray:
    d = int(p["j"].max()) + 1
    m = np.zeros((d, d))
    m[p["i"], p["j"]] = m[p["j"], p["i"]] = p[value]
    return m


def effective_rank(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """exp of the entropy of the normalised singular values of each group's matrix, from its products; null for fewer than two rows."""
    kind = rows.schema[group].dataType.simpleString()

    def rank(p: pd.DataFrame) -> pd.DataFrame:
        n = int(p["n"].iloc[0])
        own = np.linalg.eigvalsh(_square(p))
        s = np.sqrt(own[own > own.max() * 1e-13])  # what rounding leaves of 0
        q = s / s.sum() if s.size and n > 1 else None
        return pd.DataFrame({group: [p[group].iloc[0]], "n": [n], "effective_rank": [None if q is None else float(np.exp(-(q * np.log(q)).sum()))]})

    return moments(rows, group, vector).groupBy(group).applyInPandas(rank, f"{group} {kind}, n long, effective_rank double")


def frechet_distance(rows: DataFrame, group: str, a: str | int, b: str | int, vector: str) -> DataFrame:
    """One row: Frechet distance of the normal distributions of two groups; null if one has fewer than two rows."""
    sums = comoments(rows.where(F.col(group).isin(a, b)), group, vector).withColumn("_one", F.lit(1))

    def distance(p: pd.DataFrame) -> pd.DataFrame:
        mean, cov = [], []
        for g in (a, b):
            q = p[p[group] == g]
            if q.empty or q["n"].iloc[0] < 2:
                return pd.DataFrame({"distance": pd.Series([None], dtype="float64")})
            n, own = int(q["n"].iloc[0]), q[q["i"] == q["j"]].sort_values("i")
            mean.append(own["mi"].to_numpy())
            cov.append(_square(q, "cij") / (n - 1))
        root = np.sqrt(np.maximum(np.linalg.eigvals(cov[0] @ cov[1]).real, 0)).sum()
        return pd.DataFrame({"distance": [float(((mean[0] - mean[1]) ** 2).sum() + np.trace(cov[0]) + np.trace(cov[1]) - 2 * root)]})

    return sums.groupBy("_one").applyInPandas(distance, "distance double")  # d * (d + 1) rows


def zscored_sides(values: DataFrame, keys: list[str], component: str, predicted: str, truth: str) -> DataFrame:
    """Long rows without the components whose truth is 0 in all rows of the key, each side scaled by its own mean and deviation."""
    by = [*keys, component]
    s = values.groupBy(*by).agg(F.max(F.abs(truth)).alias("_most"), *(f(c).alias(n + c) for c in (predicted, truth) for f, n in ((F.avg, "_m_"), (F.stddev_pop, "_s_"))))
    z = {c: (F.col(c) - F.col("_m_" + c)) / (F.col("_s_" + c) + 1e-8) for c in (predicted, truth)}
    return values.join(if_few(s.where("_most > 0")), by).withColumns(z).drop("_most", *(n + c for c in (predicted, truth) for n in ("_m_", "_s_")))


def clustering_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: normalised mutual information (arithmetic mean) and adjusted Rand index of two labellings, from their contingency."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("c"))
    x = F.col("c")

    def side(keys: list[str]) -> DataFrame:
        g = cells.groupBy(*keys).agg(F.sum("c").alias("c"))
        return g.agg(F.sum(x).alias("n"), F.sum(x * F.ln(x)).alias("h"), F.sum(x * (x - 1) / 2).alias("p"))

    n, sums = F.col("n"), side([a, b])
    for name, of in (("a", a), ("b", b)):
        sums = sums.crossJoin(side([of]).select(F.col("h").alias(f"h{name}"), F.col("p").alias(f"p{name}")))  # one row each
    ha, hb = F.ln(n) - F.col("ha") / n, F.ln(n) - F.col("hb") / n
    mutual = F.ln(n) + (F.col("h") - F.col("ha") - F.col("hb")) / n
    chance, most = F.col("pa") * F.col("pb") / (n * (n - 1) / 2), (F.col("pa") + F.col("pb")) / 2
    return sums.select(n.cast("long").alias("n"), F.when(ha + hb > 0, 2 * mutual / (ha + hb)).otherwise(1.0).alias("nmi"), F.when(most != chance, (F.col("p") - chance) / (most - chance)).otherwise(1.0).alias("ari"))


def indistinguishability(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """1 where a score tells nothing of the class, 0 where it tells all."""
    return roc_auc(rows, keys, score, positive).select(*keys, (1 - 2 * F.abs(F.col("auc") - 0.5)).alias("indistinguishability"))


def score_summary(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean of the scores that are there, and how many."""
    return rows.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n_scores"))


def finite_reduced(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, and number, of the finite values of each key; null without one. Keys without finite values stay."""
    x = F.when(F.abs(value) < math.inf, F.col(value))
    return rows.groupBy(*keys).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))


def dense_windows(rows: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """The windows with at least that share of values other than 0."""
    share = F.avg((F.coalesce(F.col(value), F.lit(0)) != 0).cast("int"))
    return rows.groupBy(*keys).agg(share.alias("share")).where(F.col("share") >= least)


def onset_comparison(rows: DataFrame, group: str, track: list[str], value: str, threshold: str, time: str, warped: str, fraction: float = 0.25) -> DataFrame:
    """For each group, the median over tracks of the first time above the threshold on both clocks, and whether they diverge by more than a fraction."""
    first = [F.min(F.when(F.col(value) > F.col(threshold), F.col(c))).alias(n) for n, c in (("_u", time), ("_w", warped))]
    m = rows.groupBy(group, *track).agg(*first).groupBy(group).agg(F.count("_u").alias("n_unwarped"), F.count("_w").alias("n_warped"), F.median("_u").alias("median_unwarped"), F.median("_w").alias("median_warped"))
    m = m.withColumn("difference", F.abs(F.col("median_warped") - F.col("median_unwarped")))
    base = F.abs("median_unwarped")
    return m.withColumn("diverges", F.coalesce((base > 0) & (F.col("difference") > fraction * base), F.lit(False)))


def with_cohorts(rows: DataFrame, cohorts: DataFrame, keys: list[str], t: str, zero: str, interval: float) -> DataFrame:
    """Rows with their track's cohort columns (null without one) and the minutes since its zero frame. Cohorts have one row a track."""
    return rows.join(cohorts, keys, "left").withColumn("minutes", (F.col(t) - F.col(zero)) * interval)


def routed_predictions(rows: DataFrame, models: DataFrame, route: str, features: list[str], weights: list[str], bias: str, out: str = "prediction") -> DataFrame:
    """Each row scored by the linear model of its route; null where none is."""
    score = sum((F.col(w) * F.col(f) for w, f in zip(weights, features, strict=True)), F.col(bias))
    return rows.join(if_few(models.select(route, bias, *weights)), route, "left").withColumn(out, score).drop(bias, *weights)


def routed_classes(rows: DataFrame, models: DataFrame, task: str, route: str, label: str, weights: str, bias: str, features: list[str]) -> DataFrame:
    """Each row classified for each task by the linear model of the task and the row's route: a row for each row and task.

    models has a row for each task, route and class: weights, an array in the order of features, and a bias. Added are task, prediction
    (the class of the greatest score, the first by name among equals), classes (by name) and probabilities (softmax of their scores).
    All of these but task and classes are null where the task has no model for the route, where the route is null, and where a feature is null.
    The models of a task must have the same classes, else an error is raised. No models give no rows. Names of added columns replace the rows' own.
    """
    new = [task, "prediction", "classes", "probabilities"]
    each = models.groupBy(task, route).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(weights).alias("weights"), F.col(bias).cast("double").alias("bias")))).alias("model"))
    each = each.withColumn("classes", F.transform("model", lambda m: m["label"]))
    # few: a row for each task and a row for each route
    tasks = each.groupBy(task).agg(F.min("classes").alias("classes"), F.max("classes").alias("_most"))
    tasks = tasks.withColumn("classes", F.when(F.col("classes") == F.col("_most"), F.col("classes")).otherwise(F.raise_error(F.concat(F.lit("classes differ between the models of "), F.col(task).cast("string")))))
    tasks = tasks.agg(F.array_sort(F.collect_list(F.struct(F.col(task).alias("task"), "classes"))).alias("_tasks"))
    routes = each.where(F.col(route).isNotNull()).groupBy(F.col(route).alias("_route")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(task), "model"))).alias("_models"))
    own = rows.select(F.struct(*rows.columns).alias("_row"), F.col(route).alias("_route"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    r = own.join(if_few(routes), "_route", "left").crossJoin(F.broadcast(tasks))  # one row
    r = r.select("_row", "_x", "_models", F.explode("_tasks").alias("_task"))
    known = F.when(F.forall("_x", lambda x: x.isNotNull()), F.get(F.map_values(F.map_filter("_models", lambda t, m: t == F.col("_task.task"))), F.lit(0)))
    r = r.withColumn("_scores", F.transform(known, lambda m: m["bias"] + F.aggregate(F.zip_with(m["weights"], "_x", lambda w, x: w.cast("double") * x), F.lit(0.0), lambda s, x: s + x)))
    r = r.withColumn("_powers", F.transform("_scores", lambda x: F.exp(x - F.array_max("_scores"))))
    r = r.withColumn("_sum", F.aggregate("_powers", F.lit(0.0), lambda s, x: s + x))
    prediction = F.get("_task.classes", (F.array_position("_scores", F.array_max("_scores")) - 1).cast("int"))
    return r.select(*[F.col("_row").getField(c).alias(c) for c in rows.columns if c not in new], F.col("_task.task").alias(task), prediction.alias("prediction"), F.col("_task.classes").alias("classes"), F.transform("_powers", lambda x: x / F.col("_sum")).alias("probabilities"))


def first_positions(rows: DataFrame, position: str, most: int) -> DataFrame:
    """The rows of the first positions by name; the number is the feature."""
    return rows.join(F.broadcast(rows.select(position).where(F.col(position).isNotNull()).distinct().orderBy(position).limit(most)), position, "left_semi")


def alignment_queries(rows: DataFrame, keys: list[str], keep: Column, interval: float, least_minutes: float | None, least_frames: int, template: int, pre: float, post: float) -> DataFrame:
    """The kept rows of tracks with enough of them: for the least time, the least frames, and the template with head-room on both sides."""
    by_time = math.ceil(least_minutes / interval) if least_minutes is not None else least_frames
    least = max(by_time, least_frames, template + math.ceil((pre + post) / interval))
    kept = rows.where(keep)
    return kept.join(kept.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n"), keys, "left_semi")


def resampled_template(rows: DataFrame, key: str, time: str, vector: str, interval: float) -> DataFrame:
    """Each template at even times about an interval apart, from its first time to its last: key, step, time, and the vector between its neighbours, of length 1.

    Templates with fewer than two times, or shorter than half an interval, have no rows. Times of a template differ.
    """
    w = Window.partitionBy(key).orderBy(time)
    span = rows.groupBy(key).agg(F.min(time).alias("_a"), F.max(time).alias("_b")).withColumn("_n", F.round((F.col("_b") - F.col("_a")) / interval).cast("int")).where("_n >= 1")
    s = rows.select(key, F.col(time).alias("_t"), F.col(vector).alias("_v"), F.lead(time).over(w).alias("_t2"), F.lead(vector).over(w).alias("_v2")).where("_t2 IS NOT NULL").join(span, key)
    every = (F.col("_b") - F.col("_a")) / F.col("_n")
    # the steps that may lie between both neighbours, then those that do
    near = F.sequence(F.floor((F.col("_t") - F.col("_a")) / every).cast("int"), F.least("_n", F.ceil((F.col("_t2") - F.col("_a")) / every).cast("int")))
    s = s.withColumn("step", F.explode(near)).withColumn("time", F.when(F.col("step") == F.col("_n"), F.col("_b")).otherwise(F.col("_a") + F.col("step") * every))
    s = s.where((F.col("time") >= F.col("_t")) & ((F.col("time") < F.col("_t2")) | (F.col("time") == F.col("_b")) & (F.col("_t2") == F.col("_b"))))
    s = s.withColumn("_f", (F.col("time") - F.col("_t")) / (F.col("_t2") - F.col("_t")))
    s = s.withColumn("_x", F.zip_with("_v", "_v2", lambda p, q: p + (q - p) * F.col("_f")))
    size = F.greatest(F.sqrt(F.aggregate("_x", F.lit(0.0), lambda u, x: u + x * x)), F.lit(1e-12))
    return s.withColumn("_l", size).select(key, "step", "time", F.transform("_x", lambda x: x / F.col("_l")).alias(vector))


def onset_spread(rows: DataFrame, group: str, track: list[str], value: str, threshold: str, clocks: dict[str, str]) -> DataFrame:
    """For each group and clock (name -> column): tracks with an onset, the median over them of the first time above the threshold, and the distance between its quartiles."""
    first = rows.groupBy(group, *track).agg(*[F.min(F.when(F.col(value) > F.col(threshold), F.col(c))).cast("double").alias(n) for n, c in clocks.items()])
    long = first.select(group, F.inline(F.array(*[F.struct(F.lit(n).alias("clock"), F.col(n).alias("onset")) for n in clocks])))
    q = F.percentile("onset", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy(group, "clock").agg(F.count("onset").alias("n"), q[1].alias("median"), (q[2] - q[0]).alias("spread"))


def finite_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, and number, of the finite values of each key; null without one. Keys without finite values stay."""
    x = rows.select(*keys, F.when(F.abs(value) < math.inf, F.col(value).cast("double")).alias("_x"))
    return x.groupBy(*keys).agg(F.count("_x").alias("n")).join(medians(x, keys, "_x"), keys, "left")


def metric_means(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Of each group: n and the mean of each metric over its given, finite values."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.when(F.abs(m) < math.inf, F.col(m))).alias(m) for m in metrics])
