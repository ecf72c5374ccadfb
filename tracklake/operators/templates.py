"""Templates learnt from tracks by dynamic time warping, and tracks aligned with them.

A track is a small group: its frames in order, each with a vector. The distance of two tracks is the root of the summed squared distances of the frames
that a least path brings together. Tracks stay spread over the cluster; what comes to the driver is the template itself and the tracks that may start it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions.lineage import cut
from tracklake.operators.study import funnel


@dataclass(frozen=True)
class Template:
    """vectors: one for each place. fractions: of each label, its share of the labelled frames at each place. minutes: mean time at each place, gaps filled linearly."""

    vectors: np.ndarray
    tracks: int
    rounds: int = 0
    fractions: dict[str, list[float]] = field(default_factory=dict)
    minutes: list[float] | None = None


def cumulated(gaps: np.ndarray, skip_rows: int = 0, skip_columns: int = 0) -> np.ndarray:
    """Least sums of gaps over paths to each cell, with a border row and column; a path may start after up to so many rows or columns, at no cost.

    Cells of an anti-diagonal don't depend on each other, so each is one step over whole slices.
    """
    n, m = gaps.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[: skip_rows + 1, 0] = 0
    total[0, : skip_columns + 1] = 0
    flat = total.reshape(-1)
    by_diagonal = np.full((n + m - 1, n), np.nan)  # gaps[i, j] at [i + j, i]
    rows = np.arange(n)
    for j in range(m):
        by_diagonal[rows + j, rows] = gaps[:, j]
    for k in range(2, n + m + 1):  # the cells (i, k - i)
        lo, hi = max(1, k - m), min(n, k - 1)
        at = lambda first, stop: flat[first : stop + 1 : m]
        a, b = lo * m + k, hi * m + k
        best = np.minimum(np.minimum(at(a - m - 2, b - m - 2), at(a - m - 1, b - m - 1)), at(a - 1, b - 1))
        flat[a : b + 1 : m] = by_diagonal[k - 2, lo - 1 : hi] + best
    return total


def path_to(total: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """The least path that ends in the cell (i, j) of the sums, as places of both; of equal steps the diagonal one, then that along the rows."""
    path = []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        diagonal, up, left = total[i - 1, j - 1], total[i - 1, j], total[i, j - 1]
        if diagonal <= up and diagonal <= left:
            i, j = i - 1, j - 1
        elif up <= left:
            i -= 1
        else:
            j -= 1
    return path[::-1]


def squared_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)


def best_match(template: np.ndarray, track: np.ndarray, psi: int | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Cost and path, as (template place, frame), of the segment of the track that fits the whole template best; the cost is divided by the template's length.

    With psi both may lack up to psi places at either end, and all else is matched (psi = 0: from start to end); the cost isn't divided then.
    """
    n, m = len(template), len(track)
    gaps = squared_gaps(template, track)
    if psi is None:
        total = cumulated(gaps, 0, m)
        j = int(np.argmin(total[n, 1:])) + 1
        return float(np.sqrt(total[n, j]) / n), path_to(total, n, j)
    psi = min(psi, n - 1, m - 1)
    total = cumulated(gaps, psi, psi)
    ends = [(total[n, m - k], n, m - k) for k in range(psi + 1)] + [(total[n - k, m], n - k, m) for k in range(psi + 1)]
    least, i, j = min(ends, key=lambda e: e[0])
    return float(np.sqrt(least)), path_to(total, i, j)


def matches(template: np.ndarray, tracks: list[np.ndarray], subsequence: bool = False, paths: bool = True) -> Iterator[tuple[int, float, np.ndarray]]:
    """(number of the track, least sum of squared gaps, path) of many tracks at once, as `cumulated` and `path_to` find them: each cell of the table of sums is one step over
    tracks of like lengths. Tracks are aligned whole, or (subsequence) by the segment that fits the whole template best."""
    n, lengths = len(template), np.array([len(x) for x in tracks], np.int64)
    by, start = np.argsort(lengths, kind="stable"), 0
    while start < len(by):
        stop = start + 1
        while stop < len(by) and stop - start < 4096 and (stop - start + 1) * (n + 1) * (lengths[by[stop]] + 1) <= 2_000_000:
            stop += 1
        at = by[start:stop]
        start, size, m = stop, len(at), int(lengths[at].max())
        x = np.zeros((size, m, template.shape[1]))
        for k, i in enumerate(at.tolist()):
            x[k, : lengths[i]] = tracks[i]
        total = np.full((n + 1, m + 1, size), np.inf)
        total[0, : m + 1 if subsequence else 1] = 0
        for i in range(n):
            gaps = ((template[i] - x) ** 2).sum(2).T
            for j in range(m):
                total[i + 1, j + 1] = gaps[j] + np.minimum(np.minimum(total[i, j], total[i, j + 1]), total[i + 1, j])
        each = np.arange(size)
        b = lengths[at].copy()
        if subsequence:
            b = np.where(np.arange(1, m + 1)[:, None] <= b, total[n, 1:], np.inf).argmin(0) + 1
        cost, a, steps = total[n, b, each], np.full(size, n), []
        while paths and (going := (a > 0) & (b > 0)).any():
            steps.append(np.where(going, [a - 1, b - 1], -1))
            i, j = np.maximum(a, 1), np.maximum(b, 1)
            diagonal, up, left = total[i - 1, j - 1, each], total[i - 1, j, each], total[i, j - 1, each]
            both = (diagonal <= up) & (diagonal <= left)
            down = both | (up <= left)
            a, b = np.where(going & down, a - 1, a), np.where(going & (both | ~down), b - 1, b)
        trail = np.array(steps[::-1]).transpose(2, 0, 1) if steps else np.zeros((size, 0, 2), np.int64)
        for k, i in enumerate(at.tolist()):
            yield i, float(cost[k]), trail[k][trail[k, :, 0] >= 0]


def path_skew(path: list[tuple[int, int]], places: int, frames: int) -> float:
    """Mean distance of a path's steps from the straight line between its ends, over the longer of both lengths."""
    if len(path) < 2 or places < 2 or frames < 2:
        return 0.0
    p = np.array(path, np.float64)
    straight = np.linspace(p[0], p[-1], len(p))
    return float(np.abs(p - straight).sum(1).mean() / max(places, frames))


def _array(vectors: list) -> np.ndarray:
    return np.array(vectors, np.float64)


def _nested(column: pa.Array) -> list[np.ndarray]:
    """Tracks of a column of lists of vectors."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
    return np.split(v, np.cumsum(n)[:-1])


def _per_task(tracks: DataFrame, add: Callable[[pa.RecordBatch, Counter], None], columns: list[str], schema: str) -> DataFrame:
    """Sums over tracks: add(batch, sums) puts into sums under tuples of all columns but the last. A task returns its own sums, which are then added up."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            if batch.num_rows:
                add(batch, sums)
        if sums:
            rows = [(*k, v) for k, v in sums.items()]
            kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[s.split()[1]]) for c, s in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names=names)

    return tracks.select(*columns).mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum(names[-1]).alias(names[-1]))


def as_tracks(rows: DataFrame, keys: list[str], t: str, vector: str, label: str | None = None, minutes: str | None = None, least: int = 1) -> DataFrame:
    """A row for each track of at least `least` frames: keys, and its vectors, labels and minutes in the order of t. Frames without a vector, or with one
    that isn't finite throughout, are left out."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    frame = F.struct(F.col(t).alias("t"), v.alias("v"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"), (F.col(minutes).cast("double") if minutes else F.lit(None).cast("double")).alias("minutes"))
    per = rows.where(F.col(vector).isNotNull() & finite).groupBy(*keys).agg(F.array_sort(F.collect_list(frame)).alias("f"))
    return per.where(F.size("f") >= least).select(*keys, F.col("f.v").alias("vectors"), F.col("f.label").alias("labels"), F.col("f.minutes").alias("minutes"))


def learn_template(rows: DataFrame, keys: list[str], t: str, vector: str, label: str | None = None, minutes: str | None = None, candidates: int = 50, rounds: int = 30, tolerance: float = 1e-5, least: int = 1, unit: bool = False, seed: int = 42) -> Template:
    """The barycentre of tracks under dynamic time warping.

    It starts from the medoid: of at most `candidates` tracks, by a seeded hash of their keys, the one with the least summed distance to all tracks. In each
    round every track is aligned with the template from start to end, and the template's vectors become the means of the frames that
    meet them, until they move by less than `tolerance` on average, or for `rounds` rounds. unit: its vectors are then brought to length 1. Labels and minutes
    of the frames are averaged over the places that they meet in a last alignment.

    A round is one job: tasks return a sum for each place and component. The tracks are computed once and kept in the shared folder. Raises ValueError without any track.
    """
    tracks = cut(as_tracks(rows, keys, t, vector, label, minutes, least))
    first = [_array(r.vectors) for r in tracks.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(candidates).select("vectors").collect()]
    if not first:
        raise ValueError("no tracks to learn from")

    def distances(batch: pa.RecordBatch, sums: Counter) -> None:
        own = _nested(batch.column("vectors"))
        for i, c in enumerate(first):
            sums[i,] += float(sum(np.sqrt(d) for _, d, _ in matches(c, own, paths=False)))

    cost = {r.candidate: r.cost for r in _per_task(tracks, distances, ["vectors"], "candidate int, cost double").collect()}
    template = first[min(cost, key=lambda i: (cost[i], i))]

    done = 0
    while done < rounds:
        shape = template

        def means(batch: pa.RecordBatch, sums: Counter, shape: np.ndarray = shape) -> None:
            own, added = _nested(batch.column("vectors")), np.zeros((len(shape), shape.shape[1] + 1))
            for k, _, at in matches(shape, own):
                np.add.at(added, at[:, 0], np.hstack([own[k][at[:, 1]], np.ones((len(at), 1))]))
            for (p, i), x in np.ndenumerate(added):
                sums[p, i] += float(x)

        found = np.zeros((len(shape), shape.shape[1] + 1))
        for r in _per_task(tracks, means, ["vectors"], "place int, i int, v double").collect():
            found[r.place, r.i] = r.v
        template = found[:, :-1] / np.maximum(found[:, -1:], 1)
        done += 1
        if np.abs(template - shape).mean() < tolerance:
            break
    if unit:
        template = template / np.maximum(np.linalg.norm(template, axis=1, keepdims=True), 1e-12)
    n = tracks.count()
    if not (label or minutes):
        return Template(template, n, done)

    def met(batch: pa.RecordBatch, sums: Counter) -> None:
        labels, times = batch.column("labels").to_pylist(), batch.column("minutes").to_pylist()
        for k, _, path in matches(template, _nested(batch.column("vectors"))):
            for p, i in path.tolist():
                if labels[k][i]:
                    sums[p, "label", labels[k][i]] += 1.0
                if (x := times[k][i]) is not None and np.isfinite(x):
                    sums[p, "time", "sum"] += x
                    sums[p, "time", "n"] += 1.0

    counts = {(r.place, r.kind, r.name): r.v for r in _per_task(tracks, met, ["vectors", "labels", "minutes"], "place int, kind string, name string, v double").collect()}
    places = range(len(template))
    names = sorted({k[2] for k in counts if k[1] == "label"})
    total = [sum(counts.get((p, "label", name), 0.0) for name in names) or 1.0 for p in places]
    fractions = {name: [counts.get((p, "label", name), 0.0) / total[p] for p in places] for name in names}
    timed = [p for p in places if (p, "time", "n") in counts]
    times = np.interp(places, timed, [counts[p, "time", "sum"] / counts[p, "time", "n"] for p in timed]).tolist() if timed else None
    return Template(template, n, done, fractions, times)


def align_tracks(rows: DataFrame, keys: list[str], t: str, vector: str, template: Template, least: int = 3, subsequence: bool = True, psi: int | None = None) -> DataFrame:
    """Of every frame of a track with at least `least` frames: keys, t, pseudotime, region, speed, minutes, labels, and of its track cost, mean_cost and skew.

    subsequence: the segment of the track that fits the whole template best is found; frames before it are `pre` with pseudotime 0, those after it `post` with
    1. Without it both are aligned whole, but for up to psi places at each end (half of the template if psi is None); frames skipped so have pseudotime 0.
    pseudotime is the last place that a frame meets over the last place there is; speed its central difference; mean_cost the cost over the path's steps;
    labels the template's fractions there, minutes its time (pre and post: of its ends).

    Frames without a finite vector are left out. The template goes with the tasks; a track is the most that a task holds.
    """
    kinds = dict(rows.dtypes)
    shape, last = template.vectors, max(len(template.vectors) - 1, 1)
    names = sorted(template.fractions)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tracks = _nested(batch.column("v"))
            if subsequence:
                found = {k: (float(np.sqrt(cost) / len(shape)), path) for k, cost, path in matches(shape, tracks, True)}
            else:
                found = {k: (cost, np.array(path)) for k, (cost, path) in enumerate(best_match(shape, own, len(shape) // 2 if psi is None else psi) for own in tracks)}
            out: dict[str, list] = {c: [] for c in ("pseudotime", "region", "speed", "place", "cost", "mean_cost", "skew")}
            for k in range(len(tracks)):
                n, (cost, path) = len(tracks[k]), found[k]
                place = np.zeros(n, np.int64)
                np.maximum.at(place, path[:, 1], path[:, 0])  # places of a path never fall
                lo, hi = (int(path[0, 1]), int(path[-1, 1])) if subsequence else (0, n - 1)
                place[:lo], place[hi + 1 :] = 0, last
                out["region"] += ["pre"] * lo + ["aligned"] * (hi - lo + 1) + ["post"] * (n - hi - 1)
                for c, v in (("place", np.minimum(place, len(shape) - 1)), ("pseudotime", place / last), ("speed", np.gradient(place / last) if n > 1 else np.zeros(1)), ("cost", np.full(n, cost)), ("mean_cost", np.full(n, cost / len(path))), ("skew", np.full(n, path_skew(path, len(shape), n)))):
                    out[c].append(v)
            place = np.concatenate(out.pop("place"))
            of = pa.array(np.repeat(np.arange(len(tracks)), [len(x) for x in tracks]))
            minutes = pa.array(np.array(template.minutes, np.float64)[place]) if template.minutes else pa.nulls(len(place), pa.float64())
            labels = pa.array([[(name, template.fractions[name][p]) for name in names] for p in range(len(shape))], pa.map_(pa.string(), pa.float64())).take(pa.array(place))
            got = {c: pa.array(v) if c == "region" else pa.array(np.concatenate(v)) for c, v in out.items()}
            columns = [*[batch.column(k).take(of) for k in keys], batch.column("_t").flatten(), got["pseudotime"], got["region"], got["speed"], minutes, labels, got["cost"], got["mean_cost"], got["skew"]]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, t, "pseudotime", "region", "speed", "minutes", "labels", "cost", "mean_cost", "skew"])

    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{t} {kinds[t]}", "pseudotime double, region string, speed double, minutes double, labels map<string,double>, cost double, mean_cost double, skew double"])
    per = rows.where(F.col(vector).isNotNull() & finite).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), v.alias("v")))).alias("f"))
    return per.where(F.size("f") >= least).select(*keys, F.col("f.t").alias("_t"), F.col("f.v").alias("v")).mapInArrow(align, schema)


def event_band(template: Template, share: float = 0.5) -> tuple[float, float]:
    """Between which pseudotimes the template changes fastest: the first and the last step whose size is at least `share` of the largest; (0, 1) if it doesn't change."""
    steps = np.linalg.norm(np.diff(template.vectors, axis=0), axis=1)
    if not len(steps) or steps.max() <= 0:
        return 0.0, 1.0
    fast = np.flatnonzero(steps >= share * steps.max())
    return float(fast[0] + 0.5) / len(steps), float(fast[-1] + 0.5) / len(steps)


def gated(alignments: DataFrame, keys: list[str], t: str, places: int, interval: float, max_skew: float = 0.8, match_minutes: float | None = None, match_ratio: float = 0.5, before_minutes: float = 0.0, after_minutes: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Alignments of the tracks that pass all gates, and the log of them: (step, name, kept, dropped).

    The gates: a finite cost; skew up to max_skew; aligned frames for match_minutes (rounded up to frames, 2 at least), or else for match_ratio of
    the template's places; so many minutes of frames before and after the match. Kept frames get match_start, match_stop and match_minutes of their
    track; minutes outside of the match are null.
    """
    inside = F.col("region") == "aligned"
    per = alignments.groupBy(*keys).agg(
        F.first("mean_cost").alias("mean_cost"), F.first("skew").alias("skew"), F.count_if(inside).alias("n"), F.min(F.when(inside, F.col(t))).alias("match_start"), F.max(F.when(inside, F.col(t))).alias("match_stop"), F.min(t).alias("lo"), F.max(t).alias("hi")
    )
    frames = lambda minutes: int(np.ceil(minutes / interval))
    most = max(2, frames(match_minutes) if match_minutes else int(np.ceil(match_ratio * places)))
    steps = [
        ("finite_cost", F.col("mean_cost").isNotNull() & ~F.isnan("mean_cost") & (F.col("mean_cost") < float("inf"))),
        ("skew", F.col("skew") <= max_skew),
        ("match", F.col("n") >= most),
        ("headroom", (F.col("match_start") - F.col("lo") >= frames(before_minutes)) & (F.col("hi") - F.col("match_stop") >= frames(after_minutes))),
    ]
    passed = F.lit(True)
    for _, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
    kept = per.where(passed).select(*keys, "match_start", "match_stop", ((F.col("match_stop") - F.col("match_start")) * interval).alias("match_minutes"))
    return alignments.join(kept, keys).withColumn("minutes", F.when(inside, F.col("minutes"))), funnel(per, steps)


def on_real_tracks(alignments: DataFrame, keys: list[str], t: str, real: dict[str, str], real_t: str, interval: float) -> DataFrame:
    """Alignments of stitched lineages, whose rows have their own track and frame in other columns (`real`: key -> column, and real_t), as rows of these tracks.

    Matches are found anew for each real track; tracks without an aligned frame of their own are left out.
    """
    rows = alignments.drop("match_start", "match_stop", "match_minutes").withColumns({k: F.col(c) for k, c in real.items()} | {t: F.col(real_t)}).drop(*real.values(), real_t)
    per = rows.where("region = 'aligned'").groupBy(*keys).agg(F.min(t).alias("match_start"), F.max(t).alias("match_stop"))
    return rows.join(per.withColumn("match_minutes", (F.col("match_stop") - F.col("match_start")) * interval), keys)


def response_groups(alignments: DataFrame, keys: list[str], cost_percentile: float = 0.75, method: str = "quantile", quantile: float = 0.5) -> DataFrame:
    """Of each track: cost, mean absolute speed and response. Tracks whose cost is above the percentile are non_responder; the others early or late, by a quantile of
    their speeds, or (method kmeans) by the faster of two clusters of speeds. The thresholds are one row each; percentiles are over tracks."""
    per = cut(alignments.groupBy(*keys).agg(F.first("cost").alias("cost"), F.avg(F.abs("speed")).alias("speed")))
    limit = per.agg(F.percentile("cost", F.lit(cost_percentile)).alias("_limit"))
    per = per.crossJoin(F.broadcast(limit))  # one row
    responds = per.where("cost <= _limit")
    if method == "quantile":
        border = responds.agg(F.percentile("speed", F.lit(quantile)).alias("_border"))
    else:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        points = VectorAssembler(inputCols=["speed"], outputCol="_p").transform(responds.select("speed"))
        centres = [float(c[0]) for c in KMeans(k=2, seed=42, featuresCol="_p").fit(points).clusterCenters()] if responds.count() >= 2 else [float("-inf")]
        border = alignments.sparkSession.createDataFrame([(sum(centres) / len(centres),)], "_border double")  # nearer to the faster centre
    group = F.when(F.col("cost") > F.col("_limit"), "non_responder").when(F.col("speed") >= F.col("_border"), "early").otherwise("late")
    return per.crossJoin(F.broadcast(border)).select(*keys, "cost", "speed", group.alias("response"))
