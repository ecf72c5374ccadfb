"""How well the objects of two label images agree. Pixels are counted where they are; what is matched in a group are the objects of one image."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLDS = tuple(i / 100 for i in range(50, 100, 5))


def least_cost_pairs(cost: np.ndarray) -> list[tuple[int, int]]:
    """One column for each row (or one row for each column, if there are fewer), so that the summed cost is least: shortest augmenting paths with potentials."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in least_cost_pairs(cost.T)]
    n, m = cost.shape
    u, v, row_of = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)  # column m stands for none
    for i in range(n):
        row_of[m], at = i, m
        least, before, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[at] >= 0:
            done[at] = True
            r = row_of[at]
            reduced = cost[r] - u[r] - v[:m]
            better = ~done[:m] & (reduced < least)
            least[better], before[better] = reduced[better], at
            nxt = int(np.argmin(np.where(done[:m], np.inf, least)))
            step = least[nxt]
            u[row_of[done]] += step
            v[done] -= step
            least[~done[:m]] -= step
            at = nxt
        while at != m:
            row_of[at] = row_of[before[at]]
            at = before[at]
    return sorted((int(row_of[j]), j) for j in range(m) if row_of[j] >= 0)


def matched(iou: np.ndarray, threshold: float) -> int:
    """How many pairs of at least the threshold can be made at most, each object in one; of these pairings one with the largest IoU."""
    if not iou.size:
        return 0
    pairs = least_cost_pairs(-(iou >= threshold).astype(float) - iou / (2 * min(iou.shape)))
    return sum(bool(iou[p] >= threshold) for p in pairs)


def detection_precision(iou: np.ndarray, threshold: float) -> tuple[float, float]:
    """Average precision at 101 recalls, and recall, with detections (columns) of equal confidence that take the best true object (row) left, in order."""
    n, m = iou.shape
    free, hits = np.ones(n, bool), np.zeros(m, bool)
    for j in range(m):
        fit = np.flatnonzero(free & (iou[:, j] >= threshold))
        if len(fit):
            free[fit[::-1][np.argmax(iou[fit[::-1], j])]] = False  # of ties the last
            hits[j] = True
    found = np.cumsum(hits)
    recall, precision = found / n, found / np.arange(1, m + 1)
    ceiling = np.maximum.accumulate(precision[::-1])[::-1]
    at = np.searchsorted(recall, np.linspace(0, 1, 101), side="left")
    return float(np.append(ceiling, 0.0)[np.minimum(at, m)].mean()), float(found[-1] / n) if m else 0.0


def _per_image(rows: DataFrame, image: list[str], score, columns: list[str], out: str) -> DataFrame:
    """score: from columns of one image's rows to a dict of values."""
    kinds = dict(rows.dtypes)
    names = [c.split()[0] for c in out.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def one(key: tuple, table: pa.Table) -> pa.Table:
        found = score(*[np.array(table.column(c).to_pylist(), float) for c in columns])
        values = [pa.array([found[c.split()[0]]], types[c.split()[1]]) for c in out.split(", ")]
        return pa.Table.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], *values], names=[*image, *names])

    return rows.groupBy(*image).applyInArrow(one, ", ".join([*[f"{k} {kinds[k]}" for k in image], out]))


def instance_scores(pixels: DataFrame, image: list[str], truth: str, found: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Of each image: n_truth, n_found, and with its objects matched one to one by IoU, precision (tp / (tp + fp + fn)) at each threshold, their mean, and tp, fp, fn at the
    first; dice (the mean, over the objects of both sides, of 2 i / (1 + i) with the best IoU i); and coco_map, coco_recall, as detections of equal
    confidence are scored at those thresholds.

    Label 0 (or null) is background; labels need not be dense, and the pieces of a label are one object. Without objects on either side the scores
    are null, with objects on one side only they are 0 and fp, fn count them. An image's pairs of touching objects are what a task holds of it.
    """
    label = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counts = pixels.select(*image, label(truth), label(found)).groupBy(*image, truth, found).agg(F.count("*").alias("n"))

    def score(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> dict:
        of_a, of_b = np.unique(a[a != 0]), np.unique(b[b != 0])
        area_a, area_b = (np.array([n[x == k].sum() for k in of]) for x, of in ((a, of_a), (b, of_b)))
        iou = np.zeros((len(of_a), len(of_b)))
        for x, y, c in zip(a, b, n, strict=True):
            if x and y:
                i, j = np.searchsorted(of_a, x), np.searchsorted(of_b, y)
                iou[i, j] = c / (area_a[i] + area_b[j] - c)
        out = {"n_truth": len(of_a), "n_found": len(of_b)}
        if not len(of_a) and not len(of_b):
            return out | dict.fromkeys(("precision", "mean_precision", "tp", "fp", "fn", "dice", "coco_map", "coco_recall"))
        tp = [matched(iou, t) for t in thresholds]
        ap = [k / (len(of_a) + len(of_b) - k) for k in tp]
        best = np.concatenate([iou.max(1, initial=0), iou.max(0, initial=0)])
        coco = [detection_precision(iou, t) for t in thresholds] if len(of_a) else [(None, None)]
        mean = lambda k: float(np.mean([c[k] for c in coco])) if len(of_a) else None
        return out | {"precision": ap, "mean_precision": float(np.mean(ap)), "tp": tp[0], "fp": len(of_b) - tp[0], "fn": len(of_a) - tp[0], "dice": float(np.mean(2 * best / (1 + best))), "coco_map": mean(0), "coco_recall": mean(1)}

    return _per_image(counts, image, score, [truth, found, "n"], "n_truth long, n_found long, precision array<double>, mean_precision double, tp long, fp long, fn long, dice double, coco_map double, coco_recall double")


def detected_by_centre(pixels: DataFrame, image: list[str], y: str, x: str, truth: str, found: str) -> DataFrame:
    """Of each image: objects matched one to one by least summed distance of their centres, of which those count (tp) that are no farther apart than half the mean
    major axis of the true objects; fp, fn, precision, recall and f1 (0 where a divisor is). The major axis is four times the root of the greater
    eigenvalue of an object's covariance. Where one side has fewer objects, the others may stay alone at no cost."""

    def objects(label: str, side: float) -> DataFrame:
        of = pixels.where(F.col(label) > 0).groupBy(*image, label)
        o = of.agg(F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.var_pop(y).alias("vy"), F.var_pop(x).alias("vx"), F.covar_pop(y, x).alias("c"))
        mean, root = (F.col("vy") + F.col("vx")) / 2, F.sqrt(((F.col("vy") - F.col("vx")) / 2) ** 2 + F.col("c") ** 2)
        return o.select(*image, F.lit(side).alias("side"), F.col(label).cast("double").alias("label"), "cy", "cx", (4 * F.sqrt(mean + root)).alias("axis"))

    rows = objects(truth, 0.0).unionByName(objects(found, 1.0))

    def score(side: np.ndarray, label: np.ndarray, cy: np.ndarray, cx: np.ndarray, axis: np.ndarray) -> dict:
        order = np.lexsort((label, side))
        side, centre, axis = side[order], np.stack([cy, cx], 1)[order], axis[order]
        a, b = centre[side == 0], centre[side == 1]
        n = max(len(a), len(b))
        cost = np.zeros((n, n))
        cost[: len(a), : len(b)] = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
        near = axis[side == 0].mean() / 2 if len(a) else 0.0
        tp = sum(bool(i < len(a) and j < len(b) and cost[i, j] <= near) for i, j in least_cost_pairs(cost))
        share = lambda p, q: p / q if q else 0.0
        precision, recall = share(tp, len(b)), share(tp, len(a))
        return {"tp": tp, "fp": len(b) - tp, "fn": len(a) - tp, "precision": precision, "recall": recall, "f1": share(2 * precision * recall, precision + recall)}

    return _per_image(rows, image, score, ["side", "label", "cy", "cx", "axis"], "tp long, fp long, fn long, precision double, recall double, f1 double")
