"""Object scores of label images whose answers are known, and against all assignments."""

import itertools
import random

import numpy as np
import pytest

from tracklake.operators import instances
from tracklake.plans import instance_queries


def rows_of(image, truth, found):
    return [(image, y, x, int(truth[y, x]), int(found[y, x])) for y in range(truth.shape[0]) for x in range(truth.shape[1])]


def squares():
    a = np.zeros((16, 16), int)
    a[2:6, 2:6], a[10:14, 10:14] = 5, 9  # ids with gaps
    return a


def scores(spark, pairs, **kw):
    rows = [r for i, (a, b) in enumerate(pairs) for r in rows_of(i, a, b)]
    df = spark.createDataFrame(rows, "image int, y int, x int, a int, b int").repartition(3)
    return {r.image: r for r in instances.instance_scores(df, ["image"], "a", "b", **kw).collect()}, df


def test_known_cases(spark):
    gt, empty = squares(), np.zeros((16, 16), int)
    apart, one, shifted, half = empty.copy(), gt.copy(), empty.copy(), empty.copy()
    apart[2:6, 10:14] = 1
    one[10:14, 10:14] = 0
    half[2:6, 2:6], shifted[2:6, 4:8] = 1, 1
    split = empty.copy()
    split[2:5, 2:5] = split[2:5, 11:14] = 1
    got, _ = scores(spark, [(gt, gt), (gt, apart), (gt, empty), (empty, gt), (empty, empty), (gt, one), (one, gt), (half, shifted), (split, split)])
    assert (got[0].mean_precision, got[0].tp, got[0].fp, got[0].fn, got[0].dice, got[0].coco_map, got[0].precision) == (1, 2, 0, 0, 1, 1, [1.0] * 10)
    assert (got[1].mean_precision, got[1].dice, got[1].coco_map) == (0, 0, 0)
    assert (got[2].mean_precision, got[2].fn, got[2].fp, got[2].dice, got[2].coco_map) == (0, 2, 0, 0, 0)
    assert (got[3].mean_precision, got[3].fn, got[3].fp, got[3].dice, got[3].coco_map) == (0, 0, 2, 0, None)
    assert (got[4].mean_precision, got[4].dice, got[4].tp, got[4].precision, got[4].n_truth) == (None, None, None, None, 0)
    assert got[5].mean_precision == got[6].mean_precision == 0.5 and (got[5].fn, got[5].fp, got[6].fn, got[6].fp) == (1, 0, 0, 1)
    assert abs(got[7].dice - 0.5) < 1e-9
    assert (got[8].dice, got[8].mean_precision, got[8].n_truth) == (1, 1, 1)


def test_at_one_half_an_object_has_one_match(spark):
    a, b = np.zeros((2, 4), int), np.zeros((2, 4), int)
    a[0, :2], b[0, 0], b[0, 1] = 1, 1, 2
    got, _ = scores(spark, [(a, b)])
    assert (got[0].tp, got[0].fp, got[0].fn) == (1, 1, 0)


def test_least_cost_pairs_against_all():
    r = np.random.default_rng(2)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 2), (5, 5), (4, 6)] * 6:
        cost = r.integers(0, 6, (n, m)).astype(float) if r.random() < 0.5 else r.normal(size=(n, m))
        got = instances.least_cost_pairs(cost)
        small, tall = min(n, m), n > m
        assert len({i for i, _ in got}) == len({j for _, j in got}) == small
        want = min(sum((cost.T if tall else cost)[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), small))
        assert sum(cost[p] for p in got) == pytest.approx(want)
    assert instances.least_cost_pairs(np.zeros((0, 3))) == []


def test_equal_confidence_detections():
    iou = np.array([[0.9, 0.6, 0.0], [0.0, 0.7, 0.0]])
    assert instances.detection_precision(iou, 0.5) == (1.0, 1.0)  # the third comes after full recall
    first_misses = iou[:, [2, 0, 1]]
    precision, recall = instances.detection_precision(first_misses, 0.5)
    assert recall == 1 and precision == pytest.approx(2 / 3)
    precision, recall = instances.detection_precision(iou, 0.8)
    assert recall == 0.5 and precision == pytest.approx(51 / 101)


def test_centres(spark):
    a, b = squares(), np.zeros((16, 16), int)
    b[3:7, 3:7], b[0:2, 12:16] = 1, 2  # near the first square; far from the second
    _, df = scores(spark, [(a, b), (a, np.zeros((16, 16), int)), (a, a)])
    got = {r.image: r for r in instances.detected_by_centre(df, ["image"], "y", "x", "a", "b").collect()}
    # the axis of a 4 x 4 square is 4 * sqrt(1.25), half of it 2.24; the first centres are sqrt(2) apart
    assert (got[0].tp, got[0].fp, got[0].fn, got[0].precision, got[0].recall, got[0].f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert (got[1].tp, got[1].fp, got[1].fn, got[1].f1) == (0, 0, 2, 0) and got[2].f1 == 1


def test_query_against_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    rows = instance_queries.pixels(spark, sf).collect()
    got = {r.image: r for r in instance_queries.instance_detection(spark, sf).collect()}
    for image in {r.image for r in rows}:
        own = [r for r in rows if r.image == image]
        area = lambda k, v: sum(r[k] == v for r in own)
        labels = [sorted({r[k] for r in own} - {0}) for k in "ab"]
        iou = np.array([[(n := sum(r.a == i and r.b == j for r in own)) / (area("a", i) + area("b", j) - n) for j in labels[1]] for i in labels[0]])
        tp = []
        for t in instances.THRESHOLDS:
            best = {}

            # a largest matching by augmenting paths
            def augment(i, seen, best=best, t=t):
                for j in range(iou.shape[1]):
                    if iou[i, j] >= t and j not in seen:
                        seen.add(j)
                        if j not in best or augment(best[j], seen):
                            best[j] = i
                            return True
                return False

            tp.append(sum(augment(i, set()) for i in random.Random(1).sample(range(iou.shape[0]), iou.shape[0])))
        assert got[image].mean_precision == pytest.approx(np.mean([k / (sum(iou.shape) - k) for k in tp]), abs=1e-6)
        centre = {k: {v: np.mean([(r.y, r.x) for r in own if r[k] == v], axis=0) for v in labels[i]} for i, k in enumerate("ab")}
        assert got[image].tp + got[image].fn == len(centre["a"]) and got[image].tp + got[image].fp == len(centre["b"])
