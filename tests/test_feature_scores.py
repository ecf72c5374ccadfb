"""Feature scores against numpy on the same subsets, resamples and directions."""

import hashlib

import numpy as np
import pytest

from tracklake.operators import feature_scores as fs
from tracklake.operators.batches import STRIDES
from tracklake.operators.index import hashed_order


def sides(spark, n=90, m=60, shift=0.4, seed=3):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=(n, 5)), r.normal(shift, 1.2, size=(m, 5))])
    rows = [(i, i < n, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, True, None), (1001, False, [float("nan")] * 5), (1002, None, [0.0] * 5), (1003, True, [float("inf")] * 5)]
    df = spark.createDataFrame(rows + odd, "id long, f boolean, v array<double>").repartition(4)
    order = [x.id for x in df.where("id < 1000").orderBy(hashed_order("s", "id")).select("id").collect()]
    return x, df, np.array([i for i in order if i < n]), np.array([i for i in order if i >= n])


def number(*of):
    return int(hashlib.md5("|".join(map(str, of)).encode()).hexdigest()[:12], 16)


@pytest.mark.parametrize("size", [20, 1000])
def test_kernel_distance(spark, size):
    x, df, a, b = sides(spark)
    got = fs.kernel_distance(df, "f", "v", "id", subsets=7, size=size, seed="s").first()
    m, found = min(size, 60), []
    for s in range(7):
        part = []
        for ids, side in ((a, "true"), (b, "false")):
            n = len(ids)
            stride, start = STRIDES[number("s", s, side, "stride") % 16] % n, number("s", s, side, "start") % n
            part.append(x[ids[(np.arange(n) * stride + start) % n < m]])
        assert [len(p) for p in part] == [m, m]
        k = lambda p, q: (p @ q.T / 5 + 1) ** 3
        own = lambda k: (k.sum() - np.trace(k)) / (m * (m - 1))
        found.append(own(k(part[0], part[0])) + own(k(part[1], part[1])) - 2 * k(part[0], part[1]).mean())
    assert (got["size"], got["mean"], got["std"]) == (m, pytest.approx(np.mean(found)), pytest.approx(np.std(found)))
    none = fs.kernel_distance(df.where("f"), "f", "v", "id").first()
    assert (none["mean"], none["std"]) == (None, None)


def test_manifold_scores(spark):
    x, df, a, b = sides(spark, shift=1.5)
    got = fs.manifold_scores(df, "f", "v", "id", neighbours=2, resamples=4, size=40, seed="s").first()
    found = []
    for r in range(4):
        p, q = (x[ids[[number("s", r, side, k) % len(ids) for k in range(40)]]] for ids, side in ((a, "true"), (b, "false")))
        far = lambda u, v: np.sqrt(((u[:, None] - v[None]) ** 2).sum(2))
        covered = lambda u, v: (far(u, v) <= np.sort(far(v, v), 1)[:, 2]).any(1).mean()
        precision, recall = covered(p, q), covered(q, p)
        found.append((precision, recall, 2 * precision * recall / (precision + recall)))
    assert np.allclose([got.precision_mean, got.recall_mean, got.f1_mean], np.mean(found, 0)) and np.allclose([got.precision_std, got.recall_std, got.f1_std], np.std(found, 0))
    assert 0 < got.precision_mean < 1
    assert fs.manifold_scores(df.where("f"), "f", "v", "id").first().f1_mean is None


@pytest.mark.parametrize(("n", "m"), [(40, 40), (90, 60), (7, 61)])
def test_sliced_transport(spark, n, m):
    x, df, _, _ = sides(spark, n, m)
    for projections in (6, 900):
        u = fs.directions(5, projections, 2020)
        want = []
        for d in u:
            p, q = np.sort(x[:n] @ d), np.sort(x[n:] @ d)
            # every unit of mass 1 / (n * m)
            want.append(((np.repeat(p, m) - np.repeat(q, n)) ** 2).mean())
        assert fs.sliced_transport(df, "f", "v", "id", projections).first().distance == pytest.approx(np.mean(want))
    assert fs.sliced_transport(df.where("f"), "f", "v", "id").first().distance is None


def test_median_cosine(spark):
    r = np.random.default_rng(8)
    for n in (9, 10, 0):
        a, b = r.normal(size=(n, 3)), r.normal(size=(n, 3))
        rows = [(p.tolist(), q.tolist()) for p, q in zip(a, b, strict=True)] + [([0.0] * 3, [1.0] * 3), (None, [1.0] * 3), ([float("nan")] * 3, [1.0] * 3)]
        got = fs.median_cosine(spark.createDataFrame(rows, "a array<double>, b array<double>"), "a", "b").first()
        cos = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        assert got.n == n and (got["median"] == pytest.approx(np.median(cos)) if n else got["median"] is None)
