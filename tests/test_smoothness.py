"""Smoothness and peaks against numpy."""

import hashlib

import numpy as np
import pytest

from tracklake.operators import smoothness as sm
from tracklake.operators.index import hashed_order


def test_local_peaks():
    at = np.arange(7.0)
    assert sm.local_peak(at, np.array([9, 1, 3, 1, 5, 1, 0.0])) == 4
    assert sm.local_peak(at, np.array([9, 1, 3, 3, 3, 1, 0.0])) == 3  # the middle of a flat one
    assert sm.local_peak(at, np.array([9, 1, 0.5, 0.6, 0.1, 0, 0.0])) == 0  # below a tenth
    assert sm.local_peak(at, np.array([0, 1, 2, 3, 4, 5, 6.0])) == 6
    assert sm.local_peak(at, np.array([0, 1, 1, 1, 1, 1, 1.0])) == 1


def density_peak(x):
    h = x.std(ddof=1) * len(x) ** -0.2
    places = np.linspace(x.min(), x.max(), 1000)
    return sm.local_peak(places, np.exp(-0.5 * ((places[:, None] - x) / h) ** 2).sum(1))


def test_peaks_of_groups(spark):
    r = np.random.default_rng(4)
    x = {"one": r.normal(3, 1, 400), "two": np.concatenate([r.normal(0, 0.5, 150), r.normal(8, 0.5, 260)]), "same": np.full(5, 7.0), "skew": r.gamma(2, 2, 300)}
    rows = [(g, float(v)) for g, vs in x.items() for v in vs] + [("one", None), ("one", float("nan")), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {p.g: p for p in sm.distribution_peaks(df, ["g"], "v").collect()}
    for g in ("one", "two", "skew"):
        assert got[g].n == len(x[g]) and abs(got[g].peak - density_peak(x[g])) <= 1.01 * np.ptp(x[g]) / 999
    assert got["same"].peak == 7.0
    for p in sm.distribution_peaks(df, ["g"], "v", "histogram").collect():
        if p.g != "same":
            height, edges = np.histogram(x[p.g], 50)
            assert p.peak == pytest.approx(sm.local_peak((edges[:-1] + edges[1:]) / 2, height.astype(float)))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_models_against_numpy(spark, metric):
    r = np.random.default_rng(6)
    rows = []
    for model, step in (("smooth", 0.1), ("rough", 3.0)):
        for track in range(6):
            v = r.normal(size=4) * 3
            for t in range(int(r.integers(2, 12))):
                v = v + step * r.normal(size=4)
                rows.append((model, track, 2 * t, v.tolist(), "own"))
    rows += [("smooth", 99, 0, [0.0] * 4, "own"), ("smooth", 98, 0, None, "own"), ("alone", 1, 0, [1.0] * 4, "own")]
    df = spark.createDataFrame(rows, "model string, track int, t int, v array<double>, kind string").repartition(3)
    got = {x.model: x for x in sm.smoothness(df, ["model"], ["track"], "t", "v", (1, 2), metric).collect()}
    assert set(got) == {"smooth", "rough"} and got["smooth"].smoothness < 0.2 < got["rough"].smoothness
    number = lambda *of: int(hashlib.md5("|".join(map(str, of)).encode()).hexdigest()[:12], 16)
    for model in got:
        own = sorted((a, b, v) for m, a, b, v, _ in rows if m == model and v)
        x = np.array([v for _, _, v in own])
        x = (x - x.mean(0)) / x.std(0)
        far = (lambda p, q: 1 - p @ q / np.linalg.norm(p) / np.linalg.norm(q)) if metric == "cosine" else (lambda p, q: np.linalg.norm(p - q))
        keys = spark.createDataFrame([(f"{a}|{b}", k) for k, (a, b, _) in enumerate(own)], "key string, k int")
        order = [p.k for p in keys.orderBy(hashed_order("42", "key")).collect()]
        near, rand = [], []
        for k, (a, b, _) in enumerate(own):
            for o, by in enumerate((1, 2)):
                if k + by < len(own) and own[k + by][0] == a:
                    near.append(far(x[k], x[k + by]))
                    i, j = number("42", f"{a}|{b}", o, "i") % len(own), number("42", f"{a}|{b}", o, "j") % (len(own) - 1)
                    rand.append(far(x[order[i]], x[order[j + (j >= i)]]))
        g = got[model]
        assert g.n == len(near)
        assert np.allclose([g.adjacent_mean, g.adjacent_std, g.adjacent_median, g.random_mean, g.random_std, g.random_median, g.smoothness], [np.mean(near), np.std(near), np.median(near), np.mean(rand), np.std(rand), np.median(rand), np.mean(near) / np.mean(rand)], atol=1e-9)
        assert abs(g.adjacent_peak - density_peak(np.array(near))) < 1.01 * np.ptp(near) / 999 and g.dynamic_range == pytest.approx(g.random_peak - g.adjacent_peak)
