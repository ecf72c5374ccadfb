"""Textures and shapes against plain loops over small images."""

import numpy as np
import pytest

from tracklake.operators import textures


def image(seed, h=9, w=11):
    r = np.random.default_rng(seed)
    label = np.zeros((h, w), int)
    label[1:5, 1:6], label[6:9, 2:10], label[0, 10], label[2, 3] = 3, 7, 9, 0  # a hole, a border, a lone pixel
    return label, r.random((h, w))


def frame(spark, images):
    rows = [(k, y, x, int(lab[y, x]), float(v[y, x]), 5) for k, (lab, v) in images.items() for y in range(lab.shape[0]) for x in range(lab.shape[1])]
    return spark.createDataFrame(rows, "k int, y int, x int, label int, value double, n int").repartition(3)


def glcm(label, v, k, levels):
    q = np.clip((v * levels).astype(int), 0, levels - 1)
    m = np.zeros((levels, levels))
    for y, x in np.argwhere(label == k):
        for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
            if 0 <= y + dy < label.shape[0] and 0 <= x + dx < label.shape[1] and label[y + dy, x + dx] == k:
                m[q[y, x], q[y + dy, x + dx]] += 1
    m = m + m.T
    return m / m.sum() if m.sum() else None


def test_co_occurrence(spark):
    images = {1: image(1), 2: image(2)}
    got = {(r.k, r.label): r for r in textures.co_occurrence(frame(spark, images), ["k"], "label", "value", 4).collect()}
    assert set(got) == {(k, lab) for k in (1, 2) for lab in (3, 7, 9)}
    for (k, lab), r in got.items():
        m = glcm(*images[k], lab, 4)
        if m is None:
            assert lab == 9 and (r.contrast, r.entropy, r.correlation) == (None, None, None)
            continue
        i, j = np.indices(m.shape)
        mu = (m * i).sum()
        want = [(m * (i - j) ** 2).sum(), (m * abs(i - j)).sum(), (m / (1 + (i - j) ** 2)).sum(), (m**2).sum(), np.sqrt((m**2).sum()), (m * (i - mu) * (j - mu)).sum() / (m * (i - mu) ** 2).sum(), -(m[m > 0] * np.log(m[m > 0])).sum()]
        assert np.allclose([r.contrast, r.dissimilarity, r.homogeneity, r.asm, r.energy, r.correlation, r.entropy], want)
    flat = {1: (image(1)[0], np.full((9, 11), 0.5))}
    assert {r.correlation for r in textures.co_occurrence(frame(spark, flat), ["k"], "label", "value").collect()} == {1.0, None}


def test_edges(spark):
    label, v = image(3)
    p = np.pad(v, 1, mode="edge")
    h, w = v.shape
    gy, gx, lap = np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            c = p[y : y + 3, x : x + 3]
            gy[y, x] = ((c[2] - c[0]) * [1, 2, 1]).sum() / 4
            gx[y, x] = ((c[:, 2] - c[:, 0]) * [1, 2, 1]).sum() / 4
            lap[y, x] = c[0, 1] + c[2, 1] + c[1, 0] + c[1, 2] - 4 * c[1, 1]
    g = np.sqrt((gy**2 + gx**2) / 2)
    for image_columns in (["k"], []):
        for r in textures.edges(frame(spark, {1: (label, v)}), image_columns, "label", "value").collect():
            own = label == r.label
            assert np.allclose([r.gradient_mean, r.gradient_std, r.laplacian_var], [g[own].mean(), g[own].std(), lap[own].var()])


def test_features_of_all_regions(spark):
    images = {1: image(1), 2: (image(2)[0], np.full((9, 11), 4.0))}
    got = {(r.k, r.label): r for r in textures.texture_features(frame(spark, images), ["k"], "label", "value").collect()}
    label, v = images[1]
    lo, hi = np.percentile(v, [1, 99])
    v = (np.clip(v, lo, hi) - lo) / (hi - lo)
    for lab in (3, 7):
        x, r = v[label == lab], got[1, lab]
        assert np.allclose([r["mean"], r["std"], r.low, r.high, r.p10, r.p25, r.p50, r.p75, r.p90, r.iqr], [x.mean(), x.std(), x.min(), x.max(), *np.percentile(x, [10, 25, 50, 75, 90]), np.subtract(*np.percentile(x, [75, 25]))])
        z = (x - x.mean()) / x.std()
        assert np.allclose([r["skew"], r["kurtosis"]], [(z**3).mean(), (z**4).mean() - 3])
    assert got[2, 3]["mean"] == 0 and got[2, 3].gradient_mean == 0


@pytest.mark.parametrize("seed", range(4))
def test_depths_against_all_distances(seed):
    inside = np.random.default_rng(seed).random((8, 12)) < 0.7
    out = np.argwhere(~inside)
    want = [[min((y - a) ** 2 + (x - b) ** 2 for a, b in out) for x in range(12)] for y in range(8)]
    assert np.array_equal(textures.squared_depths(inside), want)


def test_shapes(spark):
    label, v = image(5)
    for r in textures.shapes(frame(spark, {1: (label, v)}), ["k"], "label", "value").collect():
        own, padded = label == r.label, np.pad(label == r.label, 1)
        edges = sum((padded & ~np.roll(padded, s, a)).sum() for s in (1, -1) for a in (0, 1))
        yx = np.argwhere(own)
        out = np.argwhere(~padded) - 1
        depth = np.array([np.sqrt(((out - p) ** 2).sum(1).min()) for p in yx])
        assert (r.area, r.perimeter) == (own.sum(), edges) and r.perimeter_area == pytest.approx(edges / own.sum())
        assert r.localization == pytest.approx((v[own] * depth / depth.max()).mean() / v[own].mean()) and r.masked_intensity == pytest.approx(v[own].sum())
        if own.sum() > 1:
            small, great = np.linalg.eigvalsh(np.cov(yx.T, bias=True))
            assert r.eccentricity == pytest.approx(np.sqrt(1 - small / great))
        else:
            assert r.eccentricity == 0
