"""Folds, robust scales and probes against numpy."""

from collections import Counter

import numpy as np
import pytest

from tracklake.operators import aggregates, models


def test_medians_of_groups(spark):
    r = np.random.default_rng(1)
    rows = [(g, None if r.random() < 0.1 else float(r.integers(0, 7))) for g in "aab" * 40] + [("c", 5.0), ("d", None)]
    got = {x.g: x.median for x in aggregates.medians(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v").collect()}
    assert got == {g: float(np.median([v for k, v in rows if k == g and v is not None])) for g in "abc"}


def test_robust_scale_by_group(spark):
    r = np.random.default_rng(2)
    x = {g: r.normal(5 * k, k + 1, size=(31 + k, 3)) for k, g in enumerate("pq")}
    df = spark.createDataFrame([(g, i, v.tolist()) for g, m in x.items() for i, v in enumerate(m)], "g string, i int, v array<double>")
    scaled = lambda m, of: (m - np.median(of, 0)) / (np.median(np.abs(of - np.median(of, 0)), 0) + 1e-12)
    for row in models.robust_scaled(df, "v", ["g"]).collect():
        assert np.allclose(row.v, scaled(x[row.g], x[row.g])[row.i])
    both, p = np.concatenate([x["p"], x["q"]]), df.where("g = 'p'")
    for row in models.robust_scaled(p, "v", learn_from=df).collect():
        assert np.allclose(row.v, scaled(x["p"], both)[row.i])


def test_folds_keep_groups_whole(spark):
    rows = [(g, i) for g in range(23) for i in range(1 + g * 3)] + [(None, 1)]
    got = models.balanced_folds(spark.createDataFrame(rows, "g int, i int"), "g", 4).collect()
    of = {}
    for r in got:
        assert of.setdefault(r.g, r.fold) == r.fold
    size = Counter(r.fold for r in got)
    assert len(got) == len(rows) - 1 and set(size) == {0, 1, 2, 3} and max(size.values()) < 1.2 * min(size.values())


def logistic(x, y, w, strength=1.0):
    x = np.hstack([x, np.ones((len(x), 1))])
    b, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, strength), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * b)
    return b


def area(s, y):
    a, b = s[y], s[~y]
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


@pytest.mark.parametrize("shift", [0.0, 0.8])
def test_probe_against_numpy(spark, shift):
    r = np.random.default_rng(7)
    rows = [(f"fov{r.integers(0, 9)}", bool(k), (r.normal(size=4) + shift * k).tolist()) for k in (0, 1) for _ in range(150 + 60 * k)]
    df = spark.createDataFrame(rows, "fov string, p boolean, v array<double>").repartition(3)
    got = {x.fold: x.auc for x in models.probe_scores(df, "v", "p", "fov", 3).collect()}
    fold = {x.fov: x.fold for x in models.balanced_folds(df, "fov", 3).collect()}
    f, y, x = np.array([fold[g] for g, _, _ in rows]), np.array([p for _, p, _ in rows]), np.array([v for _, _, v in rows])
    for k in range(3):
        train = f != k
        m = np.median(x[train], 0)
        z = (x - m) / (np.median(np.abs(x[train] - m), 0) + 1e-12)
        w = np.where(y, train.sum() / (2 * (y & train).sum()), train.sum() / (2 * (~y & train).sum()))
        b = logistic(z[train], y[train], w[train])
        assert got[k] == pytest.approx(area(z[~train] @ b[:-1], y[~train]), abs=2e-3)
    s = models.probe_summary(models.probe_scores(df, "v", "p", "fov", 3)).first()
    assert s.folds == 3 and s.auc_mean == pytest.approx(np.mean(list(got.values()))) and s.indistinguishability == pytest.approx(1 - 2 * abs(s.auc_mean - 0.5))
    assert (s.auc_mean > 0.8) == (shift > 0)


def test_one_group_gives_no_fold(spark):
    df = spark.createDataFrame([("f", bool(i % 2), [float(i)]) for i in range(10)], "fov string, p boolean, v array<double>")
    assert tuple(models.probe_summary(models.probe_scores(df, "v", "p", "fov")).first()) == (0, None, None, None)
