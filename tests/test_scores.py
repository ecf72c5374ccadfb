"""Scores against numpy."""

import numpy as np

from tracklake.operators import scores


def fixture(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(240, 6))
    x[:, 1] = x[:, 0] + 0.01 * r.normal(size=240)
    x[:, 4] = 2 * x[:, 0] + 0.2 * r.normal(size=240)
    x[:, 5] = 1.0
    rows = [(i % 2, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, None), (1, [float("nan")] * 6), (0, [float("inf")] * 6), (None, [0.0] * 6)]
    return x, spark.createDataFrame(rows, "g int, v array<double>").repartition(3)


def test_moments_and_correlations(spark):
    x, df = fixture(spark)
    got = {(r.g, r.i, r.j): r.r for r in scores.correlations(scores.comoments(df, "g", "v"), "g").collect()}
    for g in (0, 1):
        with np.errstate(invalid="ignore"):
            want = np.nan_to_num(np.corrcoef(x[g::2], rowvar=False))
        for i in range(6):
            for j in range(i + 1, 6):
                assert abs(got[g, i, j] - want[i, j]) < 1e-9


def test_uncorrelated(spark):
    x, df = fixture(spark)
    got = {(r.g, r.component): r.kept for r in scores.uncorrelated(df, "g", "v").collect()}
    for g in (0, 1):
        with np.errstate(invalid="ignore"):
            c = np.abs(np.nan_to_num(np.corrcoef(x[g::2], rowvar=False)))
        np.fill_diagonal(c, 0)
        left, order = set(range(6)), sorted(((-c[i, j], i, j) for i in range(6) for j in range(i + 1, 6) if c[i, j] > 0.9))
        for _, i, j in order:
            if {i, j} <= left:
                a, b = sum(c[i, k] for k in left), sum(c[j, k] for k in left)
                left.discard(j if np.isclose(a, b, rtol=1e-5, atol=1e-8) or b > a else i)
        assert {k for k in range(6) if got[g, k]} == left
        assert len(left) == 4


def test_effective_rank(spark):
    x, df = fixture(spark)
    got = {r.g: r for r in scores.effective_rank(df, "g", "v").collect()}
    for g in (0, 1):
        s = np.linalg.svd(x[g::2], compute_uv=False)
        p = s / s.sum()
        assert abs(got[g].effective_rank - np.exp(-(p * np.log(p)).sum())) < 1e-5
        assert got[g].n == 120
    assert got[None].effective_rank is None  # one row


def test_frechet(spark):
    x, df = fixture(spark)
    a, b = x[::2], x[1::2]
    root = np.sqrt(np.maximum(np.linalg.eigvals(np.cov(a, rowvar=False) @ np.cov(b, rowvar=False)).real, 0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(np.cov(a, rowvar=False)) + np.trace(np.cov(b, rowvar=False)) - 2 * root
    assert abs(scores.frechet_distance(df, "g", 0, 1, "v").first().distance - want) < 1e-6
    assert scores.frechet_distance(df, "g", 0, 9, "v").first().distance is None


def test_resampled_template(spark):
    df = spark.createDataFrame([("a", 0.0, [1.0, 0.0]), ("a", 10.0, [0.0, 1.0]), ("a", 30.0, [0.0, 3.0]), ("b", 5.0, [1.0, 1.0])], "k string, t double, v array<double>")
    got = sorted((r.step, r.time, [round(c, 6) for c in r.v]) for r in scores.resampled_template(df, "k", "t", "v", 5.0).collect())
    h = round(0.5**0.5, 6)
    assert got == [(0, 0.0, [1, 0]), (1, 5.0, [h, h]), *((i, 5.0 * i, [0, 1]) for i in range(2, 7))]


def test_agreement_of_equal_and_single_clusterings(spark):
    same = spark.createDataFrame([(i % 3, -(i % 3)) for i in range(30)] + [(None, 1)], "a int, b int")
    assert [round(v, 9) for v in scores.clustering_agreement(same, "a", "b").first()] == [30, 1, 1]
    one = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert list(scores.clustering_agreement(one, "a", "b").first()) == [2, 1.0, 1.0]


def test_offsets_cost_no_digits(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(300, 4))
    x[:, 1] = -x[:, 0]
    for offset in (1e8, 1e9):
        df = spark.createDataFrame([(i % 2, (v + offset).tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 4)], "g int, v array<double>").repartition(3)
        got = {(p.g, p.i, p.j): p.r for p in scores.correlations(scores.comoments(df, "g", "v"), "g").collect()}
        for g in (0, 1):
            want = np.corrcoef((x + offset)[g::2] - offset, rowvar=False)
            assert all(abs(got[g, i, j] - want[i, j]) < 1e-9 and abs(got[g, i, j]) <= 1 for i in range(4) for j in range(i + 1, 4))
        assert {(p.g, p.component): p.kept for p in scores.uncorrelated(df.where("g IS NOT NULL"), "g", "v").collect()} == {(g, c): c != 1 for g in (0, 1) for c in range(4)}
        near = scores.frechet_distance(df, "g", 0, 1, "v").first().distance
        plain = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate((x + offset) - offset)], "g int, v array<double>")
        assert abs(near - scores.frechet_distance(plain, "g", 0, 1, "v").first().distance) < 1e-6


def test_a_lone_component_stays(spark):
    df = spark.createDataFrame([(1, [float(i)]) for i in range(5)], "g int, v array<double>")
    assert [tuple(r) for r in scores.uncorrelated(df, "g", "v").collect()] == [(1, 0, True)]


def test_routed_classes(spark):
    import math

    import pytest

    from tracklake.operators.scores import routed_classes

    rows = spark.createDataFrame([(1, "a", 2.0, 1.0), (2, "b", 1.0, None), (3, None, 1.0, 1.0), (4, "z", 1.0, 1.0), (5, "a", 0.0, 0.0), (5, "a", 0.0, 0.0)], "id long, marker string, x double, prediction double")
    model = [("t1", "a", "yes", [1.0], 0.0), ("t1", "a", "no", [-1.0], 0.0), ("t1", "b", "no", [0.0], 1.0), ("t1", "b", "yes", [0.0], 0.0), ("t2", "a", "only", [3.0], 0.0)]
    schema = "task string, marker string, class string, w array<double>, b double"
    got = routed_classes(rows, spark.createDataFrame(model, schema), "task", "marker", "class", "w", "b", ["x"]).collect()
    assert len(got) == 12
    at = {(r.id, r.task): r for r in got}
    assert at[1, "t1"].prediction == "yes" and at[1, "t1"].classes == ["no", "yes"]
    assert abs(at[1, "t1"].probabilities[1] - 1 / (1 + math.exp(-4))) < 1e-12
    assert at[2, "t1"].prediction == "no" and at[2, "t2"].prediction is None and at[2, "t2"].probabilities is None
    assert at[3, "t1"].prediction is None and at[4, "t2"].prediction is None and at[1, "t2"].probabilities == [1.0]
    assert at[5, "t1"].prediction == "no" and at[5, "t1"].probabilities == [0.5, 0.5]  # equal scores: the first by name
    empty = spark.createDataFrame([(1, "a", None, 0.0)], "id long, marker string, x double, prediction double")
    assert [r.prediction for r in routed_classes(empty, spark.createDataFrame(model, schema), "task", "marker", "class", "w", "b", ["x"]).collect()] == [None, None]
    assert routed_classes(rows, spark.createDataFrame([], schema), "task", "marker", "class", "w", "b", ["x"]).collect() == []
    with pytest.raises(Exception, match="classes differ"):
        routed_classes(rows, spark.createDataFrame([*model, ("t2", "b", "other", [1.0], 0.0)], schema), "task", "marker", "class", "w", "b", ["x"]).collect()
