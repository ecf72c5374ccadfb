"""Permutation tests against plain kernels of whole groups, with the same permutations."""

import numpy as np
import pytest

from tracklake.operators import kernel_tests as kt
from tracklake.operators.index import hashed_order


def plain(x, first, place, bandwidth, permutations, seed="42"):
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    k = np.exp(-d2 / (2 * bandwidth))
    np.fill_diagonal(k, 0)

    def value(f):
        n, m = f.sum(), (~f).sum()
        return k[np.ix_(f, f)].sum() / (n * (n - 1)) + k[np.ix_(~f, ~f)].sum() / (m * (m - 1)) - 2 * k[np.ix_(f, ~f)].mean()

    observed = value(first)
    null = np.array([value(kt.permuted(place, len(x), int(first.sum()), b, seed)) for b in range(1, permutations + 1)])
    return observed, ((null >= observed).sum() + 1) / (permutations + 1), (observed - null.mean()) / (null.std() + 1e-12)


def data(shift, n=70, m=50, seed=1, offset=0.0):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=(n, 4)), r.normal(shift, 1, size=(m, 4))]) + offset


@pytest.mark.parametrize(("shift", "block", "offset"), [(0.0, 10_000, 0.0), (1.0, 17, 0.0), (0.3, 40, 1e5)])
def test_against_whole_kernels(spark, shift, block, offset):
    x = data(shift, offset=offset)
    rows = [(i, "a" if i < 70 else "b", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, c string, v array<double>").repartition(3)
    (got,) = kt.mmd_tests(df, [], "c", [("ab", "a", "b")], "v", "id", permutations=60, block=block).collect()
    order = [r.id for r in df.orderBy(hashed_order("42", "id")).select("id").collect()]
    place = np.argsort(order)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    assert got.bandwidth == pytest.approx(np.median(d2[np.triu_indices(len(x), 1)]))
    observed, p, z = plain(x, np.arange(len(x)) < 70, place, got.bandwidth, 60)
    assert (got.n_a, got.n_b) == (70, 50) and got.mmd2 == pytest.approx(observed, abs=1e-9) and got.p == pytest.approx(p) and got.z == pytest.approx(z, rel=1e-5)
    assert got.p == pytest.approx(1 / 61) if shift == 1 else got.p > 1 / 61 or shift > 0
    assert got.q == got.p and got.effect == pytest.approx(got.mmd2 / got.bandwidth)


def test_permutations_keep_the_sizes_and_differ():
    place = np.arange(101)
    found = [kt.permuted(place, 101, 37, b, "s") for b in range(1, 40)]
    assert all(f.sum() == 37 for f in found) and len({tuple(f) for f in found}) > 35
    assert 0.3 < np.mean(found, axis=0).mean() < 0.43


def test_groups_bins_aliases_and_centres(spark):
    r = np.random.default_rng(5)
    rows = []
    for g, batch in (("g1", 0.0), ("g2", 40.0)):  # the batch effect is far larger than the difference
        for i in range(160):
            c = "treated" if i % 2 else "mock"
            hours = float(i % 20)
            rows.append((len(rows), g, c, hours, (r.normal(size=3) + batch + (2.0 if c == "treated" and hours >= 10 else 0)).tolist()))
    rows += [(900, "g1", "other", 3.0, [0.0] * 3), (901, None, "mock", 3.0, [0.0] * 3), (902, "g1", "mock", 3.0, None), (903, "g1", "mock", 99.0, [0.0] * 3), (904, "g3", "mock", 3.0, [0.0] * 3)]
    df = spark.createDataFrame(rows, "id long, g string, c string, hours double, v array<double>")
    got = {(x.g, x.bin): x for x in kt.mmd_tests(df, ["g"], "c", [("t-m", "drug", "mock")], "v", "id", "hours", [0, 10, 20], aliases={"treated": "drug"}, permutations=39, least=5).collect()}
    assert set(got) == {("g1", 0.0), ("g1", 10.0), ("g2", 0.0), ("g2", 10.0), ("g3", 0.0)}
    assert (got["g3", 0.0].n_a, got["g3", 0.0].n_b, got["g3", 0.0].p, got["g3", 0.0].q) == (0, 1, None, None)
    for g in ("g1", "g2"):
        assert got[g, 10.0].p == pytest.approx(1 / 40) and got[g, 0.0].p > 0.05 and got[g, 10.0].mmd2 > 10 * abs(got[g, 0.0].mmd2)
        assert got[g, 10.0].q <= got[g, 0.0].q
    # across batches: without centring they differ, with it they don't
    across = [kt.mmd_tests(df.where("hours < 10 AND g <> 'g3'"), [], "g", [("x", "g1", "g2")], "v", "id", permutations=39, centre=c).first() for c in (None, ["g"])]
    assert across[0].p == pytest.approx(1 / 40) and across[0].mmd2 > 0.5 > 0.1 > abs(across[1].mmd2)


def test_one_bandwidth_for_all_comparisons(spark):
    x = data(3.0, 60, 60)
    rows = [(i, "a" if i < 60 else "b" if i < 90 else "c", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, c string, v array<double>")
    pairs = [("ab", "a", "b"), ("bc", "b", "c")]
    own, shared = ({r.comparison: r.bandwidth for r in kt.mmd_tests(df, [], "c", pairs, "v", "id", permutations=9, shared_bandwidth=s).collect()} for s in (False, True))
    assert own["ab"] != own["bc"] and shared["ab"] == shared["bc"]
