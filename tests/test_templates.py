"""Templates and alignments against all paths, plain loops and the reference's own expectations for them."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import templates as tp
from tracklake.plans import template_queries


def all_paths(n, m):
    def go(i, j):
        if (i, j) == (n - 1, m - 1):
            yield [(i, j)]
        for a, b in ((1, 1), (1, 0), (0, 1)):
            if i + a < n and j + b < m:
                for p in go(i + a, j + b):
                    yield [(i, j), *p]

    return list(go(0, 0))


@pytest.mark.parametrize(("n", "m"), [(4, 3), (1, 5), (5, 1), (3, 3), (2, 5)])
def test_costs_no_more_than_any_path(n, m):
    r = np.random.default_rng(n * 10 + m)
    a, b = r.normal(size=(n, 2)), r.normal(size=(m, 2))
    gaps = tp.squared_gaps(a, b)
    want = min(sum(gaps[c] for c in p) for p in all_paths(n, m))
    total = tp.cumulated(gaps)
    assert total[-1, -1] == pytest.approx(want)
    path = tp.path_to(total, n, m)
    assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1) and sum(gaps[c] for c in path) == pytest.approx(want)
    # the best stretch of b for the whole of a
    cost, path = tp.best_match(a, b)
    stretches = [min(sum(tp.squared_gaps(a, b[i:j])[c] for c in p) for p in all_paths(n, j - i)) for i, j in itertools.combinations(range(m + 1), 2)]
    assert cost == pytest.approx(np.sqrt(min(stretches)) / n) and sum(gaps[c] for c in path) == pytest.approx(min(stretches))
    # up to psi places of either may be left out at each end
    psi = 1
    cuts = [(i, j, k, q) for i in range(n) for j in range(i + 1, n + 1) for k in range(m) for q in range(k + 1, m + 1) if i <= min(psi, n - 1, m - 1) and k <= min(psi, n - 1, m - 1) and (i == 0 or k == 0) and n - j <= min(psi, n - 1, m - 1) and m - q <= min(psi, n - 1, m - 1) and (n == j or m == q)]
    want = min(min(sum(tp.squared_gaps(a[i:j], b[k:q])[c] for c in p) for p in all_paths(j - i, q - k)) for i, j, k, q in cuts)
    assert tp.best_match(a, b, psi)[0] == pytest.approx(np.sqrt(want))


def tracks_of(seed=3, n=12, noise=0.05):
    """Tracks that rise from 0 to 1, each at its own time and speed: (fov, track, frame, vector, state, minutes)."""
    r, rows = np.random.default_rng(seed), []
    for k in range(n):
        start, steps = r.integers(2, 8), r.integers(3, 7)
        for t in range(18):
            x = float(np.clip((t - start) / steps, 0, 1))
            v = np.array([x, 1 - x, 0.2]) + noise * r.normal(size=3)
            rows.append((f"f{k % 2}", k, t, v.tolist(), "on" if x >= 0.5 else "off", float((t - start) * 30)))
    return rows


SCHEMA = "fov string, track int, t int, v array<double>, state string, minutes double"


def plain_barycentre(seqs, first, rounds, tolerance):
    shape = seqs[first].copy()
    for _ in range(rounds):
        added, n = np.zeros_like(shape), np.zeros(len(shape))
        for s in seqs:
            total = tp.cumulated(tp.squared_gaps(shape, s))
            for p, i in tp.path_to(total, len(shape), len(s)):
                added[p] += s[i]
                n[p] += 1
        new = added / n[:, None]
        change = np.abs(new - shape).mean()
        shape = new
        if change < tolerance:
            break
    return shape


def test_template_against_plain_loops(spark):
    rows = tracks_of()
    df = spark.createDataFrame([*rows, ("f0", 0, 99, None, "on", 1.0), ("f0", 0, 98, [float("nan")] * 3, "on", 1.0)], SCHEMA).repartition(5)
    got = tp.learn_template(df, ["fov", "track"], "t", "v", "state", "minutes")
    seqs = [np.array([r[3] for r in rows if r[1] == k]) for k in range(12)]
    far = [[np.sqrt(tp.cumulated(tp.squared_gaps(a, b))[-1, -1]) for b in seqs] for a in seqs]
    want = plain_barycentre(seqs, int(np.argmin(np.sum(far, axis=1))), 30, 1e-5)
    assert got.tracks == 12 and 1 <= got.rounds <= 30
    assert np.allclose(got.vectors, want, atol=1e-9)
    # labels and times over the places that a last alignment meets
    on, off, times = np.zeros(len(want)), np.zeros(len(want)), [[] for _ in want]
    for k, s in enumerate(seqs):
        own = [r for r in rows if r[1] == k]
        for p, i in tp.path_to(tp.cumulated(tp.squared_gaps(want, s)), len(want), len(s)):
            (on if own[i][4] == "on" else off)[p] += 1
            times[p].append(own[i][5])
    assert np.allclose(got.fractions["on"], on / (on + off)) and np.allclose(np.add(got.fractions["on"], got.fractions["off"]), 1)
    assert np.allclose(got.minutes, [np.mean(x) for x in times])
    assert np.all(np.diff(got.minutes) >= -1e-6) and got.minutes[0] < 0 < got.minutes[-1]
    unit = tp.learn_template(df, ["fov", "track"], "t", "v", rounds=1, unit=True)
    assert np.allclose(np.linalg.norm(unit.vectors, axis=1), 1) and unit.minutes is None and unit.rounds == 1
    with pytest.raises(ValueError, match="no tracks"):
        tp.learn_template(df.limit(0), ["fov", "track"], "t", "v")


def test_alignment_finds_the_event_in_longer_tracks(spark):
    template = tp.Template(np.array([[x, 1 - x, 0.2] for x in np.linspace(0, 1, 5)]), 1, 0, {"on": [0.0, 0.0, 0.5, 1.0, 1.0]}, [-60.0, -30.0, 0.0, 30.0, 60.0])
    rows = [("f", 1, t, [x, 1 - x, 0.2], "s", 0.0) for t, x in enumerate([9.0, 9.0, 0.0, 0.25, 0.5, 0.75, 1.0, 7.0])] + [("f", 2, t, [0.0, 0.0, 0.0], "s", 0.0) for t in range(2)]
    got = sorted(tp.align_tracks(spark.createDataFrame(rows, SCHEMA), ["fov", "track"], "t", "v", template).collect(), key=lambda r: r.t)
    assert [r.region for r in got] == ["pre"] * 2 + ["aligned"] * 5 + ["post"]
    assert [r.pseudotime for r in got] == [0, 0, 0, 0.25, 0.5, 0.75, 1, 1]
    assert [r.speed for r in got] == [0, 0, 0.125, 0.25, 0.25, 0.25, 0.125, 0]
    assert [r.minutes for r in got] == [-60, -60, -60, -30, 0, 30, 60, 60] and [r.labels["on"] for r in got] == [0, 0, 0, 0, 0.5, 1, 1, 1]
    assert {(r.cost, r.mean_cost, r.skew) for r in got} == {(0, 0, 0)}
    whole = tp.align_tracks(spark.createDataFrame(rows, SCHEMA), ["fov", "track"], "t", "v", template, subsequence=False, psi=0).collect()
    assert {r.region for r in whole} == {"aligned"} and min(r.cost for r in whole) > 1 and max(r.pseudotime for r in whole) == 1


def test_gates_count_what_they_drop(spark):
    rows = []
    for track, cost, skew, regions in ((1, 0.1, 0.1, "ppaaap"), (2, float("inf"), 0.1, "paaap"), (3, 0.1, 0.9, "paaap"), (4, 0.1, 0.1, "ppapp"), (5, 0.1, 0.1, "aaaa"), (6, None, 0.1, "paaap")):
        rows += [(track, t, {"p": "pre", "a": "aligned"}[c], 5.0, cost, skew) for t, c in enumerate(regions)]
    a = spark.createDataFrame(rows, "track int, t int, region string, minutes double, mean_cost double, skew double")
    kept, log = tp.gated(a, ["track"], "t", 5, 30.0, match_minutes=60, before_minutes=30, after_minutes=30)
    assert [tuple(r) for r in log.orderBy("step").collect()] == [(1, "finite_cost", 4, 2), (2, "skew", 3, 1), (3, "match", 2, 1), (4, "headroom", 1, 1)]
    got = sorted(tuple(r) for r in kept.select("track", "t", "minutes", "match_start", "match_stop", "match_minutes").collect())
    assert got == [(1, t, 5.0 if 2 <= t <= 4 else None, 2, 4, 60.0) for t in range(6)]


def test_lineages_come_back_to_their_own_tracks(spark):
    # lineage 9 has frames of the parent 1, then of itself; the match lies with the parent, so track 9 goes
    rows = [("f", 9, t, 1 if t < 4 else 9, t + 10, "aligned" if 1 <= t < 3 else "pre") for t in range(6)]
    rows += [("f", 8, t, 8, t, "aligned") for t in range(3)]
    a = spark.createDataFrame(rows, "fov string, track int, t int, own_track int, own_t int, region string")
    got = sorted(tuple(r) for r in tp.on_real_tracks(a, ["fov", "track"], "t", {"track": "own_track"}, "own_t", 10.0).select("track", "t", "match_start", "match_stop", "match_minutes").collect())
    assert got == [(1, t, 11, 12, 10.0) for t in range(10, 14)] + [(8, t, 0, 2, 20.0) for t in range(3)]


def test_event_band():
    t = lambda v: tp.Template(np.array(v, float), 1)
    assert tp.event_band(t([[0], [0.1], [1.1], [1.7], [1.8]])) == ((1 + 0.5) / 4, (2 + 0.5) / 4)
    assert tp.event_band(t([[1], [1]])) == (0.0, 1.0) == tp.event_band(t([[1]]))


def test_responses_by_quantile_and_clusters(spark):
    rows = [(k, t, float(k == 7), 0.1 * (t % 2) * (3 if k % 2 else 1)) for k in range(8) for t in range(4)]
    a = spark.createDataFrame(rows, "track int, t int, cost double, speed double")
    for method in ("quantile", "kmeans"):
        got = {r.track: r.response for r in tp.response_groups(a, ["track"], 0.8, method).collect()}
        assert got == {k: "non_responder" if k == 7 else "early" if k % 2 else "late" for k in range(8)} or method == "quantile"
        assert got[7] == "non_responder" and got[1] == "early"


def test_queries_learn_from_the_table(spark):
    sf = "/root/testdata/sf0.001"
    d = template_queries.days(spark, sf).collect()
    onset = {}
    for r in d:
        if r.state == "error":
            onset[r.user_id] = min(onset.get(r.user_id, 10**9), r.day)
    near = {}
    for r in sorted(d, key=lambda r: r.day):
        if r.user_id in onset and -3 <= r.day - onset[r.user_id] <= 6:
            near.setdefault(r.user_id, []).append(r.v)
    seqs = [np.array(v) for v in near.values() if len(v) >= 4]
    far = [sum(np.sqrt(tp.cumulated(tp.squared_gaps(a, b))[-1, -1]) for b in seqs) for a in seqs]
    got = template_queries.dtw_template(spark, sf).orderBy("place").collect()
    if len(seqs) <= 50:
        assert np.allclose([r.vector for r in got], plain_barycentre(seqs, int(np.argmin(far)), 30, 1e-5), atol=1e-5)
    a = template_queries.dtw_pseudotime(spark, sf)
    assert a.where("region = 'pre' AND pseudotime <> 0 OR region = 'post' AND pseudotime <> 1").count() == 0
    log = template_queries.alignment_gates(spark, sf).orderBy("step").collect()
    assert log[0].kept + log[0].dropped == a.select("user_id").distinct().count() and all(x.kept == y.kept + y.dropped for x, y in itertools.pairwise(log))
    assert {r.response for r in template_queries.dtw_responses(spark, sf).select(F.col("response")).collect()} >= {"non_responder", "early"}


@pytest.mark.parametrize("subsequence", [False, True])
def test_many_tracks_at_once_are_matched_as_one_by_one(subsequence):
    r = np.random.default_rng(7)
    shape = r.integers(0, 3, (5, 2)).astype(float)  # whole numbers: ties
    tracks = [r.integers(0, 3, (int(n), 2)).astype(float) for n in r.integers(1, 12, 60)]
    got = {k: (c, path.tolist()) for k, c, path in tp.matches(shape, tracks, subsequence)}
    for k, own in enumerate(tracks):
        total = tp.cumulated(tp.squared_gaps(shape, own), 0, len(own) if subsequence else 0)
        j = int(np.argmin(total[5, 1:])) + 1 if subsequence else len(own)
        assert got[k] == (total[5, j], [list(p) for p in tp.path_to(total, 5, j)])


def test_alignments_make_no_task_call_for_each_track(spark):
    df = spark.createDataFrame([(k, t, [float(t % 4)]) for k in range(30) for t in range(6)], "k int, t int, v array<double>")
    a = tp.align_tracks(df, ["k"], "t", "v", tp.Template(np.array([[1.0], [2.0], [3.0]]), 1))
    assert "FlatMapGroups" not in a._jdf.queryExecution().executedPlan().toString() and a.count() == 180
