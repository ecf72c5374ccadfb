"""Plans and shapes of jobs whose time grew faster than their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import aggregates, evaluation, kernel_tests, signals


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_q_values_have_no_frame_to_the_end(spark):
    p = spark.range(2000).select(F.col("id"), ((F.col("id") * 37 % 2000) / 2500).alias("p"))
    q = aggregates.benjamini_hochberg(p, "p")
    assert "unboundedfollowing" not in plan(q).lower()
    rows = sorted(q.collect(), key=lambda r: -r.p)
    least, want = 1.0, {}
    for i, r in enumerate(rows):
        least = min(least, r.p * 2000 / (2000 - i))
        want[r.id] = least
    assert all(abs(r.q - want[r.id]) < 1e-12 for r in rows)


def test_pairs_of_blocks_are_not_merged_into_few_tasks(spark):
    e = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("side"), F.array(F.rand(1), F.rand(2)).alias("v"))
    spark.sparkContext.setJobGroup("blocks", "")
    assert kernel_tests.mmd_tests(e, [], "side", [("a-b", "a", "b")], "v", "id", permutations=3, block=8).count() == 1
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("blocks") for s in status.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) == 13 * 14 // 2


def test_rankings_of_queries_by_ranges_make_no_row_for_each_pair(spark):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(400, 3)), 1)
    x[50:120] = x[0]  # copies: ties
    kinds = [None if i % 17 == 0 else int(i % 3) for i in range(400)]
    e = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, kinds, strict=True))] + [(1000, None, 1), (1001, [None, 0.0, 0.0], 1)], "id long, v array<float>, label int").repartition(3)
    got = evaluation.retrieval_precision(e.where("id % 40 = 0"), e, "id", "label", "v", 50, 3, 60, 70)
    assert "NestedLoop" not in plan(got)
    found = {a.id: a.ap for a in got.collect()}
    y = x.astype(np.float32).astype(float)
    for i in range(0, 400, 40):
        pairs = [(((y[j] - y[i]) ** 2).sum(), kinds[i] is not None and kinds[j] == kinds[i]) for j in range(400) if j != i]
        total = sum(ok for _, ok in pairs)
        want = sum(sum(o for e, o in pairs if e <= d) / sum(e <= d for e, _ in pairs) for d, ok in pairs if ok) / total if total else None
        assert found.pop(i) == (want if want is None else pytest.approx(want))
    assert not found


@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_permuted_ranks_travel_as_arrays(spark, chunk):
    rows = spark.range(300).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 7 % 31).alias("x"), (F.col("id") % 31 + F.col("id") % 5).alias("y"))
    got = {r.g: r for r in signals.rank_correlation_test(rows, ["g"], "x", "y", "id", 20, chunk=chunk).collect()}
    want = {r.g: r for r in signals.rank_correlation_test(rows, ["g"], "x", "y", "id", 20).collect()}
    assert {g: (r.n, round(r.rho, 12), r.p) for g, r in got.items()} == {g: (r.n, round(r.rho, 12), r.p) for g, r in want.items()} and len(got) == 2
