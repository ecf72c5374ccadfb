import pytest
from pyspark.sql import functions as F

from tracklake.operators import aggregates, index, joins, tracks


def test_index_has_the_fixed_columns_and_null_for_nan(spark):
    df = spark.createDataFrame([("c1", float("nan"), 3)], "cell_id string, y double, t long")
    out = index.conform(df)
    assert len(out.columns) == 38 and out.first().y is None and out.first().t == 3 and out.first().marker is None


def test_problems(spark):
    key = ["cell_id", "channel_name"]
    df = spark.createDataFrame([("a", "x", None), ("a", "x", None), ("a", "y", None)], "cell_id string, channel_name string, fov string")
    got = {(r.problem, r.detail) for r in index.problems(df, [*key, "fov", "well"], key).collect()}
    assert got == {("missing column", "well"), ("duplicate key", "a|x"), ("all null", "fov")}
    assert index.problems(df.where("channel_name = 'y'").withColumn("fov", F.lit("f")), [*key, "fov"], key).collect() == []


def test_roots_survive_cycles_and_missing_parents(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 7)], "n long, p long")
    got = {r.n: r.root for r in index.roots(df, "n", "p", most=5).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 7)} == {1: 1, 2: 1, 3: 1, 4: 4, 7: 7} and {5, 6} <= got.keys()


def test_clamping(spark):
    df = spark.createDataFrame([(0, 50.0, 50.0), (1, 5.0, 50.0), (2, 30.0, 50.0), (3, -1.0, 5.0), (4, 100.0, 50.0)], "i int, y double, x double")
    args = (df, "y", "x", F.lit(100.0), F.lit(100.0), (64, 64))
    assert {r.i: r.y_clamp for r in index.clamp_borders(*args).collect()} == {0: 50.0, 2: 32.0}
    assert {r.i for r in index.clamp_borders(*args, max_shift=0).collect()} == {0}


def test_merge_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    with pytest.raises(ValueError, match="left keys"):
        joins.merge_metrics(a, a.limit(1), ["k"])


def test_empty_bins_stay(spark):
    df = spark.createDataFrame([(0.5, True), (0.7, False), (2.5, True)], "t double, p boolean")
    got = aggregates.population_curve(df, "t", F.col("p"), 0.0, 4.0, 1.0).orderBy("bin").collect()
    assert [(r.n, r.n_positive, r.fraction) for r in got] == [(2, 1, 0.5), (0, 0, None), (1, 1, 1.0), (0, 0, None)]
    assert got[1].ci_low is None and 0 < got[0].ci_low < 0.5 < got[0].ci_high < 1


def test_runs_and_onsets(spark):
    df = spark.createDataFrame([(1, t, p) for t, p in enumerate([False, True, None, True, True, True, False])], "k int, t int, p boolean")
    assert {(r.start, r.stop, r.n) for r in tracks.runs(df, ["k"], "t", F.col("p")).collect()} == {(1, 1, 1), (3, 5, 3)}
    assert tracks.first_run(df, ["k"], "t", F.col("p"), 2).first().t_run == 3
    assert tracks.first_run(df, ["k"], "t", F.col("p"), 4).collect() == []


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    a = index.capped_sample(df.repartition(1), ["g"], "id", 20, "s").select("id").collect()
    b = index.capped_sample(df.repartition(9), ["g"], "id", 20, "s").select("id").collect()
    assert sorted(a) == sorted(b) and len(a) == 140
    n = index.stratified_sample(df, "g", "id", 1500, "s").groupBy("g").agg(F.sum("copies")).collect()
    assert sorted(r[1] for r in n) == [214] * 6 + [216]
