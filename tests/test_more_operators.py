import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import significance
from tracklake.sources import tables
from tracklake.streaming import tracks as stream


def test_rank_tests(spark):
    a, b = [1.0, 3.0, 3.0, 7.0, 9.0], [2.0, 3.0, 4.0, 4.0]
    df = spark.createDataFrame([("g", x, True) for x in a] + [("g", x, False) for x in b], "g string, v double, f boolean")
    got = significance.mann_whitney(df, ["g"], "v", "f").first()
    u = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b))
    assert got.u == u and got.n1 == 5 and 0.5 < got.p < 1
    w = significance.wilcoxon(spark.createDataFrame([("g", x) for x in (1.0, -2.0, 3.0, 4.0, 0.0, 5.0)], "g string, d double"), ["g"], "d").first()
    assert (w.n, w.w) == (5, 13.0) and 0.1 < w.p < 0.2
    f = significance.fisher(spark.createDataFrame([("g", True, True)] * 8 + [("g", True, False)] * 2 + [("g", False, True)] * 1 + [("g", False, False)] * 5, "g string, t boolean, p boolean"), ["g"], "t", "p").first()
    assert f.p == pytest.approx(0.0244755, abs=1e-6)


def test_mmd_tells_shifted_groups(spark):
    r = np.random.default_rng(0)
    rows = [(g, i, bool(i % 2), (r.normal(size=4) + (2.0 if g == "shifted" and i % 2 else 0.0)).tolist()) for g in ("same", "shifted") for i in range(80)] + [("tiny", 1, True, [0.0] * 4)]
    got = {x.g: x for x in significance.mmd_permutation(spark.createDataFrame(rows, "g string, i long, f boolean, v array<double>"), ["g"], "f", "v", "i").collect()}
    assert got["shifted"].p < 0.02 < got["same"].p and got["tiny"].mmd2 is None and got["shifted"].mmd2 > got["same"].mmd2


def test_tables(spark, tmp_path):
    tables.write_index(spark.createDataFrame([("c", "e", 1)], "cell_id string, experiment string, t int"), str(tmp_path / "i"))
    assert tables.read_index(spark, str(tmp_path / "i")).select("cell_id", "experiment", "t", "marker").collect() == [("c", "e", 1, None)]
    for fov in ("A/1/0", "A/1/1"):
        (tmp_path / "tracks" / fov).mkdir(parents=True)
        (tmp_path / "tracks" / fov / "t.csv").write_text("track_id,t,id,parent_track_id,parent_id,z,y,x\n1,0,7,,,0,1.5,2.5\n2,1,8,1.0,7.0,0,1,2\n")
    got = tables.read_tracking(spark, str(tmp_path / "tracks/*/*/*/*.csv")).orderBy("fov", "track_id").collect()
    assert [(r.fov, r.parent_track_id) for r in got] == [("A/1/0", None), ("A/1/0", 1), ("A/1/1", None), ("A/1/1", 1)]
    (tmp_path / "tracks/A/1/0/u.csv").write_text("track_id,t,id,parent_track_id,parent_id,z,y,x\n1,0,7,,,0,1.5,2.5\n")
    with pytest.raises(ValueError, match="several"):
        tables.read_tracking(spark, str(tmp_path / "tracks/*/*/*/*.csv"))
    store = str(tmp_path / "s")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(store)
    tables.upsert_columns(spark, store, spark.createDataFrame([(1, "z", 5)], "k int, v string, w int"), ["k"])
    assert sorted(spark.read.parquet(store).collect()) == [(1, "z", 5), (2, None, None)]
    assert "**5**" in tables.markdown(spark.read.parquet(store), {"w": False})
    (tmp_path / "b.json").write_text(json.dumps({"x": {"a": 1, "b": 2}, "_note": 1}))
    (tmp_path / "c.json").write_text(json.dumps({"base": "b.json", "x": {"b": 3}}))
    assert tables.merged_config(str(tmp_path / "c.json")) == {"x": {"a": 1, "b": 3}}
    (tmp_path / "d.json").write_text(json.dumps({"base": "d.json"}))
    with pytest.raises(ValueError, match="own base"):
        tables.merged_config(str(tmp_path / "d.json"))
    c = {"experiments": [{"name": "e", "data_path": "p", "channels": [{"name": "GFP"}], "perturbation_wells": {"zikv": ["B/1", "B/2"]}}]}
    assert tables.collection_tables(spark, c)["well"].count() == 2
    with pytest.raises(ValueError, match="unique"):
        tables.collection_tables(spark, {"experiments": c["experiments"] * 2})


def test_streams_agree_with_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", stream.window_counts(live, "ts", "event_type", "value", "1 day", "60 days"), "complete"), ("x", stream.first_crossings(live, "user_id", "ts", "value", 80.0), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    want = src.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()
    got = spark.table("w").select(F.to_date("start").alias("d"), "event_type", "n").collect()
    assert sorted(got) == sorted(want)
    first = spark.table("x").groupBy("user_id").agg(F.min("crossed").alias("c")).collect()
    assert sorted(first) == sorted(src.where("value >= 80").groupBy("user_id").agg(F.min("ts").alias("c")).collect())


def test_rank_significance_query(spark):
    """The query's p against its own U, by the normal approximation with ties and continuity."""
    import math

    from tracklake.plans import model_queries
    from tracklake.plans.common import events

    rows = {}
    for r in events(spark, "/root/testdata/sf0.001").collect():
        rows.setdefault(r.user_id, []).append((r.value, r.event_type == "error"))
    got = {r.user_id: r for r in model_queries.error_rank_significance(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(rows)
    for user, own in rows.items():
        a, b = [v for v, f in own if f], [v for v, f in own if not f]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        n, counts = len(own), [sum(v == w for w, _ in own) for v, _ in own]
        ties = sum(c * c - 1 for c in counts)
        sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1)))) if n > 1 else 0
        p = math.erfc(max(0.0, abs(u - len(a) * len(b) / 2) - 0.5) / sd / math.sqrt(2)) if a and b and sd else None
        assert got[user].u == u and (got[user].p is None if p is None else got[user].p == pytest.approx(p, abs=1e-6))
