"""What batches promise: sizes, pools, shares, seeds."""

from collections import Counter, defaultdict

from tracklake.operators.batches import STRIDES, numbered, sampled_batches


def anchors(spark, n=600):
    rows = [(i, "abc"[min(i % 10, 2)] if i % 10 < 3 else "a", f"m{i % 4}", float(i % 37), i % 7) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, s string, hours double, slot int").repartition(5)


def by_batch(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.batch].append(r)
    return out


def test_groups_and_leaks(spark):
    rows, df = anchors(spark)
    of = {r[0]: r[1] for r in rows}
    got = by_batch(sampled_batches(df, "id", 20, ["g"], leak=0.25, seed="x", replicas=4))
    assert sorted(got) == list(range(30))
    for b, drawn in got.items():
        group = {r.group for r in drawn}
        assert len(group) == 1 and len(drawn) == 20 and {r.replica for r in drawn} == {b % 4}
        own = [r for r in drawn if r.part == "primary"]
        assert len(own) == 15 and {of[r.id] for r in own} == group and len({r.id for r in own}) == 15
        leaks = [r.id for r in drawn if r.part == "leak"]
        assert len(leaks) == len(set(leaks)) == 5 and group.isdisjoint(of[i] for i in leaks)
    drawn = Counter(x[0].group for x in got.values())
    assert drawn["a"] > drawn["b"] + drawn["c"]  # four fifths of the rows


def test_small_pools_are_drawn_again(spark):
    df = spark.createDataFrame([(i, "big" if i < 95 else "tiny") for i in range(100)], "id long, g string")
    got = by_batch(sampled_batches(df, "id", 10, ["g"], weights={"tiny": 1.0}, seed="y"))
    assert len(got) == 10 and all({r.group for r in b} == {"tiny"} and len(b) == 10 for b in got.values())
    assert {r.id for b in got.values() for r in b} == set(range(95, 100))
    # one group only: nothing to leak, so batches are smaller
    alone = by_batch(sampled_batches(df.where("g = 'big'"), "id", 10, ["g"], leak=0.3, seed="y"))
    assert all(len(b) == 7 for b in alone.values())


def test_weights(spark):
    _, df = anchors(spark, 3000)
    got = by_batch(sampled_batches(df, "id", 10, ["g"], weights={"b": 3.0, "c": 1.0, "zzz": 9.0}, seed="z"))
    n = Counter(b[0].group for b in got.values())
    assert set(n) == {"b", "c"} and 190 < n["b"] < 260 and len(got) == 300


def test_strata_in_equal_numbers(spark):
    rows, df = anchors(spark)
    of = {r[0]: (r[1], r[2]) for r in rows}
    for group in (None, ["g"]):
        for b in by_batch(sampled_batches(df, "id", 22, group, stratum=["s"], seed="q")).values():
            n = Counter(r.part for r in b)
            there = sorted({s for g, s in of.values() if not group or g == b[0].group})
            each = 22 // len(there)
            assert [n[s] for s in there] == [each] * (len(there) - 1) + [22 - each * (len(there) - 1)]
            assert all(of[r.id][1] == r.part and (not group or of[r.id][0] == r.group) for r in b)


def test_focal_hours(spark):
    rows, df = anchors(spark)
    hour = {r[0]: r[3] for r in rows}
    focal_hours = set()
    for b in by_batch(sampled_batches(df, "id", 20, hours="hours", window=3.0, everywhere=0.3, seed="h")).values():
        focal = [hour[r.id] for r in b if r.part == "focal"]
        other = [hour[r.id] for r in b if r.part == "global"]
        assert len(focal) == 14 and len(other) == 6
        # some hour has all of the focal rows within the window and all of the others outside of it
        assert any(all(abs(h - c) <= 3 for h in focal) and all(abs(h - c) > 3 for h in other) for c in set(hour.values()))
        focal_hours.add(min(focal))
    assert len(focal_hours) > 5
    one = spark.createDataFrame([(i, 1.0) for i in range(40)] + [(40, None)], "id long, hours double")
    b = by_batch(sampled_batches(one.where("hours IS NOT NULL"), "id", 20, hours="hours", seed="h"))
    assert all(len(x) == 20 for x in b.values())  # no other hours: the rest comes from the whole group


def test_seed_and_epoch_decide(spark):
    _, df = anchors(spark)
    as_set = lambda d: sorted(map(tuple, d.collect()))
    first = as_set(sampled_batches(df, "id", 20, ["g"], seed="s"))
    assert first == as_set(sampled_batches(df.repartition(3), "id", 20, ["g"], seed="s"))
    assert first != as_set(sampled_batches(df, "id", 20, ["g"], seed="s", epoch=1)) and first != as_set(sampled_batches(df, "id", 20, ["g"], seed="t"))
    assert sampled_batches(df.limit(5), "id", 20, ["g"]).collect() == [] == sampled_batches(df.limit(0), "id", 20).collect()


def test_numbers_go_through_all_rows(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(500)], "k int").repartition(6)
    got = numbered(df, [df.k], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(500)) and [r.k for r in got] == sorted(i % 3 for i in range(500))
    assert len(STRIDES) == 16 and all(all(p % q for q in range(2, 1000)) for p in STRIDES)
