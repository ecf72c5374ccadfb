import heapq
import random
from fractions import Fraction

from tracklake.llm.mixing import mix_sources, schedule


def earliest_deadline_first(ks):
    """Slot by slot with a heap: (source, turn) of every slot."""
    period, released, out = sum(ks), [], []
    jobs = sorted((j * period // k, -(-(j + 1) * period // k), i, j) for i, k in enumerate(ks) for j in range(k))
    at = 0
    for t in range(period):
        while at < len(jobs) and jobs[at][0] <= t:
            heapq.heappush(released, jobs[at][1:])
            at += 1
        out.append(heapq.heappop(released)[1:])
    return out


def test_halving_gives_the_slots_of_a_heap(spark):
    draw = random.Random(3)
    for ks in ([1], [7], [1] * 40, [900, 1, 1, 1, 97], [draw.randint(1, 4) for _ in range(90)], [draw.randint(1, 30) for _ in range(17)], [1] * 60 + [130, 66]):
        sources = spark.createDataFrame(list(enumerate(ks)), "i long, k long")
        want = earliest_deadline_first(ks)
        for leaf in (1, 8, 1024) if len(ks) > 80 else (8,):
            got = {r.place: (r.i, r.turn) for r in schedule(sources, sum(ks), leaf).collect()}
            assert [got[t] for t in range(sum(ks))] == want and len(got) == sum(ks)


def test_more_sources_than_fit_in_a_period(spark):
    """3,000 sources, so 12,000 slots, most sources with one row; 5,000 rows in one of them."""
    n = [5000] + [1 + (s % 37 == 0) * 40 for s in range(1, 3000)]
    docs = spark.createDataFrame([(3000 * j + s, f"s{s:04}") for s, m in enumerate(n) for j in range(m)], "doc_id long, source string")
    got = mix_sources(docs, dict.fromkeys((f"s{s:04}" for s in range(3000)), 1.0), block=4).collect()
    got.sort(key=lambda g: g.position)
    assert len(got) == sum(n) and [g.position for g in got] == list(range(sum(n)))
    slots = [g.slot for g in got]
    assert slots == sorted(slots) and len({(g.slot, g.source_key, g.block) for g in got}) == len(set(slots))
    assert all(g.release <= g.slot < g.deadline for g in got)
    # equal weights: four slots each, so every source has a first block among the first 3,000 slots
    assert {g.source for g in got if g.slot < 3000} == {f"s{s:04}" for s in range(3000)}


def test_every_prefix_is_on_target(spark):
    rows = [(i, s, 1) for s, n in (("a", 900), ("b", 300), ("c", 20), (None, 50), ("", 7)) for i in range(n)] + [(None, "a", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot int")
    weights = {"a": 5, "b": 3, "c": 0.1, None: 2}
    got = mix_sources(docs, weights, block=4, period=100).collect()
    assert len(got) == len(rows) and [c for c in got[0].asDict()][:2] == ["doc_id", "source"]
    got.sort(key=lambda g: g.position)
    assert [g.position for g in got] == list(range(len(rows)))
    slots = {}
    for g in got:
        slots.setdefault((g.slot, g.block, g.source_key), []).append(g)
        assert g.release <= g.slot < g.deadline
    assert len(slots) == len({s for s, _, _ in slots})
    k = {s: sum(1 for (t, _, x) in slots if x == s and t < 100) for s in ("=a", "=b", "=c", "null", "=")}
    dry = max(g.slot for g in got if g.on_target)
    taken = dict.fromkeys(k, 0)
    of = {t: s for t, _, s in slots}
    assert k["="] <= 2
    for t in range(min(dry, 99)):  # within the first period k counts what was taken, so it is the weight only if no source ran dry
        taken[of[t]] += 1
        if dry >= 100:
            for s in k:
                assert abs(taken[s] - Fraction(k[s] * (t + 1), 100)) < 1


def test_default_weights_and_odd_tables(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, source string")).collect() == []
    got = mix_sources(spark.createDataFrame([(i, f"s{i % 3}") for i in range(500)], "doc_id long, source string"), block=1, period=30).collect()
    got.sort(key=lambda g: g.position)
    for i in range(0, 480):
        counts = [sum(g.source == f"s{j}" for g in got[: i + 1]) for j in range(3)]
        assert all(abs(c - (i + 1) / 3) < 1 for c in counts)
    one = mix_sources(spark.createDataFrame([(1, None)], "doc_id long, source string")).collect()
    assert [(g.seq, g.block, g.slot, g.position) for g in one] == [(0, 0, 0, 0)]


def test_many_sources_below_one_slot(spark):
    rows = [(100 * s + i, f"s{s:03}") for s in range(100) for i in range(60 if s < 20 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {f"s{s:03}": 1 + (s >= 10) for s in range(20)}
    for first in range(2):  # the excess must not fall on the source that sorts first, and neither on another
        given = weights if first else dict.fromkeys(weights, 1)
        got = mix_sources(docs, given, block=1, period=1000).collect()
        assert sorted(g.doc_id for g in got) == sorted(i for i, _ in rows)
        assert sorted(g.position for g in got) == list(range(len(rows)))
        assert all(g.release <= g.slot < g.deadline for g in got) and len({g.slot for g in got}) == len(rows)
        # block 0 is due by slot ceil(1000 / k)
        k = {g.source: 1000 / g.deadline for g in got if g.block == 0}
        for s in range(100):
            due = 1 if s >= 20 else 920 * given[f"s{s:03}"] / sum(given.values())
            assert abs(k[f"s{s:03}"] - due) < 3


def test_clashing_names(spark):
    names = ["k", "_k", "turn", "_order", "_bucket", "_before", "_round", "place", "given", "ns", "ks", "dry", "row", "id", "n"]
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", *[f"concat('{n}', {i}) AS `{n}`" for i, n in enumerate(names)])
    got = mix_sources(docs, bucket_rows=1).collect()
    assert len(got) == 200 and sorted(g.position for g in got) == list(range(200))
    assert all(g[n] == f"{n}{i}" for g in got for i, n in enumerate(names))


def test_sql_shares_slots_as_the_code_does(spark):
    """Four large sources and 246 with one row each: the least slots ask for more than there are."""
    import duckdb

    from tracklake.llm import mixing

    docs = spark.range(4 * 60_000 + 246).selectExpr("id AS doc_id", "if(id < 240000, concat('big', id % 4), concat('s', id)) AS source")
    pdf = docs.toArrow()
    c = duckdb.connect()
    c.register("documents", pdf)
    columns = ["doc_id", "source", "seq", "block", "release", "deadline", "slot", "position", "on_target"]
    names = [d[0] for d in c.execute(mixing.SQL + " LIMIT 0").description]
    want = sorted(tuple(r[names.index(n)] for n in columns) for r in c.execute(mixing.SQL).fetchall())
    got = sorted(tuple(r) for r in mixing.mix_sources(docs).select(*columns).collect())
    assert got == want
    # the case is the one that is meant
    share = 60_000**0.5 / (4 * 60_000**0.5 + 246) * 1000
    assert 4 * int(share) + 246 > 1000
