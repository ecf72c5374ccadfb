import math
import random

import numpy as np

from tracklake.llm.embedding_dedup import embedding_dedup, fit_index, op5_embeddings, traverse


def brute(rows, threshold):
    good = [(i, k, np.array(v, float)) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    labels = [r[2] for r in rows]
    root, links = {r[0]: r[0] for r in rows}, [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, k, u) in enumerate(good):
        for j, m, v in good[x + 1 :]:
            if labels[k] == labels[m] and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                links[k] += 1
                links[m] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return links, find


def rows_of(n=900, dim=16):
    r = np.random.default_rng(5)
    centers, rows = r.normal(size=(60, dim)), []
    for i in range(n):
        v = centers[r.integers(60)] + r.normal(size=dim) * r.choice([0.02, 0.15, 0.25])
        rows.append((i, v.astype(np.float32).tolist(), int(r.integers(3))))
    rows += [(n + k, rows[0][1], rows[0][2]) for k in range(40)] + [(n + 50, [2 * x for x in rows[1][1]], rows[1][2])]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * 3, [1.0] * 3, [-0.0] * dim]
    rows += [(n + 100 + k, v, 1) for k, v in enumerate(bad)] + [(n + 200, rows[0][1], None), (None, rows[0][1], rows[0][2])]
    random.Random(1).shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    links, find = brute(rows, 0.93)
    want = {r[0]: (links[k], find(r[0])) for k, r in enumerate(rows)}
    exact = {g.vec_id: g for g in embedding_dedup(df, recall=1.0, block=64).collect()}
    assert {i: (g.n_links, g.component_id) for i, g in exact.items()} == want
    assert all(g.kept for g in exact.values() if g.vec_id == g.component_id) and len(exact) == len(rows)
    usual = {g.vec_id: g for g in embedding_dedup(df).collect()}
    assert sum(g.n_links for g in usual.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(g.n_links <= want[i][0] for i, g in usual.items())


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (1, [0.0, 1.0], 2), (5, [0.3, -1.0], 2), (1, [1.0, 0.0], 1), (6, [0.0, 2.0], 2)]
    links, find = brute(rows, 0.93)
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=1.0).collect()
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in got) == sorted((r[0], n, find(r[0])) for r, n in zip(rows, links, strict=True))


def test_recall_of_the_query(spark, tmp_path):
    """The query's own parameters, on a supplied table and neighbours of its vectors near the threshold, against all pairs within labels."""
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    r = np.random.default_rng(9)
    for i, v, label in rows[:2000]:
        u = np.array(v) / np.linalg.norm(v)
        away = r.normal(size=len(u))
        away -= (away @ u) * u
        rows.append((100_000 + i, (3 * (u + away / np.linalg.norm(away) * np.tan(np.arccos(r.uniform(0.931, 0.99))))).astype(np.float32).tolist(), label))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found, all_links = sum(g.n_links for g in op5_embeddings(spark, str(tmp_path)).collect()), 0
    for label in {x[2] for x in rows}:
        x = np.array([x[1] for x in rows if x[2] == label])
        x /= np.linalg.norm(x, axis=1)[:, None]
        all_links += int((x @ x.T >= 0.93).sum()) - len(x)
    assert 0.98 * all_links <= found <= all_links and all_links >= 4000


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup(spark.createDataFrame([], schema)).collect() == []
    got = embedding_dedup(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], schema)).collect()
    assert sorted((g.vec_id, g.n_links, g.component_id, g.kept) for g in got) == [(1, 0, 1, True), (2, 0, 2, True)]
    got = embedding_dedup(spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1), (3, [-1.0], 1)], schema)).collect()
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_traversal_visits_every_cell_in_order():
    r = np.random.default_rng(2)
    for a, b in ((3, 5), (1, 4), (6, 6)):
        x, y = r.integers(0, 5, a).astype(float), r.integers(0, 5, b).astype(float)
        seen = list(traverse(x, y))
        assert len(seen) == a * b == len(set(seen))
        sums = [x[i] + y[j] for i, j in seen]
        assert sums == sorted(sums)


def test_calibration_reaches_the_recall():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = fit_index(x, 16, 0.93, 0.95, r)
    assert 1 <= index.cells <= 256
    assert fit_index(x, 16, 0.93, 1.0, r).cells >= index.cells
