"""Clusters against plain loops over all pairs."""

import numpy as np
import pytest

from tracklake.operators import clusters
from tracklake.plans import cluster_queries


def plain_dbscan(keys, x, eps, least):
    near = clusters.distances(x, x) <= eps
    core = near.sum(1) >= least
    name = {}
    for i in sorted(range(len(keys)), key=lambda i: keys[i]):
        if core[i] and i not in name:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in name:
                    name[j] = keys[i]
                    todo += [int(k) for k in np.flatnonzero(near[j] & core)]
    for i in range(len(keys)):
        if not core[i]:
            name[i] = min((name[int(k)] for k in np.flatnonzero(near[i] & core)), default=None)
    return sorted((keys[i], name[i], bool(core[i])) for i in range(len(keys)))


def rows_of(seed, offset=0.0):
    r = np.random.default_rng(seed)
    parts = [r.normal(c, s, (n, 3)) for c, s, n in ((0, 0.3, 90), (3, 0.2, 60), (1.5, 1.5, 60))]
    line = np.stack([np.linspace(5, 9, 40), np.zeros(40), np.zeros(40)], 1)
    return np.concatenate([*parts, line, np.repeat(parts[0][:1], 30, 0), np.repeat([[50.0, 50, 50]], 7, 0), [[80.0, 0, 0]]]) + offset


@pytest.mark.parametrize(("seed", "cells", "block", "offset"), [(1, 1, 10_000, 0.0), (2, 7, 20, 0.0), (3, 40, 5, 1e6), (4, 500, 50, 0.0)])
def test_against_all_pairs(spark, seed, cells, block, offset):
    x = rows_of(seed, offset)
    keys = np.random.default_rng(seed).permutation(len(x)).tolist()
    rows = [(k, v.tolist(), "own", 1) for k, v in zip(keys, x, strict=True)]
    odd = [(1001, None, "own", 1), (1002, [1.0, float("nan"), 0.0], "own", 1), (1003, [float("inf"), 0.0, 0.0], "own", 1), (1004, [None, 0.0, 0.0], "own", 1)]
    df = spark.createDataFrame(rows + odd, "id long, x array<double>, v string, n int").repartition(4)
    got = sorted(tuple(r) for r in clusters.dbscan(df, "id", "x", 0.5, 5, cells, block).collect())
    want = plain_dbscan(keys, x, 0.5, 5)
    assert len({w[1] for w in want}) > 3 and any(w[1] is None for w in want) and any(w[1] is not None and not w[2] for w in want)
    assert got == want + [(k, None, False) for k in (1001, 1002, 1003, 1004)]


@pytest.mark.parametrize("hubs", [1, 5, 40])
def test_few_hubs_leave_the_rest_to_blocks(spark, hubs):
    x = rows_of(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    assert sorted(tuple(r) for r in clusters.dbscan(df, "id", "x", 0.5, 5, 6, 50, hubs).collect()) == plain_dbscan(list(range(len(x))), x, 0.5, 5)


def test_settled_points_do_not_meet_all_others(spark, monkeypatch):
    """Work in blocks is for open points only: none in a dense cloud, the few outside of it else."""
    asked, blocks = [], clusters._blocks
    monkeypatch.setattr(clusters, "_blocks", lambda points, *a: asked.append(points.where("asks").count()) or blocks(points, *a))
    cloud = np.random.default_rng(2).normal(0, 0.1, (3000, 8))
    df = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    assert {tuple(r)[1:] for r in clusters.dbscan(df(cloud), "id", "x", 1.0, 5, hubs=500).collect()} == {(0, True)} and not asked
    got = {r.id: (r.cluster, r.core) for r in clusters.dbscan(df([*cloud, np.full(8, 9.0)]), "id", "x", 1.0, 5, hubs=500).collect()}
    assert got[3000] == (None, False) and asked == [1, 1]


def test_within_decides_borders_from_differences():
    a = np.array([[1e6, 0.0], [1e6 + 3, 4.0], [0.0, 0.0]])
    assert clusters.within(a, a, 5.0).tolist() == (clusters.distances(a, a) <= 5.0).tolist() == [[True, True, False], [True, True, False], [False, False, True]]


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, x array<double>")
    assert clusters.dbscan(df, "id", "x").collect() == []
    lone = spark.createDataFrame([(1, [0.0]), (2, [9.0])], "id long, x array<double>")
    assert sorted(tuple(r) for r in clusters.dbscan(lone, "id", "x").collect()) == [(1, None, False), (2, None, False)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)] + [(300, 200), (300, 250)]
    got = {r.node: r.component for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 250: 200, 300: 200}


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = sorted((r.vec_id, r.cluster, r.core) for r in cluster_queries.embedding_clusters(spark, sf).collect())
    assert got == plain_dbscan([r.vec_id for r in rows], np.array([r.embedding for r in rows], float), cluster_queries.EPS, cluster_queries.LEAST)
    assert any(g[2] for g in got)
