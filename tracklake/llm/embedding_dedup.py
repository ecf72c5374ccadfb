"""Near-duplicate embeddings by an inverted multi-index (operator 5)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.common import connected_components, in_batches, materialize, table


@dataclass
class MultiIndex:
    """Codebooks of the first and the second half of unit vectors, and how many cells a query visits."""

    first: np.ndarray
    second: np.ndarray
    cells: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of each vector to the centroids of their codebooks."""
        h = len(self.first[0])
        return tuple((y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1) for y, c in ((x[:, :h], self.first), (x[:, h:], self.second)))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(1), b.argmin(1)


def traverse(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """The multi-sequence algorithm: cells of the product grid in the order of a[i] + b[j]."""
    by_a, by_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b = a[by_a].tolist(), b[by_b].tolist()
    heap, done = [(a[0] + b[0], 0, 0)], [0] * len(a)  # done[i]: cells of row i that were visited
    while heap:
        _, i, j = heapq.heappop(heap)
        yield by_a[i], by_b[j]
        done[i] = j + 1
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids, in the order of their places along the direction in which they differ most, so that near ones have near numbers."""
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([((centers * centers).sum(1) - 2 * x[at : at + 8192] @ centers.T).argmin(1) for at in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.append(True, near[order][1:] != near[order][:-1]))
        used = near[order][first]
        sums = np.add.reduceat(x[order], first)
        centers = x[rng.integers(len(x), size=len(centers))]  # for codes that no vector is nearest to
        centers[used] = sums / np.diff(np.append(first, len(x)))[:, None]
    if not x.shape[1]:  # the second half of vectors of one component
        return centers
    spread = centers - centers.mean(0)
    return centers[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]


def fit_index(sample: np.ndarray, size: int, threshold: float, recall: float, rng: np.random.Generator, queries: int = 2000) -> MultiIndex:
    """Fits codebooks of `size` centroids, and the number of cells that finds the given share of test neighbours.

    Test neighbours lie exactly at the threshold, in random directions from sampled vectors: the hardest that must be found.
    """
    half = max(1, sample.shape[1] // 2)
    index = MultiIndex(k_means(sample[:, :half].copy(), size, rng), k_means(sample[:, half:].copy(), size, rng), 0)
    q = sample[rng.integers(len(sample), size=queries)]
    r = rng.normal(size=q.shape)
    r -= (r * q).sum(1)[:, None] * q
    r /= np.maximum(np.linalg.norm(r, axis=1), 1e-12)[:, None]
    a, b = index.distances(q)
    i, j = index.assign(threshold * q + np.sqrt(max(0.0, 1 - threshold**2)) * r)
    b_sorted = np.sort(b, axis=1)
    # how many cells are as near as the neighbour's, without the grid of all sums
    place = np.array([np.searchsorted(b_sorted[k], a[k, i[k]] + b[k, j[k]] - a[k] + 1e-12, "right").sum() for k in range(len(q))])
    index.cells = int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))))])
    return index


def _units(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64)
    x /= np.abs(x).max(1)[:, None]  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1))[:, None]


_ROW = "cls long, c1 int, c2 int, visits array<struct<c1: int, c2: array<int>>>"
_VISIT = pa.list_(pa.struct([("c1", pa.int32()), ("c2", pa.list_(pa.int32()))]))


def _prober(shared):
    """Of each class: its cell, and the cells that its traversal visits."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                dims = np.array(part.column("dim").to_pylist())
                for dim in np.unique(dims):
                    own = part.take(pa.array(np.flatnonzero(dims == dim)))
                    index = shared.value[int(dim)]
                    a, b = index.distances(_units(own.column("vector")))
                    for k, (cls, i, j) in enumerate(zip(own.column("cls").to_pylist(), a.argmin(1).tolist(), b.argmin(1).tolist(), strict=True)):
                        seen: dict[int, list[int]] = {}
                        for _, (c1, c2) in zip(range(index.cells), traverse(a[k], b[k]), strict=False):
                            seen.setdefault(c1, []).append(c2)
                        rows.append((cls, i, j, [{"c1": c1, "c2": c2} for c1, c2 in seen.items()]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int32(), _VISIT], strict=True)], names=["cls", "c1", "c2", "visits"])

    return probe


_FOUND = "cls long, links long, a long, b long"


def _connected(i: np.ndarray, j: np.ndarray, n_i: int, n_j: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the two sides of linked pairs: the least j of each one's connected part, by turns from one side to the other and back."""
    least, of_i = np.arange(n_j), np.zeros(n_i, np.int64)
    by_i, by_j = np.argsort(i, kind="stable"), np.argsort(j, kind="stable")
    first_i = np.flatnonzero(np.append(True, i[by_i][1:] != i[by_i][:-1]))
    first_j = np.flatnonzero(np.append(True, j[by_j][1:] != j[by_j][:-1]))
    while True:
        of_i[i[by_i][first_i]] = np.minimum.reduceat(least[j[by_i]], first_i)
        new = least.copy()
        new[j[by_j][first_j]] = np.minimum.reduceat(of_i[i[by_j]], first_j)
        if np.array_equal(new, least):
            return of_i, least
        least = new


def _verify(threshold: float):
    """Of a block of members and the probes that visit cells of it: how many links each has, and edges that connect what is linked.

    Members and visits are put in the order of cells, and each cell's members meet the probes that visit it, and no others.
    """

    def verify(_: tuple, rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        members, probes = rows.filter(pa.array(kind == 0)), rows.filter(pa.array(kind == 1))
        out: list[tuple[np.ndarray, ...]] = []
        if members.num_rows and probes.num_rows:
            m, p = _units(members.column("vector")), _units(probes.column("vector"))
            (m_cls, m_rep, m_n), (p_cls, p_rep, p_n) = ([t.column(c).to_numpy() for c in ("cls", "rep", "n")] for t in (members, probes))
            code = np.concatenate(members.column("codes").to_numpy()).astype(np.int64)
            visits = probes.column("codes").to_numpy()
            visitor, visited = np.repeat(np.arange(len(visits)), [len(v) for v in visits]), np.concatenate(visits).astype(np.int64)
            by_code, by_visit = np.argsort(code, kind="stable"), np.argsort(visited, kind="stable")
            code, visited, visitor = code[by_code], visited[by_visit], visitor[by_visit]
            cells = np.unique(code)
            m_cut = np.append(np.searchsorted(code, cells), len(code))
            p_from, p_to = np.searchsorted(visited, cells), np.searchsorted(visited, cells, "right")
            of_m, of_p, i, j = np.zeros(len(m), np.int64), np.zeros(len(p), np.int64), [], []
            for k in np.flatnonzero(p_to > p_from):
                mine = by_code[m_cut[k] : m_cut[k + 1]]
                for at in range(p_from[k], p_to[k], 1024):
                    own = visitor[at : min(at + 1024, p_to[k])]
                    # a pair is looked for from its smaller class, so that it counts once
                    hit = (p[own] @ m[mine].T >= threshold) & (p_cls[own][:, None] < m_cls[mine])
                    x, y = np.nonzero(hit)
                    if len(x):
                        of_p[own] += hit @ m_n[mine]
                        of_m[mine] += p_n[own] @ hit
                        if len(x) > len(own) + len(mine):  # a forest says as much as all pairs
                            up, least = _connected(x, y, len(own), len(mine))
                            some, others = np.unique(x), np.unique(y)
                            i.append(own[some])
                            j.append(mine[up[some]])
                            out.append((np.full(len(others), -1), np.zeros(len(others), np.int64), m_rep[mine[others]], m_rep[mine[least[others]]]))
                        else:
                            i.append(own[x])
                            j.append(mine[y])
            for cls, n in ((m_cls, of_m), (p_cls, of_p)):
                out.append((cls[n > 0], n[n > 0], np.full((n > 0).sum(), -1), np.full((n > 0).sum(), -1)))
            if i:
                i, j = np.concatenate(i), np.concatenate(j)
                up, least = _connected(i, j, len(p), len(m))
                for own, to in ((p_rep[np.unique(i)], up[np.unique(i)]), (m_rep[np.unique(j)], least[np.unique(j)])):
                    out.append((np.full(len(own), -1), np.zeros(len(own), np.int64), own, m_rep[to]))
        columns = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(4)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cls", "links", "a", "b"])

    return verify


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.995, sample: int = 20_000, block: int = 4096, seed: int = 7) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Rows with one label (not null) and vectors of one length are linked if their cosine, in double precision, is at least the threshold.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows with a null label
    or id. n_links counts other rows; component_id is the least id reachable. Repeated rows are vectors of their own with one id, and an
    id with several vectors or labels counts the links of each by itself, but is one id in components. An empty table
    gives no rows. Other columns aren't read.

    How: equal vectors of a label form a class, which is compared once. Unit vectors are cut in halves; each half has a codebook
    of about half the square root of the number of classes (4096 at most), fitted on `sample` classes or 64 for each code, whichever is more. A class
    lies in the cell of its two nearest centroids. Each class visits cells in the order of the sum of both distances, by the multi-sequence algorithm, as many as
    find the share `recall` of neighbours that lie just at the threshold; members of visited cells are then verified, and no others. Cells of a
    label whose first codes follow each other form blocks of about `block` members; a vector goes once to each block that it visits.
    Larger blocks are cut by members and by probes, so that no group of copies or label lands in one task. A
    block returns counts and the edges of a spanning forest, never its pairs.
    """
    spark = vectors.sparkSession
    clean = f"size({vector_col}) > 0 AND NOT exists({vector_col}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists({vector_col}, x -> x <> 0)"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.when(F.expr(clean), F.col(vector_col)).alias("vector"))
    # -0.0 and 0.0 are one value
    rows = materialize(rows.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast(_element(vectors, vector_col))).otherwise(x))), "vectors")
    whole = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    classes = whole.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("cls")), "vector-classes")
    own = materialize(whole.join(classes.select("label", "vector", "rep", "n", "cls"), ["label", "vector"]).select("id", "rep", "n", "cls"), "vector-own")

    rng, indexes = np.random.default_rng(seed), {}
    for dim, n in sorted((r.dim, r["count"]) for r in classes.groupBy("dim").count().collect()):
        size = int(min(4096, max(4, 2 ** np.ceil(np.log2(np.sqrt(n) / 2)))))
        picked = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("rep", "label"), "cls").limit(max(sample, 64 * size)).select("vector").toArrow()
        indexes[dim] = fit_index(_units(picked.column("vector")), size, threshold, recall, rng)
    if not indexes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(indexes)
    cells = materialize(classes.select("cls", "dim", "vector").transform(in_batches, _prober(shared), _ROW).join(classes.select("cls", "label", "dim"), "cls"), "vector-cells")
    place = ["label", "dim", "block"]
    before = Window.partitionBy("label", "dim").orderBy("c1").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("label", "dim", "c1").agg(F.count("*").alias("members"))
    blocks = blocks.withColumn("block", (F.coalesce(F.sum("members").over(before), F.lit(0)) / block).cast("int"))
    blocks = materialize(blocks.drop("members"), "vector-blocks")
    code = lambda c2: (F.col("c1").cast("long") * 4096 + c2)
    members = cells.join(blocks, ["label", "dim", "c1"]).select(*place, "cls", F.lit(0).alias("kind"), F.array(code(F.col("c2"))).alias("codes"))
    probes = cells.select("label", "dim", "cls", F.explode("visits").alias("v")).select("label", "dim", "cls", F.col("v.c1").alias("c1"), F.col("v.c2").alias("to")).join(blocks, ["label", "dim", "c1"])
    probes = probes.groupBy(*place, "cls").agg(F.flatten(F.collect_list(F.transform("to", code))).alias("codes")).select(*place, "cls", F.lit(1).alias("kind"), "codes")
    sent = materialize(members.union(probes), "vector-sent")
    sizes = sent.groupBy(*place).agg(F.ceil(F.sum(1 - F.col("kind")) / (2 * block)).alias("m_blocks"), F.ceil(F.sum("kind") / (8 * block)).alias("p_blocks")).where("m_blocks > 0 AND p_blocks > 0")
    spread = sent.join(materialize(sizes, "vector-sizes"), place)
    spread = spread.withColumn("m", F.expr("explode(if(kind = 0, array(pmod(xxhash64(cls), m_blocks)), sequence(0L, m_blocks - 1)))"))
    spread = spread.withColumn("p", F.expr("explode(if(kind = 1, array(pmod(xxhash64(cls, 1), p_blocks)), sequence(0L, p_blocks - 1)))"))
    spread = spread.join(classes.select("cls", "rep", "n", "vector"), "cls").select(*place, "m", "p", "kind", "cls", "rep", "n", "vector", "codes")
    found = materialize(spread.groupBy(*place, "m", "p").applyInArrow(_verify(threshold), _FOUND), "vector-found")
    counts = found.where("links > 0").groupBy("cls").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("links = 0 AND a <> b").select("a", "b").union(own.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))), "vector-components")
    per_row = own.join(counts, "cls", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    alone = rows.where("id IS NULL OR label IS NULL OR vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"))
    out = per_row.union(alone).join(parts.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_links", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _element(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.elementType.simpleString()


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
