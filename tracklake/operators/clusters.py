"""Density-based clusters of vectors, without a table of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions.lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): of every node of the edges the least node that it is linked with, directly or through others.

    Each round links every node's neighbours with the least of them (stars that shrink to one), and is written to the shared folder; it ends when a round changes no edge.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        ways = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        wide = ways.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        new = wide.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = cut(new.where("u <> v").distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    n, flat = len(column), (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(flat) // n if n else 0)


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(vectors, pivots)
    home = d.argmin(1)
    return home, d


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences, slice by slice: exact for equal vectors, and whatever their offset."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(2))
    return out


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs are within eps: by products of the centred vectors, and from differences where rounding could decide."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), bool) if a.shape[1:] != (0,) else np.ones((len(a), len(b)), bool)
    middle = b.mean(0)
    with np.errstate(all="ignore"):
        x, y = a - middle, b - middle
        p, q = (x * x).sum(1), (y * y).sum(1)
        d = p[:, None] + q - 2 * (x @ y.T) - eps * eps
        unsure = ~(np.abs(d) > 1e-15 * (a.shape[1] + 16) * (p[:, None] + q + eps * eps))
    near = d < 0
    i, j = np.nonzero(unsure)
    step = max(1, 4_000_000 // a.shape[1])
    for s in range(0, len(i), step):
        u, v = i[s : s + step], j[s : s + step]
        near[u, v] = np.sqrt(((a[u] - b[v]) ** 2).sum(1)) <= eps
    return near


def _slices(b: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose table of distances to `width` others stays small."""
    step = max(1, 4_000_000 // max(width, 1))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


class _Forest:
    """Union of numbers below n, each named by the least of its class."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _first(points: DataFrame, n: int) -> DataFrame:
    return points.orderBy(F.xxhash64("v"), "v").limit(n)


def _blocks(points: DataFrame, eps: float, cells: int, block: int) -> DataFrame:
    """Rows (cell, own, other, side, ...) such that each point that asks meets any point within eps once: all points are members (side 0) of their cell, in one of its
    blocks; those that ask are visitors (side 1) of every cell that has members within eps of them, as the triangle inequality allows. own and other are blocks of members
    and of visitors.
    """
    spark = points.sparkSession
    schema = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    cells = min(cells, max(1, -(-4 * points.count() // block)))  # cells of less than a quarter of a block save nothing
    pivots = _matrix(_first(points, cells).select("v").toArrow().column(0))
    width = len(pivots)
    if not width:
        return spark.createDataFrame([], f"cell int, own int, other int, side int, {schema}")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = np.zeros(width)
        size = np.zeros(width, np.int64)
        for b in batches:
            if b.num_rows:
                at, d = _nearest(_matrix(b.column(0)), pivots)
                np.maximum.at(radius, at, d[np.arange(len(at)), at])
                size += np.bincount(at, minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(radius), pa.array(size)], names=["cell", "radius", "size"])

    found = points.select("v").mapInArrow(home, "cell int, radius double, size long").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("size").alias("size")).collect()
    radius, size = np.zeros(width), np.zeros(width, np.int64)
    for r in found:
        radius[r.cell], size[r.cell] = r.radius, r["size"]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, d = _nearest(_matrix(b.column("v")), pivots)
                near = d <= radius[None, :] + eps * (1 + 1e-9) + 1e-9 * d
                near[:, size == 0] = False
                near[np.arange(len(at)), at] = True
                near[~b.column("asks").to_numpy(zero_copy_only=False)] = False
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array([np.flatnonzero(x) for x in near], pa.list_(pa.int32()))], names=[*b.schema.names, "home", "cells"])

    placed = cut(points.mapInArrow(visits, f"{schema}, home int, cells array<int>"))
    hosts = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("hosts"))
    calls = placed.where("asks").withColumn("cell", F.explode("cells")).drop("cells", "home")
    guests = calls.groupBy("cell").agg(F.count("*").alias("guests"))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    plan = F.broadcast(hosts.join(guests, "cell").select("cell", parts("hosts").alias("owns"), parts("guests").alias("others")))  # one row for each cell
    key = F.xxhash64("id").cast("decimal(20,0)")
    mine = placed.withColumnRenamed("home", "cell").join(plan, "cell").select("cell", F.pmod(key, F.col("owns")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), F.lit(0).alias("side"), *points.columns)
    theirs = calls.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("owns") - 1)).alias("own"), F.pmod(key, F.col("others")).cast("int").alias("other"), F.lit(1).alias("side"), *points.columns)
    return mine.unionByName(theirs)


def _in_block(table: pa.Table, eps: float) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Members, visitors, and which of them (visitor, member) are within eps."""
    side = table.column("side").to_numpy()
    own, guests = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    if not own.num_rows or not guests.num_rows:
        return own, guests, np.zeros((guests.num_rows, own.num_rows), bool)
    return own, guests, within(_matrix(guests.column("v")), _matrix(own.column("v")), eps)


def _classes(cores: DataFrame, eps: float, hubs: int) -> tuple[DataFrame, int]:
    """Core points with the class of the hubs that they are within eps of (null: of none), and the largest class. Hubs are core points, by hash; two hubs are
    of one class if core points that hubs are near lead from one to the other."""
    hub = _matrix(_first(cores, hubs).select("v").toArrow().column(0))
    n = len(hub)

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, out = _Forest(n), []
        for whole in batches:
            for b in _slices(whole, n):
                near = within(_matrix(b.column(0)), hub, eps)
                first = near.argmax(1)
                root = np.array([forest.root(k) for k in range(n)])
                for i, j in np.argwhere(near & (root[None, :] != root[first][:, None])).tolist():
                    if forest.join(int(first[i]), j):
                        out.append((int(first[i]), j))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int32()) for k in (0, 1)], names=["a", "b"])

    forest = _Forest(n)
    for r in cores.select("v").mapInArrow(ways, "a int, b int").distinct().collect():  # less than `hubs` rows a task
        forest.join(r.a, r.b)
    root = np.array([forest.root(k) for k in range(n)], np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, n):
                near = within(_matrix(b.column("v")), hub, eps)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(root[near.argmax(1)], pa.int32(), mask=~near.any(1))], names=[*b.schema.names, "class"])

    schema = ", ".join(f"`{c}` {t}" for c, t in cores.dtypes)
    placed = cut(cores.mapInArrow(place, f"{schema}, class int"))
    largest = placed.where("class IS NOT NULL").groupBy("class").count().orderBy(F.desc("count"), "class").first()
    return placed, largest["class"] if largest else -1


def dbscan(rows: DataFrame, key: str, vector: str, eps: float = 0.5, least: int = 5, cells: int = 256, block: int = 2000, hubs: int = 4096) -> DataFrame:
    """(key, cluster, core): core points have at least `least` points within eps (Euclidean, themselves included); core points within eps of each other are one cluster, named
    by its least core key; other points within eps of core points are in the cluster of these with the least name; the rest is noise, whose cluster is null.

    Equal vectors are one point with a weight, so copies cost one row. A point that has `least` points among `hubs` points (by hash) is core, and core points that hubs connect are of one
    class. What this leaves open is asked of all points: how many are near the points not settled as core, and which core points are near points that aren't core or are outside of
    the largest class. Those go to the cells of at most `cells` pivots that reach within eps of them and meet their members in blocks of at most about `block` members and visitors. Nothing is dropped
    or capped; the work is hubs times points, and open points times points where cells rule nothing out.

    Keys are whole numbers and distinct. Null vectors, and those with null or non-finite components, are noise. An empty table gives no rows. Only hubs, pivots,
    fewer than `hubs` links of hubs from each task, and a row for each cell come to the driver.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = rows.select(F.col(key).cast("long").alias("key"), v.alias("v"))
    points = cut(given.where(fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).groupBy("v").agg(F.min("key").alias("id"), F.count("*").alias("n")).select("id", "v", "n"))
    some = _first(points, hubs).select("v", "n").toArrow()
    hub, weight = _matrix(some.column("v")), some.column("n").to_numpy()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, len(hub)):
                open_ = within(_matrix(b.column("v")), hub, eps).astype(np.float64) @ weight < least
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(open_)], names=[*b.schema.names, "asks"])

    asked = cut(points.mapInArrow(settle, "id long, v array<double>, n long, asks boolean"))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        own, guests, near = _in_block(table, eps)
        n = near.astype(np.int64) @ own.column("n").to_numpy() if near.size else np.zeros(guests.num_rows, np.int64)
        return pa.Table.from_arrays([guests.column("id"), pa.chunked_array([pa.array(n, pa.int64())])], names=["id", "n"])

    points = asked.select("id", "v", (~F.col("asks")).alias("core"))
    if not asked.where("asks").isEmpty():
        counted = _blocks(asked, eps, cells, block).groupBy("cell", "own", "other").applyInArrow(count, "id long, n long").groupBy("id").agg((F.sum("n") >= least).alias("_core"))
        points = cut(points.join(counted, "id", "left").select("id", "v", F.coalesce("_core", "core").alias("core")))

    placed, largest = _classes(points.where("core"), eps, hubs)
    names = placed.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("name"))  # at most a row for each hub
    cores = cut(placed.join(F.broadcast(names), "class", "left").select("id", "v", F.lit(True).alias("core"), F.coalesce("name", "id").alias("name"), (F.coalesce("class", F.lit(-1)) != largest).alias("asks")))
    others = points.where("NOT core").select("id", "v", "core", F.col("id").alias("name"), F.lit(True).alias("asks"))

    def links(key: tuple, table: pa.Table) -> pa.Table:
        own, guests, near = _in_block(table, eps)
        near = near & own.column("core").to_numpy(zero_copy_only=False).astype(bool)[None, :] if near.size else near
        ids, at = np.unique(np.concatenate([guests.column("name").to_numpy(), own.column("name").to_numpy()]), return_inverse=True)
        a, b = at[: guests.num_rows], at[guests.num_rows :]
        core = guests.column("core").to_numpy(zero_copy_only=False)
        forest, out = _Forest(len(ids)), []
        for i in range(len(a)):
            for j in np.unique(b[near[i]]).tolist() if near.size else ():
                if not core[i] or forest.join(int(a[i]), j):  # a spanning forest of the block's core points
                    out.append((ids[a[i]], ids[j], bool(core[i])))
        types = [pa.int64(), pa.int64(), pa.bool_()]
        return pa.Table.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["id", "to", "core"])

    both = cores.unionByName(others)
    if both.where("asks").isEmpty():
        of = cores.select("id", "v", "core", F.col("name").alias("cluster"))
    else:
        found = cut(_blocks(both, eps, cells, block).groupBy("cell", "own", "other").applyInArrow(links, "id long, to long, core boolean"))
        joined = cut(components(found.where("core"), "id", "to").withColumnsRenamed({"node": "name", "component": "cluster"}))
        named = cores.select("id", "v", "core", "name").join(joined, "name", "left").select("id", "v", "core", F.coalesce("cluster", "name").alias("cluster"))
        border = found.where("NOT core").join(joined.withColumnRenamed("name", "to"), "to", "left").groupBy("id").agg(F.min(F.coalesce("cluster", "to")).alias("cluster"))
        of = named.unionByName(others.select("id", "v", "core").join(border, "id", "left"))
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    out = given.withColumn("w", F.when(fine, plain)).drop("v").join(of.select(F.col("v").alias("w"), "cluster", "core"), "w", "left")
    return out.select(F.col("key").alias(key), "cluster", F.coalesce("core", F.lit(False)).alias("core"))
