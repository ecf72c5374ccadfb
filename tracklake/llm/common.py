"""Shared helpers of the training-data operators: shared tables, word hashing, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the controls \x09-\x0D.
SPACES = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset in a session on this machine alone (tests), one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracklake-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may be gone when the interpreter ends
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Narrow rows that are broadcast at most.
FEW = 200_000


def if_few(rows: DataFrame) -> DataFrame:
    """Narrow rows for a join: broadcast where they are counted as few, else joined by a merge, whose hot keys adaptive execution splits."""
    return F.broadcast(rows) if rows.count() <= FEW else rows.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM and by Python, going and coming.
_BATCH_ROWS = 1000


def in_batches(rows: DataFrame, function: Callable, schema: object) -> DataFrame:
    """mapInArrow, with a bound on what a batch of texts takes."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= _BATCH_ROWS:
        conf.set(key, str(_BATCH_ROWS))
    return rows.mapInArrow(function, schema)


class WordHashes(dict):
    """64-bit hashes of words (bytes). Words of up to 64 bytes are remembered, up to a bound, so memory is bounded whatever the texts."""

    bound = 400_000

    def hashed(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def __missing__(self, word: bytes) -> int:
        h = self.hashed(word)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kgram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of word hashes; empty if there are fewer than k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    return mix64(out)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Components of an undirected graph given as (a, b) long pairs: (node, component), component the smallest node.

    Alternating large-star and small-star rounds; each round is two aggregations and joins on the edge list, written to
    the shared folder. Nodes without edges don't appear. No edge list reaches the driver, only a count and a checksum.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # (u, v): v a neighbour of u. Large: every neighbour, larger ones move to the least; small: neighbours up to u.
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        # a sum that can't overflow and doesn't depend on the order of rows
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = mark(e)
    while before[0]:
        e = materialize(star(star(e, True), False), name)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
