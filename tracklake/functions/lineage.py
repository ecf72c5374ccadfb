"""Cutting lineage, and running sums over whole tables without one large window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Narrow rows that are broadcast at most.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on this machine alone gets one of its own; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracklake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that plans of loops don't grow and a lost executor costs nothing."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def if_few(rows: DataFrame) -> DataFrame:
    """Narrow rows for a join: broadcast only if they are counted as few."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds running sums (new column -> summed column) in `order` within keys; rows must be distinct on keys and order.

    Rows are dealt by ranges of keys and order; each range is summed by itself and gets what the ranges before it hold. So a group, or a
    table without keys, may be of any size.
    """
    r = cut(rows.repartitionByRange(*keys, F.col(order).desc() if descending else F.col(order)).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = r.groupBy(*keys, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select(*keys, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    own = Window.partitionBy("_part", *keys).orderBy(F.col(order).desc() if descending else F.col(order))
    same = F.col("a._part") == F.col("b._part")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    r = r.withColumns({n: F.sum(c).over(own) for n, c in sums.items()})
    out = r.alias("a").join(totals.alias("b"), same)
    return out.select(*[F.col(f"a.{c}") for c in rows.columns], *[(F.col(f"a.{n}") + F.col(f"b._before_{n}")).alias(n) for n in sums])
