"""Tables as tracks, for the queries and for their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.operators import tracks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracks: user_id, frame t, value, event_type, and hours since the user's first event."""
    e = tracks.frames(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.withColumn("hours", (seconds - F.min(seconds).over(Window.partitionBy("user_id"))) / 3600)


def positive(label: str = "error") -> Column:
    return F.col("event_type") == label


#: The same in SQL.
EVENTS = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 / 3600 AS hours FROM events)"""


#: Customers as tracks with parents: every fifth has none.
def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey div 2 END")
    return table(spark, sf_dir, "customer").withColumn("parent", parent)


CUSTOMERS = "c AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey // 2 END AS parent FROM customer)"
