"""Exact deduplication by skew-safe combining (operator 7), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.common import materialize, table

#: Of the winners' scores: code points * BASE + how small the id is; a decimal can be aggregated by hashing.
_BASE = "cast('100000000000000000000' as decimal(21,0))"
_TOP = "cast('9223372036854775807' as decimal(20,0))"


def normalized(text: Column) -> Column:
    """The text without any of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, hot_share: float = 1e-4, digest=lambda norm: F.sha2(norm, 256)) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Equal texts are combined three times, and the whole normalised text is a grouping key each time: within each map
    task (Spark's partial aggregation), within (digest, salt), and over the salts' winners of a digest. The salt comes from the id, so a text that a third of the rows
    share meets in `salts` places and then as that many rows. Rows then look their group up by digest. Groups with over
    `hot_share` of all rows, of which there are at most 1 / hot_share, are broadcast; the others are joined.
    If different texts have one digest, that look-up compares the texts too.

    The row with the most code points stays, then the smallest id; a null id comes last. Null texts are empty ones, and
    empty texts are equal. Of repeated rows that tie (same id and length), one is kept, and each is returned. An empty
    table gives no rows. Other columns of docs aren't read, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.length("text").alias("chars"), normalized(F.col("text")).alias("norm"))
    rows = rows.select("*", digest(F.col("norm")).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    rank = F.expr(f"cast(cast(chars as decimal(12,0)) * {_BASE} + coalesce({_TOP} - cast(id as decimal(20,0)) + 1, 0) as decimal(38,0))")
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max(rank).alias("best"), F.count("*").alias("n"))
    whole = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    texts = F.count("*").over(Window.partitionBy("digest"))
    whole = whole.withColumn("texts", texts).select(
        "digest", "n", "texts", F.when(F.col("texts") > 1, F.col("norm")).alias("norm"),
        F.expr(f"cast({_TOP} - nullif(cast(best % {_BASE} as decimal(21,0)), 0) + 1 as bigint)").alias("keep_id"),
        F.expr(f"cast(floor(best / {_BASE}) as int)").alias("keep_chars"),
    )
    groups = materialize(whole, "exact-groups")
    total, most = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("texts")).first()
    if (most or 0) > 1:  # different texts with one digest: the text decides
        held = groups.select(F.col("digest").alias("g_digest"), F.col("norm").alias("g_norm"), "n", "keep_id", "keep_chars")
        found = rows.withColumn("key", F.col("digest")).join(held, (F.col("digest") == F.col("g_digest")) & (F.col("g_norm").isNull() | (F.col("norm") == F.col("g_norm"))))
        same = Window.partitionBy("key", "norm", "id").orderBy(F.desc("chars"))
    else:
        hot = F.col("n") > max(1.0, total * hot_share)
        few = groups.where(hot).select("digest", F.col("n").alias("hot_n"), F.col("keep_id").alias("hot_id"), F.col("keep_chars").alias("hot_chars"))
        rest = groups.where(~hot).select(F.col("digest").alias("key"), "n", "keep_id", "keep_chars")
        found = rows.select("id", "chars", "digest").join(F.broadcast(few), "digest", "left")
        found = found.withColumn("key", F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(F.concat(F.lit("row "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), F.col("digest"))))
        found = found.join(rest, "key", "left").withColumns({"n": F.coalesce("hot_n", "n"), "keep_chars": F.coalesce("hot_chars", "keep_chars"), "keep_id": F.when(F.col("hot_n").isNull(), F.col("keep_id")).otherwise(F.col("hot_id"))})
        same = Window.partitionBy("key", "id").orderBy(F.desc("chars"))
    return found.withColumn("place", F.row_number().over(same)).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & (F.col("place") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
