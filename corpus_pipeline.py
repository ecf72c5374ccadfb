"""From raw documents to packed sequences: toxicity, exact and near copies, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.common import new_path, table
from tracklake.llm.exact_dedup import exact_dedup, normalized
from tracklake.llm.minhash_dedup import minhash_dedup
from tracklake.llm.mixing import mix_sources
from tracklake.llm.packing import pack_documents
from tracklake.llm.toxicity import fit_toxicity, score_toxicity

#: SQL has no character n-gram classifier and no tokenizer; tests/llm checks the stages against plain Python.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learnt from the labelled ones, is below one half. Null and empty texts are scored without features; an empty table stays empty."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    own = {c: f"documents' {c}" for c in ("score", "predicted") if c in docs.columns}  # the stage's results have these names
    kept = score_toxicity(docs.withColumnsRenamed(own), model).where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that are equal but for white space; null texts count as empty ones, and null ids are ids. An empty table stays empty."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
    # the caller's row goes along in one column, so that its names can't clash
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("own", F.sha2(normalized(F.col("row.text")), 256))
    rows = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")))
    # repeated rows of one id: the longest, as exact_dedup has it
    first = F.row_number().over(Window.partitionBy("row.doc_id", "own").orderBy(F.length("row.text").desc_nulls_last()))
    return rows.withColumn("place", first).where("place = 1").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, 80 %. Null and empty texts and null ids are near nothing and stay. An empty table stays empty."""
    kept = minhash_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; the part files follow each other in it, and so do the rows in each."""
    mixed = mix_sources(docs).repartitionByRange("position").sortWithinPartitions("position")
    return mixed.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences. Groups are runs of the table's rows as its files have them, so sequences keep the mix."""
    import public_tokenizers

    rows, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")), F.lit(0))).first()
    run = max(1, 4_000_000 * rows // max(chars, 1))
    try:
        number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        docs = docs.select("doc_id", "text", (number * 100_000 + F.expr(f"_metadata.row_index div {run}")).alias("run"))
        column: str | None = "run"
    except AnalysisException:  # not a table of files
        column = None
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), group_col=column)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
