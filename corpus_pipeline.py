"""A corpus pipeline of five stages, each applied to all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import exchange as ex
from sessionloom.llm.decontaminate import decontaminate
from sessionloom.llm.dedup import suffix_array_dedup
from sessionloom.llm.jaccard import ngram_jaccard
from sessionloom.llm.packing import best_fit_packing
from sessionloom.llm.quality import keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows without a doc_id can't be named later and go."""
    return keep_good(docs.where("doc_id is not null")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least doc_id; rows that repeat a doc_id with another text are judged by themselves."""
    docs = ex.by_row(docs)
    gone = ex.cut(ngram_jaccard(spark, docs.select(F.col("row_id").alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("row_id")))
    return ex.anti(docs, gone, "row_id", gone.count()).select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur earlier; documents of which nothing is left go.

    Where a cut falls inside a character, the rest of that character goes too.
    """
    kept = suffix_array_dedup(spark, docs, carry=("lang", "source", "n_chars"), decode=True)
    kept = kept.where("n_bytes = 0 or length(kept) > 0").withColumnRenamed("kept", "text")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; rows that repeat a doc_id with another text are judged by themselves."""
    docs = ex.by_row(docs)
    bad = ex.cut(decontaminate(spark, docs.select(F.col("row_id").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("row_id")).distinct())
    return ex.anti(docs, bad, "row_id", bad.count()).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: which words of which document go where."""
    return best_fit_packing(spark, docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]

#: The stages after the first can't be said in SQL that runs over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ex.cut(docs)
    return docs
