"""The cleaning pipeline over ``documents``; each stage is written as Parquet and read again.

Every stage but the last returns the columns of its input. A row is judged by its own text: rows without an identifier
are filtered like others, and a row does not go because another one with its identifier goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from tidewave.llm._shared import materialise, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest identifier stays."""
    found = exact_dedup.content_sort_dedup(docs, keep="largest")
    return found.where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least identifier stays (of several, the one whose text has the least hash)."""
    groups = materialise(jaccard_join.jaccard_groups(docs).where("n_links > 0").select("doc_id", "text_hash", "class_no"), "groups")
    # nulls last: a row without an identifier stays only where its whole group has none
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    gone = materialise(groups.join(groups.groupBy("class_no").agg(F.min(own).alias("kept")), "class_no").where(own != F.col("kept")).select("doc_id", "text_hash").distinct(), "gone")
    # the list of rejected rows is broadcast only where it is known to be small
    small = gone.count() <= jaccard_join.BROADCAST_ROWS
    rows, named = docs.alias("rows"), (F.broadcast(gone) if small else gone).alias("gone")
    same = F.col("rows.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id")) & (F.xxhash64(F.col("rows.text").cast("string")) == F.col("gone.text_hash"))
    return rows.join(named, same, "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", toxic_documents),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", best_fit_packing),
]

# Hashed models, signatures and tokenizers lie outside what SQL can state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
