"""Pipeline over `documents`: rules, lines, near duplicates, benchmark passages, tokens.

Every stage takes all documents its predecessor kept and returns a table that is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import bpe, contamination, lines, minhash, quality
from vacantia.llm.queries import tokenizer_path
from vacantia.session import few, small_batches, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents no quality rule rejects."""
    small_batches(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those left without a word are dropped."""
    small_batches(spark)
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id."""
    small_batches(spark)
    repeats = minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("of")).distinct()
    repeats = stage(repeats, "repeats")
    # While the dropped ids are few they are sent to all tasks, so texts stay where they are.
    return docs.join(F.broadcast(repeats) if few(repeats) else repeats, docs["doc_id"] == repeats["of"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    small_batches(spark)
    return contamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the token ids, their number, and the text they decode to."""
    small_batches(spark)
    return bpe.encode(docs, tokenizer_path(), decoded="decoded").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL has no form of the edit-distance, component and tokenizer stages; tests hold the rows against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
