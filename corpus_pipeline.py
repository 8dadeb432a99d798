"""A training corpus from raw documents, stage by stage.

Each stage takes what the one before kept and returns documents; the last one returns their tokens. run()
writes each stage's result to the shared folder and reads it again for the next.

Cases: null, blank and short texts fail the quality rules; a null doc_id is kept like any other; of repeated rows one stays, as
of near copies; texts of any length are read whole; an empty table gives no rows; other columns, whatever their names, go
along unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import bpe, common, decontaminate, pii, quality_rules, simhash
from skyloom.llm.queries import TOKENIZER


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return pii.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, ids (little-endian unsigned 32-bit integers) and their digests."""
    return bpe.encode(docs, TOKENIZER).drop("decoded")


STAGES = [("quality_rules", rules), ("simhash", near_dedup), ("decontaminate", clean), ("pii", masked), ("bpe", tokens)]
#: SQL has no seeded shingle hash, quantile sketch or BPE: tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
