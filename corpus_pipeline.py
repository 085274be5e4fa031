"""The corpus-cleaning pipeline: five stages over the documents table, each written as Parquet and read again.

Every stage but the last returns the columns of documents. Only what a stage is meant to act on changes: rows with null
doc_ids pass the filters, and empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import langid, packing, quality, simhash, substring
from trackloom.llm.common import table
from trackloom.session import discard, made, materialize, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, learned from labels on these documents, predicts as good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified."""
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-copies (0.8 or more of five-word shingles)."""
    return simhash.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document holds; documents left without a word go."""
    out = substring.keep_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into bins."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: The learned stages can't be written in SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = made(spark)
        done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, done)  # what the stage wrote on its way
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
