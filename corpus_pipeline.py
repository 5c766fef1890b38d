"""The corpus pipeline: language ID, near duplicates, PII, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what
it returns is written as Parquet in the shared folder and read again as the next one's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakeframe.llm import common, op3_chosenpath, op5_langid, op6_pseudonyms, op7_packing, op8_mixing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go; the model is learned from the labelled ones."""
    return op5_langid.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return op3_chosenpath.deduplicated(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates, addresses and secrets get their pseudonyms."""
    return op6_pseudonyms.pseudonymise(docs, op6_pseudonyms.key_of(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return op8_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 ids."""
    return op7_packing.pack_documents(docs, special=True)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("pseudonyms", private_data),
    ("mixing", mixture),
    ("best_fit_packing", packing),
]

#: SQL can express neither language ID nor chosen paths nor packing; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
