"""Corpus pipeline: quality rules, near-duplicates, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import catalog, mixing, packing, quality, simhash
from marketloom.llm.common import staged, table

PERCENT = 90  # of the tokens that are left go into the mixture


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules and the thresholds of its language and source reject."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group: sets of five-word shingles, Jaccard similarity 0.8 or more."""
    return simhash.keep_one(docs, verified=True)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes PERCENT of the tokens, each document once, by the weights of domains, languages and sources."""
    return mixing.keep_mix(docs, F.expr(catalog.DOMAIN), catalog.WEIGHTS, PERCENT, catalog.SEED)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048."""
    return packing.pack_documents(docs, catalog.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # fingerprints, token ids and the packing are not for SQL; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs) if at < len(STAGES) - 1 else docs
    return docs
