"""Corpus pipeline: stages that each apply one operator to all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import hyperminhash, packing, quality, secrets
from spanloom.llm.common import table
from spanloom.llm.queries import vocabulary
from spanloom.session import settle


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (four fifths of their runs of five words in common): the one with the smallest id."""
    return hyperminhash.keep_one(docs, share=80)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret found."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens, mixed by source."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality", good), ("near duplicates", single), ("secrets", masked), ("packing", pack)]
#: A trained model decides two stages, so no SQL gives the same rows; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
