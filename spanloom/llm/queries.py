"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, chat, dialogs, hyperminhash, licenses, merkle, packing, quality, secrets, topk, urls, winnow, wrappers
from spanloom.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths, so each gets one from its source and id; every 64th is named as its folder's licence file."""
    at = F.col("doc_id")
    name = F.when(at % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(at.cast("string"), F.lit(".txt")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(at / 512).cast("string"), (F.floor(at / 64) % 8).cast("string"))
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", folder, name).alias("path"), "text")
    return licenses.scan(files, "path")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "position", F.length("token").cast("long").alias("n_chars"), F.sha2("token", 256).alias("token_sha256"), "probability", "is_secret")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.check_conversations(table(spark, sf_dir, "conversations"), vocabulary())


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_documents(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogs.report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_topk, op2_fingerprints, op3_near_duplicates, op4_packing, op5_url_filter, op6_licenses, op7_secret_scan, op8_main_text, op9_quality, op10_bpe, op11_chat_format, op12_merkle, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": topk.ORACLE_SQL, "op3_near_duplicates": hyperminhash.ORACLE_SQL, "op11_chat_format": chat.ORACLE_SQL, "op12_merkle": merkle.ORACLE_SQL, "op13_conversation_repair": dialogs.ORACLE_SQL}
