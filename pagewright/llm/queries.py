"""Registered queries of this subpackage: each applies one operator to whole tables of ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.chat_rotation import ROTATION_SQL, rotation_table
from pagewright.llm.conversation_repair import damage_report
from pagewright.llm.decontaminate import contamination
from pagewright.llm.edit_counts import edited_counts
from pagewright.llm.lexical_search import SEARCH_SQL, ranked_documents
from pagewright.llm.line_dedup import LINES_SQL, lines_digest
from pagewright.llm.near_dup import near_duplicates
from pagewright.llm.packing import pack
from pagewright.llm.pii import pii_digest
from pagewright.llm.secrets import secrets_digest
from pagewright.llm.substring_dedup import deduplicate
from pagewright.llm.token_store import training_order_digest
from pagewright.llm.weak_quality import quality_digest


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order_digest(_documents(spark, sf_dir))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(_documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(_documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(_documents(spark, sf_dir)).drop("kept")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_documents(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_digest(_documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def llm_queries() -> dict:
    own = [op1_decontamination, op2_training_order, op3_chat_rotation, op4_weak_quality, op5_secret_scan, op6_token_counts, op7_substring_dedup, op8_near_duplicates, op9_packing, op10_personal_data, op11_line_dedup, op12_lexical_search, op13_conversation_repair]
    return {f.__name__: f for f in own}


def llm_oracles() -> dict[str, str]:
    return {"op3_chat_rotation": ROTATION_SQL, "op11_line_dedup": LINES_SQL, "op12_lexical_search": SEARCH_SQL}
