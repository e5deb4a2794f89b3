"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (
    chat,
    class_lm,
    decontaminate,
    embedding_dedup,
    line_dedup,
    mixing,
    near_join,
    packing,
    pii,
    quality,
    token_output,
    vector_clusters,
    vector_codes,
)
from quarry.llm.shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(_table(spark, sf_dir, "documents"), new_path(spark, "tokens"), tokenizer_path())


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(rows.unionByName(spark.createDataFrame(chat.EXTRA, rows.schema)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_groups(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_digest(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(_table(spark, sf_dir, "embeddings"))


def op12_vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_clusters.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_chat": op2_chat,
    "op3_near_join": op3_near_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_class_lm": op7_class_lm,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_vector_codes": op11_vector_codes,
    "op12_vector_clusters": op12_vector_clusters,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat": chat.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op5_mixing": mixing.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_vector_clusters": vector_clusters.ORACLE_SQL,
}
