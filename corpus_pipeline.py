"""A corpus pipeline: quality classifier, near-duplicate groups, benchmark
decontamination, mixing to source weights and token output.

Each stage takes (spark, docs, sf_dir); ``docs`` is what the stage before it
kept. All but the last return the columns of ``documents``.

Every stage takes null and empty texts, texts of any length, rows without an
id, repeated rows, an empty table and further columns of any name, which it
passes on; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mixing, near_join, quality, token_output
from quarry.llm.queries import tokenizer_path
from quarry.tables import new_path, scope


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text scores the share of good rows among the labelled ones,
    repeated rows score alike, so they stay or go together.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_join.drop_near(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    A null or empty text has none and stays; repeated rows stay or go together.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights.

    A null source is a source, the last; a text without words counts nothing
    and is drawn like the others; repeated rows are drawn one by one, by a
    seeded order that ties don't change.
    """
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and a row per written document read back from them.

    A null or empty text has the end id alone; rows without an id come first;
    repeated rows are written once each.
    """
    return token_output.token_digest(docs, new_path(spark, "tokens"), tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: The classifier and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again;
    what a stage wrote on its way is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = new_path(spark, name)
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
