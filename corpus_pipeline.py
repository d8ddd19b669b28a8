"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next one. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.llm.common import free_name, stored, table
from scholarlens.llm.decontam import leaks
from scholarlens.llm.near_dup import near_duplicates
from scholarlens.llm.packing import packed
from scholarlens.llm.quality import accepted
from scholarlens.llm.secrets import redacted

#: Similarity in percent from which the stage takes documents for near duplicates.
NEAR = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null texts are judged as empty ones; null ids may stay."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Documents without an id or without words belong to no group and stay; rows that
    repeat the id that stays all stay, as one document.
    """
    gone = near_duplicates(docs, NEAR).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. Rows are judged by their texts, so their ids may be null or repeated."""
    key = free_name("text_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = leaks(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every reported secret replaced by a mark and n_chars brought up to date."""
    return redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in packed sequences."""
    return packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL cannot express the trained classifier, the sketches, the templates and the packing; the tests hold near
#: duplicates against all pairs, packing against whole-text ids, and the other stages against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
