"""Corpus views over the given tables: documents as works with title, program, year, keywords and review state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first works of the review state, as DuckDB SQL for the oracles; the same rules as works() below.
WORKS_SQL = r"""
works AS (
  SELECT d.doc_id AS id, d.text AS abstract,
    array_to_string((string_split_regex(trim(regexp_extract(d.text, '\S[^\n]*')), '\s+'))[1:12], ' ') AS title,
    d.lang AS program, d.source AS uploader, CAST(2015 + d.doc_id % 10 AS BIGINT) AS year,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id AS INT)) AS created_at,
    CASE WHEN l.quality = 1 THEN 'approved' WHEN l.quality = 0 THEN 'rejected' ELSE 'pending_review' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)
"""

KEYWORDS_SQL = r"""
tokens AS (
  SELECT id, created_at, program, status, regexp_extract_all(lower(abstract), '\p{L}{7,}') AS t FROM works
), keyworded AS (
  SELECT id, created_at, program, status, list_filter(t, lambda x, i: list_position(t, x) = i)[1:5] AS keywords FROM tokens
)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_of(text: str) -> Column:
    """The first twelve words of the first line that is not blank."""
    line = F.trim(F.regexp_extract(text, r"\S[^\n]*", 0))
    return F.array_join(F.slice(F.split(line, r"\s+"), 1, 12), " ")


def keywords_of(text: str) -> Column:
    """The first five distinct lower-case words of seven letters or more."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{7,}"), F.lit(0))), 1, 5)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; Catalyst prunes what a query does not read."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending_review")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("abstract"),
        title_of("text").alias("title"),
        F.col("lang").alias("program"),
        F.col("source").alias("uploader"),
        (F.col("doc_id") % 10 + 2015).alias("year"),
        (start + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"),
        status.alias("status"),
        keywords_of("text").alias("keywords"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject, vector): the embedding of a document and its subject code."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("subject"), F.col("embedding").alias("vector")
    )
