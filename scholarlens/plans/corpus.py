"""Corpus queries: subject trends first, the rest of the repository reports follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.registry import query

SUBJECT_TRENDS_SQL = """
WITH reviewed AS (
  SELECT e.label AS subject, d.doc_id FROM documents d
  JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1
  JOIN embeddings e ON e.vec_id = d.doc_id
), counts AS (
  SELECT s.label AS subject, count(r.doc_id) AS n
  FROM (SELECT DISTINCT label FROM embeddings) s LEFT JOIN reviewed r ON r.subject = s.label
  GROUP BY s.label
), totals AS (SELECT sum(n) AS total, avg(n) AS mean FROM counts)
SELECT CAST(subject AS BIGINT) AS subject, CAST(n AS BIGINT) AS reviewed_count,
  CASE WHEN total = 0 THEN NULL WHEN n >= 1.5 * mean THEN 'SATURATED'
       WHEN n <= 0.5 * mean THEN 'UNDEREXPLORED' ELSE 'EMERGING' END AS trend
FROM counts, totals
"""


@query("subject_trends", SUBJECT_TRENDS_SQL)
def subject_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed documents of each subject, empty subjects included, with a trend class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("bigint").alias("subject")
    )
    counted = (
        docs.join(labels, "doc_id").join(vectors, "doc_id").groupBy("subject").agg(F.count("*").alias("n"))
    )
    subjects = vectors.select("subject").distinct().join(counted, "subject", "left")
    subjects = subjects.select("subject", F.coalesce("n", F.lit(0)).alias("reviewed_count"))
    totals = subjects.agg(F.sum("reviewed_count").alias("total"), F.avg("reviewed_count").alias("mean"))
    n = F.col("reviewed_count")
    trend = (
        F.when(F.col("total") == 0, F.lit(None).cast("string"))
        .when(n >= 1.5 * F.col("mean"), "SATURATED")
        .when(n <= 0.5 * F.col("mean"), "UNDEREXPLORED")
        .otherwise("EMERGING")
    )
    # totals is one row, so the cross join adds no rows
    return subjects.crossJoin(totals).select("subject", "reviewed_count", trend.alias("trend"))
