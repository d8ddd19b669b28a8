"""Writing: inserts that pass over known keys, whole-batch updates, and results kept under a fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table at ``path`` lacks, one for each key; returns the table."""
    fresh = rows.dropDuplicates(keys)
    known = existing(rows.sparkSession, path)
    if known is not None:
        fresh = fresh.join(known.select(keys), keys, "left_anti").select(known.columns)
    fresh.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def manifest_errors(table: DataFrame, manifest: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, fault) of a manifest (id, code): ids that repeat or that ``table`` (id) lacks, codes that ``vocabulary`` (code) lacks."""
    repeated = manifest.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated").alias("fault"))
    unknown = manifest.join(table.select("id"), "id", "left_anti").select("id", F.lit("unknown id").alias("fault"))
    strange = manifest.join(vocabulary.select("code"), "code", "left_anti").select("id", F.lit("unknown code").alias("fault"))
    return repeated.unionByName(unknown).unionByName(strange)


def updated(table: DataFrame, manifest: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``table`` (id, code, others) with the codes of the manifest; refuses the whole batch when any row is at fault."""
    faults = manifest_errors(table, manifest, vocabulary)
    if not faults.isEmpty():
        raise ValueError(f"manifest refused: {faults.orderBy('fault', 'id').first().asDict()}")
    new = manifest.select("id", F.col("code").alias("new_code"))
    return table.join(new, "id", "left").withColumn("code", F.coalesce("new_code", "code")).select(table.columns)


def kept_result(spark: SparkSession, folder: str, fingerprint: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A result kept under the fingerprint of what it was made from; made once, read from then on."""
    path = f"{folder.rstrip('/')}/{fingerprint}"
    known = existing(spark, path)
    if known is None:
        compute().write.mode("overwrite").parquet(path)
        known = spark.read.parquet(path)
    return known


#: First bytes of the file types that are taken, in hexadecimal, and the largest size.
MAGIC = {"pdf": "25504446", "docx": "504B0304", "png": "89504E47", "jpg": "FFD8FF"}
LARGEST = 50 << 20


def file_fault(name: str, content: str) -> Column:
    """Why a file (name, content) is refused: empty, too large, a type not taken, or other bytes than its name says."""
    kind = F.replace(F.lower(F.substring_index(name, ".", -1)), F.lit("jpeg"), F.lit("jpg"))
    head = F.hex(F.substring(content, 1, 4))
    wrong = F.coalesce(*[F.when(kind == k, ~head.startswith(v)) for k, v in MAGIC.items()])
    size = F.length(content)
    return (
        F.when(F.col(content).isNull() | (size == 0), "empty_file")
        .when(size > LARGEST, "file_too_large")
        .when(~kind.isin(*MAGIC), "unsupported_type")
        .when(wrong, "content_mismatch")
    )
