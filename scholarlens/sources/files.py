"""Files that are handed in or stored: what they are, whether they are taken, and manifests that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of file types, in hexadecimal.
SIGNATURES = {"pdf": "25504446", "docx": "504B0304", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF"}
MANUSCRIPTS, SCANS = ("pdf", "docx"), ("png", "jpeg", "pdf")
MANUSCRIPT_LIMIT = 25 << 20


def kind_named(name: str | Column) -> Column:
    """The type that a file's last extension names, "" without one; jpg is jpeg."""
    name = F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    return F.when(ext == "jpg", "jpeg").otherwise(ext)


def kind_held(content: str | Column) -> Column:
    """The type that a file's first bytes show, null for any other."""
    head = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 8))
    return F.coalesce(*[F.when(head.startswith(v), F.lit(k)) for k, v in SIGNATURES.items()])


def refused(name: str, content: str, kinds: tuple[str, ...], limit: int, by_content: bool = False) -> Column:
    """Why a file is refused, null if it is taken: MISSING_FILE, FILE_TOO_LARGE, FILE_TYPE_NOT_ALLOWED, FILE_CORRUPT or FILE_TYPE_MISMATCH, in that order.

    A manuscript must begin as its name says. A scan (``by_content``) is of the type
    that it begins as, if that is one of ``kinds``; bytes of no known type are corrupt.
    """
    named, held = kind_named(name), kind_held(content)
    taken = held.isin(*kinds) if by_content else held == named
    corrupt = F.when(held.isNull(), "FILE_CORRUPT") if by_content else F.lit(None).cast("string")
    return F.coalesce(
        F.when(F.col(content).isNull(), "MISSING_FILE"),
        F.when(F.length(content) > limit, "FILE_TOO_LARGE"),
        F.when(~named.isin(*kinds), "FILE_TYPE_NOT_ALLOWED"),
        corrupt,
        F.when(~F.coalesce(taken, F.lit(False)), "FILE_TYPE_MISMATCH"),
    )


def file_states(rows: DataFrame, name: str, listing: DataFrame) -> DataFrame:
    """``rows`` with ``file_state``: blank without a name, missing from the listing (path, length), empty, or present.

    The paths of the listing are unique; a file without a length is missing.
    """
    sizes = listing.select(F.col("path").alias("_path"), F.col("length").alias("_length"))
    joined = rows.join(sizes, F.col(name) == F.col("_path"), "left")
    state = (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "blank")
        .when(F.col("_length").isNull(), "missing")
        .when(F.col("_length") == 0, "empty")
        .otherwise("present")
    )
    return joined.withColumn("file_state", state).drop("_path", "_length")


def read_manifest(spark: SparkSession, path: str, schema: str, key: str, rows: int | None = None) -> DataFrame:
    """A JSON manifest of exactly ``rows`` rows with distinct keys; a manifest that is not so, or that cannot be read, is refused."""
    found = spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")
    counted = found.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).first()
    if rows is not None and counted["n"] != rows:
        raise ValueError(f"the manifest must hold exactly {rows} rows, it holds {counted['n']}")
    if counted["keys"] != counted["n"]:
        raise ValueError(f"keys of the manifest repeat or are null: {counted['keys']} of {counted['n']}")
    return found
