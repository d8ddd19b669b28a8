"""Tables in versions: an update is whole or not at all, and readers see the last version that was finished.

A version is a small file that names the folders of its rows; it is written last, under
the next number, and never over another one. So a reader during an update, or after one
that failed, reads the version before, and of two updates of one version one is refused.
An append adds a folder; an update writes the table anew beside the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another update has made the next version."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, folder: str) -> list[int]:
    files, place = _files(spark, f"{folder.rstrip('/')}/versions")
    return sorted(int(s.getPath().getName()) for s in files.listStatus(place) if s.getPath().getName().isdigit()) if files.exists(place) else []


def _parts(spark: SparkSession, folder: str, version: int) -> list[str]:
    rows = spark.read.text(f"{folder.rstrip('/')}/versions/{version}").collect()
    return [r.value for r in rows if r.value]


def read_version(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one if none is named; none before the first."""
    version = max(versions(spark, folder), default=None) if version is None else version
    parts = _parts(spark, folder, version) if version is not None else []
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder.rstrip('/')}/data/{p}" for p in parts])


def _commit(spark: SparkSession, folder: str, version: int, parts: list[str]) -> int:
    files, place = _files(spark, f"{folder.rstrip('/')}/versions/.{uuid.uuid4().hex}")
    out = files.create(place, False)
    out.write(bytearray("\n".join(parts).encode()))
    out.close()
    # a rename does not replace a version that is there
    _, final = _files(spark, f"{folder.rstrip('/')}/versions/{version}")
    if files.exists(final) or not files.rename(place, final):
        files.delete(place, False)
        raise Conflict(f"version {version} of {folder} is there")
    return version


def _written(rows: DataFrame, folder: str) -> str:
    name = uuid.uuid4().hex
    rows.write.parquet(f"{folder.rstrip('/')}/data/{name}")
    return name


def append_absent(rows: DataFrame, folder: str, schema: str, keys: list[str]) -> int:
    """A version that has those ``rows`` as well whose keys were not there, one for each key; returns its number.

    Of rows with one key the least counts. Null keys are keys.
    """
    spark = rows.sparkSession
    last = max(versions(spark, folder), default=0)
    names = read_version(spark, folder, schema, last or None).columns
    known = read_version(spark, folder, schema, last or None).select(*[F.col(k).alias(f"_{k}") for k in keys]) if last else None
    fresh = rows.select(names).groupBy(*keys).agg(F.min(F.struct(*[c for c in names if c not in keys] or keys)).alias("_rest"))
    fresh = fresh.select(*[F.col(c) if c in keys else F.col(f"_rest.{c}").alias(c) for c in names])
    if known is not None:
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        condition = same[0]
        for x in same[1:]:
            condition &= x
        fresh = fresh.join(known, condition, "left_anti")
    return _commit(spark, folder, last + 1, [*(_parts(spark, folder, last) if last else []), _written(fresh, folder)])


def update_columns(rows: DataFrame, folder: str, schema: str, key: str) -> int:
    """A version in which the columns of ``rows`` besides ``key`` have its values where the key is the same; all others stay as they are.

    Keys that are not in the table change nothing; a key that ``rows`` has twice is an error.
    """
    spark = rows.sparkSession
    last = max(versions(spark, folder), default=0)
    table = read_version(spark, folder, schema, last or None)
    twice = rows.groupBy(key).count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"{key} {twice[key]} is there twice")
    changed = [c for c in rows.columns if c != key]
    new = rows.select(F.col(key).alias("_key"), F.struct(*changed).alias("_new"))
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    columns = [F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in table.columns]
    return _commit(spark, folder, last + 1, [_written(joined.select(columns), folder)])
