"""Chains of parents and children, by pointer jumping: rounds grow as the logarithm of the longest chain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.sources.folders import stored


def families(links: DataFrame) -> DataFrame:
    """(id, root, depth) of ``links`` (id, parent): where each chain begins and how many links lead there.

    A row without a parent, or whose parent is no row, is a root of depth 0. Rows on a
    circle, or behind one, have no root: root and depth are null. Ids must be unique;
    rows without an id are left out. In each round a row that does not yet know its
    root takes over what its pointer points at, so distances double.
    """
    rows = links.filter("id is not null").select("id", "parent")
    ids = rows.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    rows = rows.join(ids, "parent", "left")
    up = F.when(F.col("there"), F.col("parent"))
    rows = stored(rows.select("id", up.alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps"), F.col("there").isNull().alias("done")), "chains")
    # a row is done once its pointer, if it has one, points at a root
    count = rows.count()
    for _ in range(math.ceil(math.log2(max(2, count))) + 1):
        open_ = rows.filter("not done")
        if open_.isEmpty():
            break
        target = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = open_.join(target, "up").select(
            "id", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done")
        )
        rows = stored(rows.filter("done").unionByName(moved), "chains")
    return rows.select("id", F.when(F.col("done"), F.coalesce("up", "id")).alias("root"), F.when(F.col("done"), F.col("steps")).alias("depth"))
