"""How good a grouping is: agreement of two groupings, closeness within groups, and both over seeds and numbers of groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.operators.vectors import dot
from scholarlens.sources.folders import stored


def _pairs(n: str | Column) -> Column:
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    return n * (n - 1) / 2


def adjusted_rand(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n, ari: the adjusted Rand index of the groupings a and b of ``rows`` (a, b), apart for each value of ``by``.

    1 for equal groupings, about 0 for groupings by chance. It comes from the
    contingency table alone: rows are counted by (a, b) first. Rows that lack a group are
    left out. Where no pairs can differ (one group each, or all single) it is 1.
    """
    table = rows.filter("a is not null and b is not null").groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    both = table.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(_pairs("n")).alias("both"))
    left = table.groupBy(*by, "a").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs("n")).alias("left"))
    right = table.groupBy(*by, "b").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs("n")).alias("right"))
    sums = both.join(left, by).join(right, by)
    chance = F.col("left") * F.col("right") / _pairs("n")
    most = (F.col("left") + F.col("right")) / 2
    same = (F.col("n") < 2) | (most == chance)
    return sums.select(*by, "n", F.when(same, 1.0).otherwise((F.col("both") - chance) / (most - chance)).alias("ari"))


def cosine_silhouettes(rows: DataFrame) -> DataFrame:
    """(id, group, silhouette) of ``rows`` (id, group, vector) with unit vectors, by cosine distance.

    The mean distance of a row to a group is 1 less the row's product with the group's
    mean, so sums by group are enough and no pair is formed. A row alone in its group
    has 0, as has every row if there is one group. Groups are few: their sums are joined
    to every row.
    """
    flat = rows.select("group", F.posexplode("vector").alias("k", "x")).groupBy("group", "k").agg(F.sum("x").alias("x"))
    sums = flat.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("total"))
    sums = sums.join(rows.groupBy("group").agg(F.count("*").alias("size")), "group").withColumnRenamed("group", "other")
    met = rows.crossJoin(sums).withColumn("product", dot("vector", "total"))
    own = F.col("group") == F.col("other")
    near = F.max(F.when(own & (F.col("size") > 1), (F.col("size") - F.col("product")) / (F.col("size") - 1)))
    far = F.min(F.when(~own, 1 - F.col("product") / F.col("size")))
    told = met.groupBy("id", "group").agg(near.alias("near"), far.alias("far"))
    return told.select("id", "group", F.coalesce((F.col("far") - F.col("near")) / F.greatest("far", "near"), F.lit(0.0)).alias("silhouette"))


def stability(rows: DataFrame, ks: Iterable[int], seeds: Iterable[int]) -> DataFrame:
    """(k, stability, silhouette, sizes, singletons, chosen) of k-means groupings of ``rows`` (id, vector) with unit vectors.

    Every k is fitted with every seed: ``stability`` is the median index over all pairs
    of seeds, ``silhouette`` the median of the runs' means, ``sizes`` (falling) and
    ``singletons`` are those of the first seed. Chosen is the k of the highest
    (stability, silhouette) among those without a group of one, or among all.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ks, seeds = list(ks), list(seeds)
    given = stored(rows.select("id", "vector", array_to_vector("vector").alias("features")), "stability-rows")
    runs = None
    for k in ks:
        for seed in seeds:
            placed = KMeans(k=k, seed=seed, distanceMeasure="cosine", predictionCol="group").fit(given).transform(given)
            placed = placed.select("id", F.lit(k).alias("k"), F.lit(seed).alias("seed"), "group")
            runs = placed if runs is None else runs.unionByName(placed)
    runs = stored(runs, "stability-runs")
    left = runs.select("id", "k", F.col("seed").alias("s"), F.col("group").alias("a"))
    right = runs.select("id", "k", F.col("seed").alias("t"), F.col("group").alias("b"))
    index = adjusted_rand(left.join(right, ["id", "k"]).filter("s < t"), ["k", "s", "t"]).groupBy("k").agg(F.median("ari").alias("stability"))
    close = None
    for seed in seeds:
        for k in ks:
            one = runs.filter((F.col("k") == k) & (F.col("seed") == seed)).join(given.select("id", "vector"), "id")
            mean = cosine_silhouettes(one.select("id", "group", "vector")).agg(F.avg("silhouette").alias("mean")).withColumn("k", F.lit(k))
            close = mean if close is None else close.unionByName(mean)
    close = close.groupBy("k").agg(F.median("mean").alias("silhouette"))
    first = runs.filter(F.col("seed") == seeds[0]).groupBy("k", "group").agg(F.count("*").alias("n"))
    # a list of k sizes
    first = first.groupBy("k").agg(F.sort_array(F.collect_list("n"), asc=False).alias("sizes"), F.count_if(F.col("n") == 1).alias("singletons"))
    table = first.join(close, "k").join(index, "k", "left")
    best = table.agg(F.max(F.struct(F.col("singletons") == 0, "stability", "silhouette", "k")).alias("best"))
    return table.crossJoin(F.broadcast(best)).select("k", "stability", "silhouette", "sizes", "singletons", (F.col("k") == F.col("best.k")).alias("chosen"))
