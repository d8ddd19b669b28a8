"""Centroid clustering (Lloyd's rounds in integers) over vectors kept as codes of subvectors.

Encoding. Kept vectors are gathered into shards of at most SHARD vectors. In a shard
the dimensions are cut into blocks of BLOCK neighbours; each block has a dictionary of
the distinct subvectors that occur in it, and a vector is a code for each block. That
loses nothing: a vector is its codes' subvectors side by side. A dictionary has at most
as many entries as its shard has vectors, so its size has a bound whatever the data are.
Shards are rows of a table in the shared folder and are made once.

A round. For each block the exact squared distances of its subvectors to that block
of all centroids are computed once; a vector's distances are the sums of those that its
codes name, and the smallest number wins ties. New centroids come from counts of
(cluster, code) times the subvectors: a task adds up its shards and hands on a row for
each cluster, Spark sums these by cluster and component, and the driver holds no more
than the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import stored

DIM, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
#: Dimensions of a block, and vectors of a shard at most.
BLOCK, SHARD = 2, 1 << 16
#: Components are below this in size, so that 64 squares of differences stay far below 2 ** 63.
LARGEST = 1 << 20
#: Vectors whose distances are summed at a time.
CHUNK = 4096

_SHARDS = "ids array<long>, words array<binary>, codes array<binary>"
_KINDS = [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]


def usable(v: str | Column, dim: int) -> Column:
    """Exactly ``dim`` components, none null or not finite, all of floor(256 * x) below LARGEST in size."""
    v = F.col(v) if isinstance(v, str) else v
    inside = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(LARGEST / 256.0)), F.lit(False)))
    return F.coalesce((F.size(v) == dim) & inside, F.lit(False))


def whole_numbers(v: str | Column) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * 256))


def encode(vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(dictionary, codes) of each block of columns of ``vectors``; a dictionary has a row for each distinct subvector."""
    words, codes = [], []
    for at in range(0, vectors.shape[1], BLOCK):
        part = vectors[:, at : at + BLOCK].astype(np.int64)
        key = part[:, 0]
        for j in range(1, part.shape[1]):
            key = (key << 22) + (part[:, j] + LARGEST)
        _, first, code = np.unique(key, return_index=True, return_inverse=True)
        words.append(part[first].astype(np.int32))
        codes.append(code.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32))
    return words, codes


def decode(words: list[np.ndarray], codes: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w[c] for w, c in zip(words, codes)], axis=1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0

    def made() -> pa.RecordBatch:
        ids = pa.concat_arrays([i for i, _ in held])
        words, codes = encode(np.concatenate([v for _, v in held]))
        row = [[ids.to_pylist()], [[x.tobytes() for x in words]], [[x.tobytes() for x in codes]]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _KINDS)], names=["ids", "words", "codes"])

    for batch in batches:
        for at in range(0, batch.num_rows, SHARD):
            part = batch.slice(at, SHARD)
            if count + part.num_rows > SHARD:
                yield made()
                held, count = [], 0
            values = part.column("q").flatten().to_numpy().reshape(part.num_rows, -1).astype(np.int32)
            held.append((part.column("vec_id"), values))
            count += part.num_rows
    if count:
        yield made()


def _opened(batches: Iterator[pa.RecordBatch]):
    """(ids, dictionaries, codes) of each shard."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = batch.column("ids")[k].values
            words = [np.frombuffer(x.as_py(), np.int32) for x in batch.column("words")[k].values]
            raw = [x.as_py() for x in batch.column("codes")[k].values]
            codes = [np.frombuffer(x, np.uint16 if len(x) == 2 * len(ids) else np.uint32) for x in raw]
            # codes name all entries of a dictionary
            yield ids, [w.reshape(int(c.max()) + 1, -1) for w, c in zip(words, codes)], codes


def assigned(words: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector of a shard."""
    tables, at = [], 0
    for w in words:
        c = centroids[:, at : at + w.shape[1]]
        tables.append(((w[:, None, :].astype(np.int64) - c[None]) ** 2).sum(axis=2))
        at += w.shape[1]
    nearest, least = [], []
    for first in range(0, len(codes[0]), CHUNK):
        total = sum(t[c[first : first + CHUNK]] for t, c in zip(tables, codes))
        near = total.argmin(axis=1)
        nearest.append(near)
        least.append(total[np.arange(len(near)), near])
    return np.concatenate(nearest), np.concatenate(least)


def _sums(centroids: np.ndarray):
    """Vectors and components summed by cluster, over all shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, counts, sums = len(centroids), np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for _, words, codes in _opened(batches):
            cluster, _ = assigned(words, codes, centroids)
            counts += np.bincount(cluster, minlength=k)
            at = 0
            for w, c in zip(words, codes):
                uses = np.bincount(cluster * len(w) + c, minlength=k * len(w)).reshape(k, len(w))
                sums[:, at : at + w.shape[1]] += uses @ w.astype(np.int64)
                at += w.shape[1]
        (met,) = np.nonzero(counts)
        columns = [pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    return run


def _placed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, codes in _opened(batches):
            cluster, distance = assigned(words, codes, centroids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return run


def _round(shards: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of exact means, empty clusters as they were."""
    rows = shards.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    flat = rows.select("cluster", "n", F.posexplode("sums").alias("k", "x"))
    new = centroids.copy()
    # as many rows as the centroids have components
    for r in flat.groupBy("cluster", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        new[r.cluster, r.k] = r.x // r.n
    return new


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """Cluster ``vectors`` (vec_id, embedding) around ``k`` centroids; a row for each vector kept.

    Kept are vectors of exactly ``dim`` components, none null or not finite; a component
    x counts as floor(256 * x). Components of 4096 or more in size (2 ** 20 after that)
    are out of range, as 64-bit sums of squares need a bound: such vectors are not kept.
    The first centroids are the ``k`` vectors of the least sha256 of "seed:vec_id", of
    rows with one id the one whose components are least; null ids come last there and
    are clustered as all others. Repeated rows keep a row each. Fewer than ``k`` kept
    vectors give as many centroids; none gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable("embedding", dim))
    kept = kept.select("vec_id", whole_numbers("embedding").alias("q"))
    shards = stored(kept.mapInArrow(_shards, _SHARDS), "vector-shards")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(F.asc_nulls_last(digest), "q").limit(k).collect()
    if not start:
        return spark.createDataFrame([], _RESULT)
    centroids = np.array([r.q for r in start], np.int64)
    for _ in range(rounds):
        centroids = _round(shards, centroids)
    placed = stored(shards.mapInArrow(_placed(centroids), "vec_id long, cluster int, distance long"), "vector-clusters")
    inertia = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = sum(inertia.values())
    about = [(c, d, total, digests[c]) for c, d in inertia.items()]
    # at most k rows
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
