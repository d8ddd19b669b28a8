"""Vector operators: validity rules, dot products, blocked search and best matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = 1e-6
#: Probes of one block of a search; a block of vectors of 1024 numbers is 16 MB.
BLOCK = 2_000
#: Rows that one cell of a grid streams past its probes, and the most tasks of a grid; a task takes several cells beyond that.
ROWS_OF_A_CELL, MOST_TASKS = 500_000, 20_000


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two arrays in double precision; null when either is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def all_finite(v: str | Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def unit_vector(v: str, dim: int) -> Column:
    """The vector scaled to length 1, null unless it has ``dim`` finite numbers and a norm above 1e-6."""
    column = F.col(v)
    good = column.isNotNull() & (F.size(column) == dim) & all_finite(column)
    length = norm(column)
    return F.when(good & (length > TIE), F.transform(column, lambda x: x.cast("double") / length))


def fault(v: str, dim: int) -> Column:
    """Why a vector cannot be compared: no usable numbers, a wrong length (told first), or null if it can."""
    column = F.col(v)
    missing = F.lit("missing_title_embedding")
    return (
        F.when(column.isNull() | (F.size(column) == 0), missing)
        .when(F.size(column) != dim, "dimension_mismatch")
        .when(~all_finite(column), missing)
        .when(norm(column) < TIE, missing)
    )


def band(score: str | Column) -> Column:
    """Overlap class of a score."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 0.85, "HIGH").when(score >= 0.60, "MODERATE").otherwise("LOW")


#: What a reviewer is told for each overlap label; any other label says that nothing was measured.
ADVICE = {
    "High Overlap": "Very close to an existing approved thesis. Compare scope, methodology, and target users before approving.",
    "Moderate": "Shares substantial wording with an existing thesis. May still be acceptable if the scope or implementation differ.",
    "Clean": "No substantial title overlap with the approved corpus.",
}
NOT_MEASURED = "Similarity could not be measured for this record."


def overlap_label(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 0.85, "High Overlap").when(score >= 0.60, "Moderate").when(score.isNotNull(), "Clean").otherwise("Not computed")


def advice(label: str | Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.when(label.isNotNull(), F.try_element_at(known, label)), F.lit(NOT_MEASURED))


def overlap_reports(corpus: DataFrame, probes: DataFrame, dim: int) -> DataFrame:
    """(id, match_id, score, label, reason, corpus_size) of every probe (id, vector) against the usable rows of ``corpus``.

    A probe that cannot be compared says why and is "Not computed"; so is one without
    any other row ("empty_corpus"). Scores are rounded to four digits after the label is set.
    """
    usable = corpus.select("id", "vector").filter(fault("vector", dim).isNull())
    judged = probes.select("id", "vector", fault("vector", dim).alias("reason"))
    found = best_matches(usable, judged.filter("reason is null").select("id", "vector"))
    size = usable.agg(F.count("*").alias("corpus_size"))
    rows = judged.drop("vector").join(found.select(F.col("probe").alias("id"), F.col("id").alias("match_id"), "score"), "id", "left").crossJoin(size)
    reason = F.coalesce("reason", F.when(F.col("score").isNull(), "empty_corpus"))
    return rows.select("id", "match_id", F.round("score", 4).alias("score"), overlap_label("score").alias("label"), reason.alias("reason"), "corpus_size")


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    """The column of vectors as a matrix in double precision."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(batch.num_rows, -1)


def _leading(probe_ids: np.ndarray, probes: np.ndarray):
    """Per batch and probe: every row within TIE of the batch's best score, the probe itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            scores = probes @ _numbers(batch).T
            scores[probe_ids[:, None] == ids[None, :]] = -np.inf
            best = scores.max(axis=1)
            p, r = np.nonzero((scores >= best[:, None] - TIE) & np.isfinite(best)[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(probe_ids[p]), pa.array(ids[r]), pa.array(scores[p, r])], names=["probe", "id", "score"]
            )

    return run


def _leading_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_leading` over sorted cells, each with its probes before its rows; only the probes of one cell are held."""
    at, held, lead = None, [], None
    for batch in batches:
        cells, met = batch.column("cell").to_numpy(), batch.column("met").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(cells) != 0) | (met[1:] != met[:-1])) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows]):
            if end == start:
                continue
            part = batch.slice(start, end - start)
            if cells[start] != at:
                at, held, lead = cells[start], [], None
            if not met[start]:
                held.append(part)
            elif held:
                if lead is None:
                    lead = _leading(np.concatenate([b.column("id").to_numpy() for b in held]), np.concatenate([_numbers(b) for b in held]))
                yield from lead([part])


_LED = "probe long, id long, score double"


def _grid(corpus: DataFrame, probes: DataFrame, block: int, rows_of_a_cell: int) -> DataFrame:
    """Leaders by cells of a grid: blocks of probes against shards of rows, one plan whatever their number."""
    spark = corpus.sparkSession
    blocks = max(1, -(-probes.count() // block))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-corpus.count() // rows_of_a_cell), -(-parallel // blocks))
    shard, of_block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)), F.pmod(F.xxhash64("id"), F.lit(blocks))
    rows = corpus.select("id", "vector", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    asked = probes.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), of_block.alias("b"))
    cell = (F.col("b").cast("long") * shards + F.col("shard")).alias("cell")
    both = asked.select(cell, F.lit(False).alias("met"), "id", "vector").unionByName(rows.select(cell, F.lit(True).alias("met"), "id", "vector"))
    placed = both.repartition(min(blocks * shards, MOST_TASKS), "cell").sortWithinPartitions("cell", "met")
    return placed.mapInArrow(_leading_in_cells, _LED)


def best_matches(corpus: DataFrame, probes: DataFrame, block: int = BLOCK, rows_of_a_cell: int = ROWS_OF_A_CELL) -> DataFrame:
    """(probe, id, score): for each probe (id, vector) the best other row of ``corpus`` (id, vector).

    Rows within 1e-6 of the best score tie, and the least id wins; the score is that
    of the chosen row. Up to ``block`` probes travel to the rows, which are then not
    shuffled. More of them meet the rows in a grid: a cell holds about ``block``
    probes and streams about ``rows_of_a_cell`` rows past them by one matrix product
    a batch. Only the leaders of a batch are shuffled again. Vectors must be usable
    and of one length, the ids of probes unique; without probes or without other
    rows there is no row.
    """
    few = probes.select("id", "vector").limit(block + 1).toArrow()
    if few.num_rows > block:
        led = _grid(corpus.select("id", "vector"), probes.select("id", "vector"), block, rows_of_a_cell)
    elif few.num_rows:
        asked = few.combine_chunks().to_batches()[0]
        led = corpus.select("id", "vector").mapInArrow(_leading(asked.column("id").to_numpy(), _numbers(asked)), _LED)
    else:
        return corpus.sparkSession.createDataFrame([], _LED)
    # equal scores are one row before the shuffle, so that copies do not pile up on a probe
    led = led.groupBy("probe", "score").agg(F.min("id").alias("id"))
    top = F.max("score").over(Window.partitionBy("probe"))
    tied = led.withColumn("top", top).filter(F.col("score") >= F.col("top") - TIE)
    chosen = tied.groupBy("probe").agg(F.min(F.struct("id", "score")).alias("m"))
    return chosen.select("probe", "m.id", "m.score")


def centroids(rows: DataFrame, key: str) -> DataFrame:
    """(key, centroid): the unit vector of the sum of the unit vectors of each group (key, vector)."""
    flat = rows.select(key, F.posexplode("vector").alias("k", "x")).groupBy(key, "k").agg(F.sum("x").alias("x"))
    summed = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    return summed.select(key, F.transform("v", lambda x: x / norm("v")).alias("centroid"))
