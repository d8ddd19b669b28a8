"""Visual rows of a page: pieces of text put together by their height above the page's foot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Height that the pieces of a row may differ in from its first.
NEAR = 5.0


def anchored(heights: np.ndarray, anchor: float | None, near: float) -> tuple[np.ndarray, float]:
    """Where rows begin in rising heights, given the anchor of the row before; and the last anchor.

    A row's anchor is its first piece: what is more than ``near`` above it begins a new
    row, whatever the piece before is. Each jump finds the next beginning by search.
    """
    begins = np.zeros(len(heights), bool)
    at = 0
    if anchor is not None:
        at = int(np.searchsorted(heights - anchor, near, "right"))
    while at < len(heights):
        begins[at], anchor = True, float(heights[at])
        at += max(1, int(np.searchsorted(heights[at:] - anchor, near, "right")))
    return begins, anchor


def visual_rows(pieces: DataFrame, near: float = NEAR) -> DataFrame:
    """(page, row, anchor, text): the rows of ``pieces`` (page, piece, x, y, text) from the top down.

    Pieces are sorted by height and number; a row holds what is at most ``near`` above
    its first piece, put in order from the left. Blank pieces leave nothing; rows of
    blank pieces alone are left out, and rows are numbered after that. Spark sorts the
    pieces; a task holds one batch and one anchor, however many pieces a page has.
    """
    schema = "page long, piece long, x double, y double, text string, begins boolean, anchor double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor = object(), None
        for batch in batches:
            pages = batch.column("page").to_pylist()
            y = batch.column("y").to_numpy()
            begins, anchors = np.zeros(len(y), bool), np.zeros(len(y))
            edges = [0, *[k for k in range(1, len(pages)) if pages[k] != pages[k - 1]], len(pages)] if pages else []
            for a, b in zip(edges, edges[1:]):
                if pages[a] != last:
                    last, anchor = pages[a], None
                before = anchor
                begins[a:b], anchor = anchored(y[a:b], anchor, near)
                held = np.where(begins[a:b], y[a:b], np.nan)
                place = np.maximum.accumulate(np.where(begins[a:b], np.arange(b - a), -1))
                anchors[a:b] = np.where(place >= 0, held[np.maximum(place, 0)], np.nan if before is None else before)
            columns = [batch.column(c) for c in ("page", "piece", "x", "y", "text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(begins), pa.array(anchors)], names=["page", "piece", "x", "y", "text", "begins", "anchor"])

    rows = pieces.filter("y is not null").select(F.col("page").cast("long"), F.col("piece").cast("long"), F.col("x").cast("double"), F.col("y").cast("double"), "text")
    told = rows.repartition("page").sortWithinPartitions("page", "y", "piece").mapInArrow(run, schema)
    # an anchor is a height at which one row begins, so it names the row
    parts = F.array_sort(F.collect_list(F.struct("x", "text")))
    made = told.groupBy("page", "anchor").agg(F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " "), r"\s+", " ")).alias("text"))
    number = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("anchor")))
    return made.filter("text <> ''").select("page", number.cast("long").alias("row"), "anchor", "text")
