"""Stateful folds over time-ordered events, for batches: a stream of sorted rows and a small state for the key at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(events: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """``step(state, row) -> (state, output or None)`` over each key's rows in order, from ``start()``.

    Rows are dealt by key and sorted inside their partition by Spark, which spills;
    a task holds one batch and the state of one key, however many rows a key has.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if getattr(row, key) != at:
                    at, state = getattr(row, key), start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def window_limit(seconds: int, limit: int) -> tuple[Callable, Callable]:
    """A fixed window that opens with the first hit; every hit counts, those above ``limit`` are refused."""

    def step(state, row):
        opened, count = state
        if opened is None or row.second >= opened + seconds:
            opened, count = row.second, 0
        count += 1
        return (opened, count), (row.user_id, row.event_id, opened, count, count > limit)

    return lambda: (None, 0), step


def failure_limit(seconds: int, limit: int) -> tuple[Callable, Callable]:
    """Failures count in a window that opens with the first; above ``limit`` every attempt is refused; success resets."""

    def step(state, row):
        opened, count = state
        if opened is not None and row.second >= opened + seconds:
            opened, count = None, 0
        if count > limit:
            return (opened, count), (row.user_id, row.event_id, count, "refused")
        if row.failed:
            opened, count = (row.second if opened is None else opened), count + 1
            return (opened, count), (row.user_id, row.event_id, count, "refused" if count > limit else "failed")
        if row.resets:
            return (None, 0), (row.user_id, row.event_id, 0, "passed")
        return (opened, count), (row.user_id, row.event_id, count, "passed")

    return lambda: (None, 0), step
