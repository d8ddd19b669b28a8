"""Folds over a stream in order of event time, with timers: the output does not depend on how rows fall into micro-batches.

Rows of a key wait in the state store until the watermark has passed them, so that none
that is earlier can still come; then they are folded in order of time and id. A fold
may ask to be woken at a time of its own (a lease that ends, a claim that expires): it
is woken before the first row of that time or later, and by a timer when the watermark
passes with no row. State is kept in RocksDB, by buckets of keys: a call for each key and
wake costs far more than its few rows. A bucket holds its folds' few values and the rows
that wait, as many as come within the delay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROWS = "key long, event_id long, at long, kind string"
OUTPUT = "key long, event_id long, at long, outcome string, number long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Closes a stream: all that waits is before it. Times from then on are out of range.
_END = "2200-01-01 00:00:00"
DAY = 86_400_000_000
#: Buckets of keys, the same for all runs over one state; rows of output that are given on at once.
BUCKETS, OUT_ROWS = 1024, 50_000
WAITING = pa.schema([("key", pa.int64()), ("keyed", pa.bool_()), ("event_id", pa.int64()), ("numbered", pa.bool_()), ("at", pa.int64()), ("kind", pa.string())])


class Fold:
    """A fold over the rows (event_id, at, kind) of one key; times are microseconds.

    A state is a tuple of integers, strings and nulls, as ``state`` tells in DDL.
    Outputs are (event_id, at, outcome, number).
    """

    state: str

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, key: Any, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When the fold is to be woken, if no row changes that."""
        return None

    def expire(self, key: Any, state: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError


def advance(fold: Fold, key: Any, state: tuple, rows: Iterable[tuple], until: int) -> tuple[tuple, list[tuple]]:
    """Fold sorted rows, then all that is due up to ``until``; at one time what is due comes first."""
    out = []
    for row in rows:
        while (due := fold.due(state)) is not None and due <= row[1]:
            state, made = fold.expire(key, state)
            out += made
        state, made = fold.step(key, state, row)
        out += made
    while (due := fold.due(state)) is not None and due <= until:
        state, made = fold.expire(key, state)
        out += made
    return state, out


class _Ordered(StatefulProcessor):
    """The fold over all keys of a bucket: state is read and written once a bucket and wake, not once a key.

    Rows wait as Arrow batches, one for each that came; states are one value. A bucket's
    keys are folded one after another, so only one key's rows are Python objects.
    """

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "states string")
        self.waiting = handle.getListState("waiting", "rows binary")

    def _wake(self, times: list[int]) -> None:
        if times:
            # the first whole millisecond at which the watermark has passed that time
            self.handle.registerTimer(-(-min(times) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, times = [], []
        for frame in rows:
            frame = frame.loc[frame["kind"].notna(), list(WAITING.names)]
            if len(frame):
                new.append((packed(pa.Table.from_pandas(frame, WAITING, preserve_index=False)),))
                times.append(int(frame["at"].min()))
        if new:
            self.waiting.appendList(new)
            self._wake(times)
        yield pd.DataFrame(columns=["key", "event_id", "at", "outcome", "number"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        table = pa.concat_tables(parts) if parts else WAITING.empty_table()
        open_ = pc.less_equal(table["at"], until)
        ready, rest = table.filter(open_), table.filter(pc.invert(open_))
        ready = ready.sort_by([(c, "ascending") for c in ("keyed", "key", "at", "numbered", "event_id")])
        states = {name: tuple(state) for name, state in json.loads(self.kept.get()[0])} if self.kept.exists() else {}
        out, changed = [], False
        for name, mine in by_key(ready, [k for k, s in states.items() if (d := self.fold.due(s)) is not None and d <= until]):
            before = states.get(name)
            states[name], made = advance(self.fold, name, self.fold.start() if before is None else before, mine, until)
            changed = changed or states[name] != before
            out += [(name, *m) for m in made]
            if len(out) >= OUT_ROWS:
                yield _outputs(out)
                out = []
        if changed:
            self.kept.update((json.dumps(list(states.items())),))
        if len(ready):
            self.waiting.put([(packed(rest),)]) if len(rest) else self.waiting.clear()
        due = [d for s in states.values() if (d := self.fold.due(s)) is not None]
        self._wake(due + ([pc.min(rest["at"]).as_py()] if len(rest) else []))
        yield _outputs(out)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def by_key(ready: pa.Table, others: list) -> Iterator[tuple[Any, list[tuple]]]:
    """(key, its rows) for each key of ``ready``, which is sorted, and for ``others`` that have none."""
    keys, keyed = ready["key"].to_numpy(), ready["keyed"].to_numpy()
    cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (keyed[1:] != keyed[:-1])) + 1
    met = set()
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ready)]) if len(ready) else ():
        name = int(keys[a]) if keyed[a] else None
        met.add(name)
        columns = ready.slice(a, b - a).to_pydict()
        events = [e if n else None for e, n in zip(columns["event_id"], columns["numbered"])]
        yield name, list(zip(events, columns["at"], columns["kind"]))
    for name in others:
        if name not in met:
            yield name, []


def _outputs(out: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*out)) if out else [()] * 5
    made = dict(zip(("key", "event_id", "at", "outcome", "number"), columns))
    return pd.DataFrame({c: pd.Series(v, dtype="object" if c == "outcome" else "Int64") for c, v in made.items()})


def _run(stream: DataFrame, fold: Fold, delay: str, path: str, state: str) -> None:
    spark = stream.sparkSession
    # numbers that may be null come to pandas as such with a mark
    whole = {"key": F.coalesce("key", F.lit(0)), "keyed": F.col("key").isNotNull(), "event_id": F.coalesce("event_id", F.lit(0)), "numbered": F.col("event_id").isNotNull()}
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    timed = stream.withColumns({"bucket": bucket, **whole, "ts": F.timestamp_micros("at")}).withWatermark("ts", delay)
    out = timed.groupBy("bucket").transformWithStateInPandas(_Ordered(fold), OUTPUT, "Append", "EventTime")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    query.awaitTermination()


def folded(stream: DataFrame, fold: Fold, folder: str, delay: str = "1 hour") -> DataFrame:
    """``fold`` over a stream (key, event_id, at, kind), run over all that is there now; (key, event_id, at, outcome, number).

    ``delay`` is how much earlier than the latest row seen a row may still come; rows
    later than that are left out, as with every watermark. Rows without a kind or a
    time before the year 2200 are none. The stream is closed at the end by a row of its own, so that all rows and
    timers have their turn. Outputs are appended to ``folder`` exactly once and read back.
    """
    spark: SparkSession = stream.sparkSession
    place = f"{folder.rstrip('/')}/timed-{uuid.uuid4().hex}"
    end, out, state = f"{place}/end", f"{place}/out", f"{place}/state"
    spark.createDataFrame([], ROWS).write.parquet(end)
    end_at = F.unix_micros(F.lit(_END).cast("timestamp"))
    rows = stream.select(*[F.col(c) for c in ("key", "event_id", "at", "kind")]).filter((F.col("at") < end_at) & F.col("kind").isNotNull())
    both = rows.unionByName(spark.readStream.schema(ROWS).parquet(end))
    _run(both, fold, delay, out, state)
    last = spark.range(1).select(F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("event_id"), end_at.alias("at"), F.lit(None).cast("string").alias("kind"))
    last.write.mode("append").parquet(end)
    _run(both, fold, delay, out, state)
    return spark.read.schema(OUTPUT).parquet(out)


class Leases(Fold):
    """Jobs under leases: a claim takes a free job for ``lease``, each heartbeat extends it from then on, and a lease that ends unextended lapses.

    A job that was claimed ``most`` times without an end fails with the next lapse or
    exception; its count begins anew. What comes for a job that nobody holds is stale.
    Kinds: claim, beat, done, error. The number of an output is the attempt.
    """

    state = "until long, attempts long"

    def __init__(self, lease: int, most: int = 3):
        self.lease, self.most = lease, most

    def start(self):
        return (None, 0)

    def due(self, state):
        return state[0]

    def _freed(self, attempts: int, outcome: str) -> tuple[tuple, str]:
        if attempts >= self.most:
            return (None, 0), "failed"
        return (None, attempts), outcome

    def expire(self, key, state):
        until, attempts = state
        state, outcome = self._freed(attempts, "lapsed")
        return state, [(None, until, outcome, attempts)]

    def step(self, key, state, row):
        event, at, kind = row
        until, attempts = state
        if kind == "claim" and until is None:
            state, outcome, attempts = (at + self.lease, attempts + 1), "claimed", attempts + 1
        elif kind == "claim":
            outcome = "busy"
        elif until is None:
            outcome = "stale"
        elif kind == "beat":
            state, outcome = (at + self.lease, attempts), "extended"
        elif kind == "done":
            state, outcome = (None, 0), "done"
        else:
            state, outcome = self._freed(attempts, "queued")
        return state, [(event, at, outcome, attempts)]


class Requests(Fold):
    """Requests for access: submitted, verified or decided once, and polled under a claim that expires.

    Odd keys are students, who verify their address, which approves them; even ones are
    faculty, whom an administrator decides. Only an open request of faculty can be
    approved or denied. A new submission is taken when there is none or the last was
    denied or its claim has expired unverified. Polls tell the state without a claim's
    rights after its end; the first poll of an approved student sets up the account.
    Kinds: submit, verify, approve, deny, poll. The number of an output is that of the
    submission.
    """

    state = "status string, claim long, reviewed boolean, number long"

    def __init__(self, claim: int):
        self.claim = claim

    def start(self):
        return (None, None, False, 0)

    def due(self, state):
        return state[1]

    def expire(self, key, state):
        status, claim, reviewed, number = state
        if status == "unverified":
            return ("expired", None, reviewed, number), [(None, claim, "request_expired", number)]
        return (status, None, reviewed, number), [(None, claim, "claim_expired", number)]

    def step(self, key, state, row):
        event, at, kind = row
        status, claim, reviewed, number = state
        if kind == "submit":
            if status in (None, "denied", "expired"):
                number += 1
                state, outcome = ("unverified" if (key or 0) % 2 else "pending", at + self.claim, False, number), "submitted"
            else:
                outcome = "already_active" if status in ("approved", "active") else "duplicate"
        elif kind == "verify":
            if status == "unverified":
                state, outcome = ("approved", claim, False, number), "approved_by_system"
            else:
                outcome = "nothing_to_verify"
        elif kind in ("approve", "deny"):
            if status == "pending":
                state, outcome = ("approved" if kind == "approve" else "denied", claim, True, number), "approved" if kind == "approve" else "denied"
            else:
                outcome = "not_pending"
        elif status is None:
            outcome = "not_found"
        elif status == "pending":
            outcome = "pending_manual_review"
        elif status == "unverified":
            outcome = "pending_verification"
        elif reviewed:
            outcome = "rejected" if status == "denied" else "approved_sign_in"
        elif status == "approved" and claim is not None:
            state, outcome = ("active", claim, reviewed, number), "verified"
        else:
            outcome = "already_active" if status == "active" else "expired"
        return state, [(event, at, outcome, number)]


class Windows(Fold):
    """A budget of ``limit`` hits in a window of ``length`` that opens with the first; the number is that of the hit, the window's begin is in the state."""

    state = "opened long, hits long"

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit

    def start(self):
        return (None, 0)

    def step(self, key, state, row):
        event, at, _ = row
        opened, hits = state
        if opened is None or at >= opened + self.length:
            opened, hits = at, 0
        hits += 1
        return (opened, hits), [(event, opened, "refused" if hits > self.limit else "passed", hits)]
