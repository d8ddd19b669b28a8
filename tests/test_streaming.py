import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from scholarlens.streaming import audit, timed
from scholarlens.streaming.timed import ROWS, Leases, Requests, Windows, advance, folded

FAR = 1 << 60


def expected(fold, rows):
    by_key = defaultdict(list)
    for key, event, at, kind in rows:
        if at is not None and kind is not None:
            by_key[key].append((event, at, kind))
    out = []
    for key, mine in by_key.items():
        _, made = advance(fold, key, fold.start(), sorted(mine, key=lambda r: (r[1], r[0])), FAR)
        out += [(key, *m) for m in made]
    return sorted(out, key=repr)


def log(seed, n=150, keys=(1, 2, 3, None)):
    """Events in order of time, about one an hour for each key, some at one time."""
    rng, at, rows = random.Random(seed), 1_700_000_000_000_000, []
    for event in range(n):
        at += rng.choice([0, 1, 999, 1000, 600_000_000, 900_000_000, 7_200_000_000])
        rows.append((rng.choice(keys), event, at, rng.choice(["claim", "beat", "beat", "done", "error"])))
    return rows


def run(spark, tmp_path, name, parts, fold, delay):
    for part in parts:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
    return sorted((tuple(r) for r in folded(stream, fold, str(tmp_path / name / "out"), delay).collect()), key=repr)


def test_output_does_not_depend_on_micro_batches(spark, tmp_path):
    rows = log(1) + [(5, 900, None, "claim"), (5, 901, 1_700_000_000_000_000, None)]
    fold = Leases(3_600_000_000, 2)
    want = expected(fold, rows)
    assert {o[3] for o in want} >= {"claimed", "busy", "extended", "lapsed", "failed", "stale", "done"}
    assert run(spark, tmp_path, "whole", [rows], fold, "1 hour") == want
    assert run(spark, tmp_path, "thirds", [rows[:50], rows[50:100], rows[100:]], fold, "1 hour") == want
    mixed = random.Random(2).sample(rows, len(rows))
    assert run(spark, tmp_path, "mixed", [mixed[:40], mixed[40:110], mixed[110:]], fold, "60 days") == want


def test_a_lapse_is_told_before_the_stream_ends(spark, tmp_path):
    """A lease of an hour ends by its timer when another key's row, two hours later, moves the watermark on."""
    start = 1_700_000_000_000_000
    parts = [[(1, 1, start, "claim")], [(2, 2, start + 7_200_000_000, "claim")], [(1, 3, start + 7_300_000_000, "beat")]]
    assert run(spark, tmp_path, "x", parts, Leases(3_600_000_000), "1 second") == expected(Leases(3_600_000_000), sum(parts, []))


def test_windows_over_batches(spark, tmp_path):
    parts = [[(1, 2, 5, "x"), (1, 1, 0, "x"), (2, 3, 1, "x"), (None, 9, 1, "x")], [(3, 8, 2, "x")], [(1, 4, 9, "x"), (1, 5, 12, "x"), (2, 6, 2, "x"), (None, 10, 2, "x")]]
    parts = [[(k, e, 10**12 + at * 10**6, x) for k, e, at, x in part] for part in parts]
    got = run(spark, tmp_path, "w", parts, Windows(10 * 10**6, 2), "1 day")
    assert {r[1]: (r[0], r[2] // 10**6 - 10**6, r[4], r[3]) for r in got} == {
        1: (1, 0, 1, "passed"), 2: (1, 0, 2, "passed"), 4: (1, 0, 3, "refused"), 5: (1, 12, 1, "passed"),
        3: (2, 1, 1, "passed"), 6: (2, 1, 2, "passed"), 8: (3, 2, 1, "passed"), 9: (None, 1, 1, "passed"), 10: (None, 1, 2, "passed"),
    }


def test_keys_of_a_bucket(spark, tmp_path, monkeypatch):
    """Many keys share the state of a few buckets, some with waiting rows and leases, and ids beside nulls keep all their digits."""
    monkeypatch.setattr(timed, "BUCKETS", 2)
    big = 2**53 + 1
    rows = log(7, 300, (0, 1, 2, 3, 4, big, None))
    rows = [(k, e + big, at, kind) for k, e, at, kind in rows]
    fold = Leases(3_600_000_000, 2)
    want = expected(fold, rows)
    assert run(spark, tmp_path, "few", [rows[:90], rows[90:180], rows[180:]], fold, "1 hour") == want
    assert len({o[0] for o in want}) == 7


def test_empty_stream(spark, tmp_path):
    assert run(spark, tmp_path, "none", [[]], Leases(10), "1 hour") == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["submit", "verify", "approve", "deny", "poll"])), max_size=25), st.integers(1, 2))
def test_request_rules(events, key):
    """What may never happen, whatever comes: a second decision, a decision of what is not open, an approval after the claim's request expired."""
    rows = sorted((at * 10, k, kind) for k, (at, kind) in enumerate(events))
    fold = Requests(100)
    state, open_, decided, number = fold.start(), False, False, 0
    for at, event, kind in rows:
        state, out = advance(fold, key, state, [(event, at, kind)], -1)
        for _, when, outcome, n in out:
            if outcome == "submitted":
                assert not open_ and n == number + 1
                open_, decided, number = True, False, n
            elif outcome in ("approved", "denied", "approved_by_system"):
                assert open_ and not decided and (outcome == "approved_by_system") == bool(key % 2)
                open_, decided = False, True
            elif outcome == "request_expired":
                assert open_ and key % 2 and when <= at
                open_ = False
            elif outcome == "not_pending":
                assert kind in ("approve", "deny")
                assert not (open_ and key % 2 == 0)


def rows_of(spark, rows):
    frame = spark.createDataFrame(rows, audit.LOG.replace("timestamp_ntz", "string"))
    return frame.withColumn("ts", frame.ts.cast("timestamp_ntz"))


def audit_rows(first, n, **other):
    base = {"event_type": "signin", "actor": 1, "target": None, "success": True, "metadata": None, "ip": "1.2.3.4", "agent": "a" * 400, "ts": "2024-01-01 00:00:00"} | other
    return [(first + k, *base.values()) for k in range(n)]


def test_a_batch_is_in_the_log_once_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "audit")
    assert audit.read_log(spark, folder).collect() == [] and audit.committed(spark, folder) == []
    assert audit.write_batch(rows_of(spark, audit_rows(0, 3)), 0, folder)
    assert not audit.write_batch(rows_of(spark, audit_rows(0, 3)), 0, folder)
    # an attempt that was lost before its marker is not read, and the next one replaces it
    rows_of(spark, audit_rows(90, 5)).write.parquet(f"{folder}/log/batch=1")
    assert sorted(r.event_id for r in audit.read_log(spark, folder).collect()) == [0, 1, 2]
    assert audit.write_batch(rows_of(spark, audit_rows(10, 2)), 1, folder)
    got = audit.read_log(spark, folder).collect()
    assert sorted((r.event_id, r.batch) for r in got) == [(0, 0), (1, 0), (2, 0), (10, 1), (11, 1)]
    assert all(len(r.agent) == 255 and r.metadata == "{}" for r in got)


def test_rows_that_cannot_be_taken_are_set_aside(spark, tmp_path):
    folder = str(tmp_path / "audit")
    bad = [audit_rows(k, 1, **x)[0] for k, x in enumerate(({"event_type": None}, {"event_type": "  "}, {"success": None}, {"metadata": "{"}, {"metadata": "[1]"}, {"metadata": '{"a": 1}'}))]
    users = spark.createDataFrame([(1,), (1,), (2,)], "user_id long")
    audit.write_batch(rows_of(spark, bad + audit_rows(7, 1, actor=5, target=2)), 0, folder, users)
    assert {r.event_id: r.fault for r in audit.read_log(spark, folder, faults=True).collect()} == {
        0: "no event type", 1: "no event type", 2: "no outcome", 3: "metadata are not JSON", 4: "metadata are no object",
    }
    assert {r.event_id: (r.actor, r.target) for r in audit.read_log(spark, folder).collect()} == {5: (1, None), 7: (None, 2)}


def test_a_stream_that_runs_again_adds_nothing(spark, tmp_path):
    place, folder = str(tmp_path / "in"), str(tmp_path / "audit")
    for k in range(3):
        rows_of(spark, audit_rows(10 * k, 4)).coalesce(1).write.mode("append").parquet(place)
    for state in ("a", "a", "b"):
        # the state "b" knows nothing: it brings the first batches again
        stream = spark.readStream.schema(spark.read.parquet(place).schema).option("maxFilesPerTrigger", 1).parquet(place)
        audit.audit_sink(stream, folder, str(tmp_path / state))
        assert audit.read_log(spark, folder).count() == 12 and audit.committed(spark, folder) == [0, 1, 2]
