import hashlib

import pyarrow as pa

from scholarlens.plans import repository
from scholarlens.registry import queries


def test_digests_are_hashed_as_they_come():
    rows = [("a", "x" * 64), ("a", "y" * 64), ("b", None), ("b", "z" * 64), ("c", None)]
    batches = (pa.RecordBatch.from_pylist([{"status": s, "h": h}], pa.schema([("status", pa.string()), ("h", pa.string())])) for s, h in rows)
    got = [tuple(r.values()) for b in repository.chained(batches) for r in b.to_pylist()]
    assert got == [("a", hashlib.sha256(b"x" * 64 + b"y" * 64).hexdigest()), ("b", hashlib.sha256(b"z" * 64).hexdigest()), ("c", None)]


def test_no_row_lists_the_rows_of_a_state(spark, sf_dir):
    plan = queries()["corpus_fingerprint"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
