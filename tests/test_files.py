"""Files, manifests and reports at their edges."""

import json

import pytest

from scholarlens.operators.vectors import NOT_MEASURED, advice, overlap_reports
from scholarlens.sources.files import MANUSCRIPTS, SCANS, file_states, read_manifest, refused

PDF, ZIP, PNG, JPG = b"%PDF-1.7 text", b"PK\x03\x04 text", b"\x89PNG\r\n\x1a\n text", b"\xff\xd8\xff\xe0 text"


def test_uploads(spark):
    cases = [
        ("a.pdf", PDF, None, None), ("A.PDF", ZIP, "FILE_TYPE_MISMATCH", "FILE_TYPE_MISMATCH"), ("a.docx", ZIP, None, "FILE_TYPE_NOT_ALLOWED"),
        ("a.png", PNG, "FILE_TYPE_NOT_ALLOWED", None), ("a.jpg", PNG, "FILE_TYPE_NOT_ALLOWED", None), ("a.jpeg", JPG, "FILE_TYPE_NOT_ALLOWED", None),
        ("a.pdf", b"", "FILE_TYPE_MISMATCH", "FILE_CORRUPT"), ("a.pdf", None, "MISSING_FILE", "MISSING_FILE"), (None, PDF, "FILE_TYPE_NOT_ALLOWED", "FILE_TYPE_NOT_ALLOWED"),
        ("pdf", PDF, "FILE_TYPE_NOT_ALLOWED", "FILE_TYPE_NOT_ALLOWED"), ("a.pdf", PDF * 9, "FILE_TOO_LARGE", "FILE_TOO_LARGE"), ("a.pdf", b"%PD", "FILE_TYPE_MISMATCH", "FILE_CORRUPT"),
    ]
    rows = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, n string, c binary")
    got = rows.select("k", refused("n", "c", MANUSCRIPTS, 50).alias("m"), refused("n", "c", SCANS, 50, True).alias("s")).orderBy("k").collect()
    assert [(r.m, r.s) for r in got] == [c[2:] for c in cases]


def test_states_of_files(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "y"), (5, "z"), (6, "w"), (7, "x")], "id int, name string")
    listing = spark.createDataFrame([("x", 5), ("y", 0), ("w", None)], "path string, length long")
    got = {r.id: r.file_state for r in file_states(rows, "name", listing).collect()}
    assert got == {1: "blank", 2: "blank", 3: "present", 4: "empty", 5: "missing", 6: "missing", 7: "present"}


def test_manifests(spark, tmp_path):
    def given(rows):
        path = tmp_path / "m.json"
        path.write_text(rows if isinstance(rows, str) else json.dumps(rows))
        return str(path)

    good = [{"id": "a", "code": 1}, {"id": "b", "code": 2}]
    assert read_manifest(spark, given(good), "id string, code int", "id", 2).count() == 2
    for rows, expected in ((good, 3), (good + good[:1], None), ([{"id": None, "code": 1}], None)):
        with pytest.raises(ValueError):
            read_manifest(spark, given(rows), "id string, code int", "id", expected)
    with pytest.raises(Exception):
        read_manifest(spark, given("[{"), "id string, code int", "id", 1)


def test_reports_without_a_corpus(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "id long, vector array<double>")
    got = {r.id: (r.label, r.reason, r.corpus_size) for r in overlap_reports(rows, rows, 2).collect()}
    assert got == {1: ("Not computed", "empty_corpus", 1), 2: ("Not computed", "missing_title_embedding", 1), 3: ("Not computed", "dimension_mismatch", 1)}
    labels = spark.createDataFrame([("odd",), (None,), ("Clean",)], "label string")
    assert [r[0] == NOT_MEASURED for r in labels.select(advice("label")).collect()] == [True, True, False]
