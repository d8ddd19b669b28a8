"""Checks of applicants against rules written one by one."""

import sys
import unicodedata

from pyspark.sql import functions as F

from scholarlens.functions.text import ascii_form
from scholarlens.operators.verification import college_allowed, logged_events, name_on_document, number_on_document, verified

COLUMNS = "id long, full_name string, institution string, college string, program string, text string, confidence double, first_name string, last_name string, email string, state string"
TEXT = "Pampanga State University\nPEÑA, María J.\n2023-313521"
GOOD = dict(full_name="María Peña", institution="Pampanga State University", college="CCS", program="bsit", text=TEXT,
            confidence=80.0, first_name="Maria Jose", last_name="Peña", email="2023313521@x.edu", state="processing")


def frame(spark, cases):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = [tuple({**GOOD, **c, "id": k}[n] for n in names) for k, c in enumerate(cases)]
    return spark.createDataFrame(rows, COLUMNS)


def test_ascii_form_of_all_characters(spark):
    """Blocks of all characters, beside each other, have the ASCII of their compatibility form, and no text goes to Python for it."""
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(every[k : k + 997]) + "Z" for k in range(0, len(every), 997)] + ["", "Ĳ e\u0301\u0327 ½…", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", ascii_form("t").alias("got"))
    assert "Python" not in frame._jdf.queryExecution().optimizedPlan().toString()
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if c.isascii()) for t in texts]
    assert [r.got for r in frame.orderBy("k").collect()] == want


def test_names_and_numbers_on_documents(spark):
    names = [
        ("Ana", "Cruz", "ANA B. CRUZ", True), ("Ana", "Dela Cruz", "ana cruz", False), ("Ana Bea", "Cruz", "Bea Cruz", True), ("A", "Cruz", "A Cruz", False),
        ("Ana", "", "ana", False), (None, "Cruz", "cruz", False), ("Ana", "Cruz", None, False), ("Ana", "Cruz", "Anabel Cruz", False),
        ("Ana", "Ñuñez", "ana NUÑEZ", True), ("Ana", "Cruz-Reyes", "Reyes Cruz, Ana", True), ("ﬁn", "Cruz", "FIN cruz", True),
    ]
    rows = spark.createDataFrame([(k, *n) for k, n in enumerate(names)], "k int, a string, b string, t string, want boolean")
    assert [r.k for r in rows.filter(F.coalesce(name_on_document("a", "b", "t"), F.lit(False)) != F.col("want")).collect()] == []
    numbers = [
        ("2023@x", "no 20 23.", True), ("2023@x", "no 20 23", True), ("2023@x", "2-0-2-3", True), ("2023@x", "12023", False), ("2023@x", "20234", False),
        ("2023@x", "20  23", False), ("ana@x", "ana", False), (None, "1", False), ("7", "x7y", True), ("2023@x", None, False), ("@x", "", False),
    ]
    rows = spark.createDataFrame([(k, *n) for k, n in enumerate(numbers)], "k int, e string, t string, want boolean")
    assert [r.k for r in rows.filter(F.coalesce(number_on_document("e", "t"), F.lit(False)) != F.col("want")).collect()] == []


def test_colleges(spark):
    rows = spark.createDataFrame([("CCS",), (" college of COMPUTING studies ",), ("Computting Studdies",), ("Computing",), ("Law",)], "c string")
    assert [r[0] for r in rows.select(college_allowed("c")).collect()] == [True, True, True, False, False]


CASES = [
    ({}, "auto_approved", "high_confidence", [], "pending_email_verification", "pending_email_verification"),
    ({"confidence": 75.0, "college": None}, "auto_approved", "high_confidence", [], "pending_email_verification", "pending_email_verification"),
    ({"confidence": 74.9}, "pending_manual_review", "ocr_medium_confidence", ["confidence 74.9"], "pending", "pending_manual_review"),
    ({"confidence": 59.0}, "pending_manual_review", "ocr_low_confidence", ["confidence 59.0"], "pending", "pending_manual_review"),
    ({"last_name": "Reyes"}, "pending_manual_review", "name_mismatch", ["name_mismatch"], "pending", "pending_manual_review"),
    ({"email": "1@x", "confidence": 60.0}, "pending_manual_review", "ocr_medium_confidence", ["confidence 60.0", "student_number_mismatch"], "pending", "pending_manual_review"),
    ({"institution": "Ateneo", "last_name": "Reyes"}, "rejected", "rule_validation_failed", ["invalid institution: Ateneo"], "denied", "rejected"),
    ({"program": "BS Nursing", "college": ""}, "rejected", "rule_validation_failed", ["missing: college", "invalid program: BS Nursing"], "denied", "rejected"),
    ({"full_name": ""}, "pending_manual_review", "incomplete_extraction", ["missing: full_name"], "pending", "pending_manual_review"),
    ({"institution": None, "text": "psu María Peña 2023313521"}, "rejected", "invalid_institution", ["missing: institution", "no sign of the institution"], "denied", "rejected"),
    ({"institution": None, "text": "psu ccs María Peña 2023313521"}, "pending_manual_review", "incomplete_extraction", ["missing: institution"], "pending", "pending_manual_review"),
    ({"confidence": None}, "error", "scan_failed", [], "pending", "pending_manual_review"),
    ({"state": "approved"}, None, None, None, "approved", "approved"),
    ({"state": "denied"}, None, None, None, "denied", "rejected"),
    ({"state": None}, None, None, None, None, "processing"),
    ({"institution": "Pampnga State Universty"}, "auto_approved", "high_confidence", [], "pending_email_verification", "pending_email_verification"),
]


def test_decisions(spark):
    got = verified(frame(spark, [c[0] for c in CASES])).orderBy("id").collect()
    assert [(r.status, r.reason, r.flags, r.request_state, r.reported) for r in got] == [c[1:] for c in CASES]


def test_names_of_other_schools(spark):
    cases = [{"text": TEXT + "\nholy angel university"}, {"text": TEXT + "\nBS NURSING", "program": None}, {"institution": None, "text": "DLSU"}]
    got = verified(frame(spark, cases), negative=True).orderBy("id").collect()
    assert [r.flags for r in got] == [["invalid institution: Holy Angel University"], ["invalid program: BS Nursing"], ["invalid institution: DLSU"]]
    assert {r.status for r in got} == {"rejected"}


def test_events(spark):
    rows = verified(frame(spark, [c[0] for c in CASES]))
    got = {}
    for r in logged_events(rows, "id").orderBy("id", "step").collect():
        got.setdefault(r.id, []).append((r.event_type.rsplit(".", 1)[1], r.reason))
    assert got[0] == [("started", None), ("completed", None), ("auto_approved", "high_confidence")]
    assert got[11] == [("started", None), ("error", "scan_failed")]
    assert got[6][-1][0] == "rejected" and got[4][-1] == ("pending_review", "name_mismatch") and not {12, 13, 14} & set(got)


def test_a_second_run_changes_nothing(spark):
    once = verified(frame(spark, [c[0] for c in CASES]))
    again = once.withColumn("state", F.col("request_state")).drop("failures", "status", "reason", "flags", "request_state", "reported")
    first, second = ({r.id: r.request_state for r in f.collect()} for f in (once, verified(again)))
    assert first == second
