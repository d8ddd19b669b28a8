import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholarlens.functions import manuscripts as m
from scholarlens.functions.text import _normal_title, folded, is_about, mentions, name_segment, normal_title, percent, plain_words, spaced, title_terms, whole_word
from scholarlens.operators.limits import failure_limit, ordered_fold, window_limit
from scholarlens.operators.vectors import band, best_matches, fault, unit_vector


def values(spark, rows, expression):
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k long, x {'string' if not rows or not isinstance(rows[0], list) else 'array<double>'}")
    return [r.y for r in frame.select("k", expression.alias("y")).orderBy("k").collect()]


def test_text_functions(spark):
    assert values(spark, ["  Straße \n X ", None, ""], folded("x")) == ["strasse x", None, ""]
    assert values(spark, ["Smart–Home: A  STUDY", "ﬁne"], normal_title(F.col("x"))) == ["smart home: a study", "fine"]
    assert values(spark, ["The smart-home of things", "x"], title_terms("x")) == [["smart", "home", "things"], []]
    assert values(spark, ["IoT: a study", "Plain", "A - B"], name_segment("x")) == ["IoT", "Plain", "A"]
    assert values(spark, ["an IoT hub", "idiot", "c++ use"], whole_word("x", "iot")) == [True, False, False]
    assert values(spark, ["c++ use"], whole_word("x", "c++")) == [True]
    s = spaced(plain_words("x"))
    assert values(spark, ["go go go now go", "", "ago"], mentions(s, "go")) == [4, 0, 0]
    assert values(spark, ["in the in the"], mentions(s, "in the")) == [2]
    assert values(spark, ["iot"], is_about(s, s, F.length("x"), "iot")) == [True]
    assert [float(x) for x in values(spark, ["0.12345"], percent(F.col("x").cast("decimal(6,5)")))] == [12.3]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=40))
def test_normal_title_is_stable(text):
    once = _normal_title(text)
    assert "  " not in once and once == once.strip()


def test_vector_rules(spark):
    rows = [[3.0, 4.0], [], [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1e-6, 0.0], None]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k long, x array<double>")
    got = frame.select("k", fault("x", 2).alias("f"), unit_vector("x", 2).alias("u")).orderBy("k").collect()
    missing, wrong = "missing_title_embedding", "dimension_mismatch"
    assert [r.f for r in got] == [None, missing, wrong, missing, missing, missing, None, missing]
    assert got[0].u == pytest.approx([0.6, 0.8])
    # a norm of 1e-6 is fit for comparing and not for scaling
    assert [r.u is None for r in got] == [False] + [True] * 7


def test_bands_at_their_edges(spark):
    frame = spark.createDataFrame([(0.85,), (0.8499,), (0.6,), (0.5999,)], "s double")
    assert [r.b for r in frame.select(band("s").alias("b")).collect()] == ["HIGH", "MODERATE", "MODERATE", "LOW"]


def test_best_match_takes_the_earliest_of_a_tie(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 4))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[40] = vectors[10]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    got = {r.probe: (r.id, r.score) for r in best_matches(frame, frame.filter("id < 30"), block=7).collect()}
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    for k in range(30):
        best = min(np.flatnonzero(scores[k] >= scores[k].max() - 1e-6))
        assert got[k][0] == best and math.isclose(got[k][1], scores[k][best], rel_tol=1e-9)
    cells = best_matches(frame, frame.filter("id < 30"), block=7, rows_of_a_cell=11)
    assert {r.probe: (r.id, r.score) for r in cells.collect()} == got
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    few = best_matches(frame, frame.filter("id < 30"))
    assert {r.probe: r.id for r in few.collect()} == {p: m[0] for p, m in got.items()}
    assert best_matches(frame, frame.limit(0)).collect() == []


def test_window_limiter_opens_with_the_first_hit(spark):
    rows = [(1, k, s) for k, s in enumerate([0.0, 5.0, 9.0, 10.0, 12.0, 19.9, 20.0])] + [(2, 100, 3.0)]
    frame = spark.createDataFrame(rows, "user_id long, event_id long, second double")
    start, step = window_limit(10, 2)
    out = ordered_fold(frame, "user_id", ["second"], start, step, "user_id long, event_id long, opened double, hits long, refused boolean")
    got = {r.event_id: (r.opened, r.hits, r.refused) for r in out.collect()}
    assert got == {0: (0, 1, False), 1: (0, 2, False), 2: (0, 3, True), 3: (10, 1, False), 4: (10, 2, False), 5: (10, 3, True), 6: (20, 1, False), 100: (3, 1, False)}


def test_failure_limiter_counts_failures_and_resets(spark):
    kinds = "ffpfr" + "fff" + "rp" + "f"
    rows = [(1, k, float(k), c == "f", c == "r") for k, c in enumerate(kinds)]
    frame = spark.createDataFrame(rows, "user_id long, event_id long, second double, failed boolean, resets boolean")
    start, step = failure_limit(1000, 2)
    out = ordered_fold(frame, "user_id", ["second"], start, step, "user_id long, event_id long, failures long, outcome string")
    got = [r.outcome for r in out.orderBy("event_id").collect()]
    assert got == ["failed", "failed", "passed", "refused", "refused", "refused", "refused", "refused", "refused", "refused", "refused"]


PAGE = """ONLINE LIBRARY MANAGEMENT
FOR A STATE COLLEGE

A Thesis Presented to the Faculty
in Partial Fulfillment of the Degree Bachelor of Science in Information Technology

By
Cruz, Ana M.
Reyes, Ben

March 2021

APPROVAL SHEET

ABSTRACT
This study built a library system and measured how staff and students used it over two terms.
It found that search was used most, and that loans rose by a third in the second term.

Keywords: library; search; Search; loans.

CHAPTER I
INTRODUCTION
"""


def test_manuscript_fields(spark):
    frame = spark.createDataFrame([(PAGE,)], "x string")
    programs = {"BSCS": r"computer\s+science", "BSIT": r"information\s+technology"}
    row = frame.select(
        m.gate("x").alias("gate"), m.markers_of("x").alias("markers"), m.title_of("x").alias("title"), m.authors_of("x").alias("authors"),
        m.abstract_of("x").alias("abstract"), m.keywords_of("x").alias("keywords"), m.year_of("x", 2025).alias("year"), m.program_of("x", programs).alias("program"),
    ).first()
    assert row.gate == "pass" and row.markers == ["abstract", "chapter", "approval_sheet", "presented_to", "partial_fulfillment"]
    assert tuple(row.title) == ("ONLINE LIBRARY MANAGEMENT FOR A STATE COLLEGE", "high")
    assert tuple(row.authors) == ("Cruz, Ana M.; Reyes, Ben", "low")
    assert row.abstract.value.startswith("This study") and row.abstract.value.endswith("second term.")
    assert tuple(row.keywords) == ("library; search; loans", "high")
    assert tuple(row.year) == ("2021", "high") and row.program.value == "BSIT"


def test_gate_refuses_other_texts(spark):
    assert values(spark, ["short", "x " * 200, None], m.gate("x")) == ["unreadable", "not_a_thesis", "unreadable"]


def test_texts_become_terms_once(spark):
    """Weights are made of stored counts: no branch of their plan reads the texts again."""
    from scholarlens.plans.search import tfidf

    docs = spark.createDataFrame([(1, 0, "aaa bbb"), (2, 0, "aaa ccc ccc"), (3, 1, "ccc bbb")], "id long, topic long, text string")
    weights = tfidf(docs)
    assert "regexp_extract_all" not in weights._jdf.queryExecution().optimizedPlan().toString()
    lengths = {}
    for r in weights.collect():
        lengths[r.id] = lengths.get(r.id, 0) + r.w**2
    assert set(lengths) == {1, 2, 3} and all(abs(x - 1) < 1e-9 for x in lengths.values())
