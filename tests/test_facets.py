"""Facets, lists and lookups at their edges."""

import pytest
from pyspark.sql import functions as F

from scholarlens.operators.facets import dashboard, facets, first_of, flag, holds_all, listed, looked_up


def test_facets_of_null_values_and_of_nothing(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "x string, y int")
    got = {(r.facet, r.value): r.n for r in facets(rows, ["x", "y"]).collect()}
    assert got == {("x", "a"): 2, ("x", None): 1, ("y", "1"): 2, ("y", None): 1, ("all", None): 3}
    assert facets(rows.limit(0), ["x", "y"]).collect() == []
    hits = {q: rows.filter(holds_all(q, ["x", "y"])).count() for q in ("", "A", "a 1", "z")}
    assert hits == {"": 3, "A": 2, "a 1": 1, "z": 0}


def test_flags_are_strict():
    assert [flag(x) for x in (None, "true", " False ", "TRUE")] == [None, True, False, True]
    for bad in ("", "1", "yes"):
        with pytest.raises(ValueError):
            flag(bad)


def test_lists_of_readers(spark):
    rows = spark.createDataFrame(
        [(1, "a", "approved", 1, 5), (2, "b", "approved", None, None), (3, "b", "rejected", None, None), (4, "b", "approved", 1, None), (5, "a", "pending_review", None, 5)],
        "id int, uploader string, status string, subject int, reviewed_at int",
    )

    def ids(*args, **kwargs):
        return sorted(r.id for r in listed(rows, *args, **kwargs).collect())

    assert ids("a", "student") == [1, 2, 4, 5] and ids("a", "student", mine="true") == [1, 5] and ids("a", "student", mine="false") == [1, 2, 4, 5]
    assert ids("a", "faculty") == [1, 2, 3, 4, 5] and ids("a", "faculty", review="pending") == [2] and ids("b", "administrator", mine="true", review="reviewed") == []
    with pytest.raises(PermissionError):
        listed(rows, "a", "student", review="pending")
    with pytest.raises(ValueError):
        listed(rows, "a", "faculty", review="done")


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "one"), (2, None)], "id long, title string")
    keys = ["1", " 2 ", "3", "x", "", None, "1.0", "-1", "9" * 19, "01"]
    asked = spark.createDataFrame([(k, v) for k, v in enumerate(keys)], "n int, key string")
    got = [(r.found, r.title) for r in looked_up(asked, "key", rows, ["title"]).orderBy("n").collect()]
    assert got == [(True, "one"), (True, None)] + [(False, None)] * 7 + [(True, "one")]


def test_dashboard_without_works(spark):
    schema = "id int, program string, year int, status string, created_at int, keywords array<string>, ready boolean"
    works, roles = spark.createDataFrame([], schema), spark.createDataFrame([("student",), ("faculty",)], "role string")
    got = {r.role: r for r in dashboard(works, roles, 2024, F.lit(0)).collect()}
    assert (got["faculty"].total, got["faculty"].pending, got["faculty"].busiest, got["faculty"].programs) == (0, 0, None, [])
    assert got["student"].pending is None
    works = spark.createDataFrame([(k, "ab"[k % 2], 2014 + k, "approved", k, [" K ", "k", ""], k == 1) for k in range(4)], schema)
    one = dashboard(works, roles, 2024, F.lit(2)).first()
    assert (one.recent, one.semantic_ready, one.busiest) == (2, 1, "a")
    assert [tuple(x) for x in one.programs] == [("a", 2), ("b", 2)] and [x["name"] for x in one.growth] == ["2015", "2016", "2017"]
    assert [tuple(x) for x in one.keywords] == [("k", 8)]


def test_first_values_of_keys(spark):
    rows = spark.createDataFrame([(1, 5), (1, 3), (1, 4), (2, 9)], "k int, v int")
    assert {r.k: r["values"] for r in first_of(rows, "k", "v", [F.col("v")], 2).collect()} == {1: [3, 4], 2: [9]}
