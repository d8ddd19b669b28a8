"""Rules of rows at their edges."""

from pyspark.sql import functions as F

from scholarlens.operators.integrity import edge_faults, entry_faults, repeated_pending, unpaired

GOOD = ("A title", "x" * 20, ["A"], ["k"], "en", 1980)
COLUMNS = "k int, title string, abstract string, authors array<string>, keywords array<string>, program string, year int"


def test_fields_of_entries(spark):
    cases = [
        (GOOD, []), ((" abc ", *GOOD[1:]), ["title"]), (("a" * 500, *GOOD[1:]), []), (("a" * 501, *GOOD[1:]), ["title"]),
        (("A title", "x" * 10_001, *GOOD[2:]), ["abstract"]), (("A title", " " * 30, *GOOD[2:]), ["abstract"]),
        ((*GOOD[:2], [" ", ""], ["k"] * 20, "en", 2100), ["authors"]), ((*GOOD[:2], ["A"] * 10 + [" "], ["k"] * 21, "en", 2101), ["keywords", "year"]),
        ((*GOOD[:2], ["a" * 161], ["k" * 80], "de", 2000), ["authors"]), ((None,) * 6, ["title", "abstract", "authors", "keywords", "program", "year"]),
        ((*GOOD[:4], "xx", 1979), ["program", "year"]), ((*GOOD[:2], ["A", None], ["k" * 81], "en", 2000), ["keywords"]),
    ]
    rows = spark.createDataFrame([(k, *c[0]) for k, c in enumerate(cases)], COLUMNS)
    assert [r.f for r in rows.select("k", entry_faults(["en", "de"]).alias("f")).orderBy("k").collect()] == [c[1] for c in cases]


def test_edges_pairs_and_requests(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 3), (3, 3), (None, 1), (None, None), (4, 5)], "a int, b int")
    got = {(r.a, r.b): (r.fault, r.n) for r in edge_faults(edges, "a", "b").collect()}
    assert got == {(1, 2): ("repeated", 2), (3, 3): ("self", 2), (None, 1): ("missing end", 1), (None, None): ("missing end", 1)}
    rows = spark.createDataFrame([(1, None), (None, 1), (None, None), (1, 1)], "a int, b int")
    assert unpaired(rows, "a", "b").count() == 2
    asked = [(1, "A@x", "pending"), (2, " a@X ", "pending"), (3, "a@x", "denied"), (4, None, "pending"), (5, None, "pending"), (6, "b@x", "pending")]
    rows = spark.createDataFrame(asked, "id int, email string, status string")
    assert [tuple(r) for r in repeated_pending(rows).collect()] == [("a@x", 2, 1)]
    assert edge_faults(edges.limit(0), "a", "b").count() == 0 and repeated_pending(rows.filter(F.lit(False))).count() == 0
