"""Values of forms against plain versions of their rules."""

import datetime
import itertools

from pyspark.sql import functions as F

from scholarlens.functions.names import citation, split_name
from scholarlens.functions.values import agent, author_names, client_address, instant, listed_values, name_parts, reference


def test_author_names(spark):
    cases = {
        None: [], "  ": [], "Ana Cruz, Ben Reyes": ["Ana Cruz", "Ben Reyes"], "Cruz, Ana; Reyes,  Ben ;": ["Cruz, Ana", "Reyes, Ben"],
        "Ana Cruz, jr.": ["Ana Cruz, jr."], "Ana Cruz,Ben Reyes": ["Ana Cruz", "Ben Reyes"], ";;": [], "Ana Cruz,": ["Ana Cruz,"],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    assert [r.n for r in rows.select(author_names("v").alias("n")).collect()] == list(cases.values())


def test_listed_values(spark):
    cases = {
        '["a, b", "c"]': (["a, b", "c"], ["a, b", "c"]), '["a", "b"': (['["a"', '"b"'], ['["a", "b"']), "a, b ,,c": (["a", "b", "c"], ["a, b ,,c"]),
        "[]": ([], []), "A B, C D": (["A B", "C D"], ["A B", "C D"]), None: ([], []), '["é"]': (["é"], ["é"]),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    got = rows.select(listed_values("v").alias("k"), listed_values("v", authors=True).alias("a")).collect()
    assert [(r.k, r.a) for r in got] == list(cases.values())


NAMES = ["Ana Cruz", "Juan Dela Cruz", "Juan de la Cruz", "de la Cruz", "Cruz, Ana B.", "Plato", "J. R. van der Berg", "Ana  Bea   Reyes", "Ñora Ñuñez"]


def test_name_parts_as_by_words(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    for r in rows.select("n", name_parts("n").alias("p")).collect():
        given, surname = split_name(r.n)
        assert (r.p.given, r.p.surname) == (" ".join(given.split()), surname)


def test_references_as_by_hand(spark):
    plain = [n for n in NAMES if "  " not in n]
    lists = [list(c) for n in (0, 1, 2, 3) for c in itertools.combinations(plain[:5], n)] + [plain[:6], plain[:7], plain[:4] + [" "]]
    rows = spark.createDataFrame([(k, a, y) for k, a in enumerate(lists) for y in (2020, None)], "k int, a array<string>, y int")
    got = rows.select("a", "y", *[reference(F.col("a"), "y", F.lit("A title"), s).alias(s) for s in ("apa", "ieee", "mla")]).collect()
    for r in got:
        for style in ("apa", "ieee", "mla"):
            assert r[style] == citation(r.a, r.y, "A title", style), (style, r.a)
    assert got[2].apa == "Cruz, A. (2020). A title."


def test_addresses_agents_and_instants(spark):
    rows = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "9.9.9.9"), ("", "9.9.9.9"), (None, "9.9.9.9"), (" 3.3.3.3 ", None), (None, None)], "f string, r string")
    assert [r.a for r in rows.select(client_address("f", "r").alias("a")).collect()] == ["1.1.1.1", "9.9.9.9", "9.9.9.9", "3.3.3.3", None]
    assert spark.createDataFrame([("x" * 300,)], "a string").select(F.length(agent("a"))).first()[0] == 255
    texts = [
        "2024-01-05", "2024-01-05T10:00", "2024-01-05T10:00:00", "2024-01-05 10:00:00.123", "2024-01-05T10:00:00Z", "2024-01-05T10:00:00+08:00",
        "2024-01-05T10:00:00-0330", "2024-01-05T10:00:00.123456",
    ]
    bad = ["", "2024", "yesterday", "2024-13-01", "2024-02-30", "05/01/2024", "2024-01-05T25:00", "2024-01-05T", None]
    rows = spark.createDataFrame([(t,) for t in texts + bad], "t string").select(F.unix_micros(instant("t")).alias("u"))
    want = []
    for t in texts:
        at = datetime.datetime.fromisoformat(t)
        at = at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)
        want.append((at - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1))
    assert [r.u for r in rows.collect()] == want + [None] * len(bad)
