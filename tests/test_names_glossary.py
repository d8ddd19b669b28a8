import re

import pytest
from pyspark.sql import functions as F

from scholarlens.functions import glossary as g
from scholarlens.functions import names as n


def column(spark, rows, expression):
    frame = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], "k long, x string" + (", y string" if isinstance(rows[0], tuple) else ""))
    return [r.z for r in frame.select("k", expression.alias("z")).orderBy("k").collect()]


def test_contacts(spark):
    texts = ["Ana Cruz ana@x.edu.ph", "call 0917-123-4567 now", "id 1234567", "room 12", None]
    assert column(spark, texts, n.has_contact("x")) == [True, True, True, False, None]
    assert column(spark, texts, n.without_contacts("x")) == ["Ana Cruz", "call now", "id", "room 12", None]
    assert column(spark, ["a@x.edu", "a@s.X.edu", "a@nx.edu"], n.is_institutional("x", "x.edu")) == [True, True, False]
    assert column(spark, ["abcdefghijk1", "abcdefghijkl", "short1"], n.strong_password("x")) == [True, False, False]


def test_despacing_and_edits(spark):
    assert column(spark, ["T H E S I S  O N  S E A\nplain line a b", "a b c"], n.despaced("x")) == ["THESIS ON SEA\nplain line a b", "a b c"]
    assert column(spark, [("thesis", "thesls"), ("ab", "abcd")], n.near("x", "y")) == [True, False]


def test_title_case(spark):
    titles = ["AI-POWERED MAP OF THE FARMER'S FIELD", "Already Mixed", "IOT: A SURVEY", None, "123"]
    assert column(spark, titles, n.title_case(F.col("x"))) == ["AI-Powered Map of the Farmer's Field", "Already Mixed", "IOT: A Survey", None, "123"]


def test_token_set_ratio(spark):
    rows = [("bachelor of science", "science of bachelor"), ("a b", "a b c"), ("abc", "xyz"), ("", "x"), ("don honorio state", "don honorlo state univ")]
    got = column(spark, rows, n.token_set_ratio(F.col("x"), F.col("y")))
    assert got[:4] == [100, 100, 0, 0] and 75 < got[4] < 100


def test_citation_styles():
    two, many = ["Ana M. Cruz", "Juan de la Rosa"], [f"A B{k}" for k in range(7)]
    assert n.citation(two, 2020, "On Maps", "apa") == "Cruz, A. M., & de la Rosa, J. (2020). On Maps."
    assert n.citation(two, 2020, "On Maps", "ieee") == 'A. M. Cruz and J. de la Rosa, "On Maps," 2020.'
    assert n.citation(two, None, "On Maps", "mla") == 'Cruz, Ana M., and Juan de la Rosa. "On Maps." n.d..'
    assert n.citation(many, 2020, "T", "ieee").startswith("A. B0 et al.") and "et al" in n.citation(many, 2020, "T", "mla")
    assert n.citation([], 2020, "T", "apa") == "(2020). T."
    assert n.split_name("Cruz, Ana") == ("Ana", "Cruz")


TERMS = [("IoT", "internet of things", False), ("IT", "information technology", True)]


def test_query_expansion(spark):
    queries = ["iot farms", "Internet-of-Things", "is it good", "IT SERVICES", "IT", "IoT and iots", None, " "]
    assert column(spark, queries, g.expansions("x", TERMS)) == [
        ["iot farms", "internet of things farms"],
        ["Internet-of-Things", "iot"],
        ["is it good"],
        ["IT SERVICES"],
        ["IT", "information technology"],
        ["IoT and iots", "internet of things and internet of thingss"],
        [],
        [],
    ]


def test_mentions_and_references(spark):
    assert column(spark, ["IoTs and internet-of-things; biota", ""], g.count_mentions("x", "IoT", "internet of things")) == [2, 0]
    assert column(spark, ["it is IT", "IT"], g.count_mentions("x", "IT", "information technology", True)) == [1, 1]
    assert column(spark, ["a\nReferences\nold\nREFERENCES\nnew", "0123456789"], g.references_of("x")) == ["\nnew", "89"]
    assert column(spark, ["uses a Support Vector Machine (SVM) and Bag of Words (BW)", None], g.acronym_candidates(F.col("x"))) == [["SVM\tSupport Vector Machine", "BW\tBag of Words"], []]


TITLE = "A Study of Old Maps in the North of Town"


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("Cruz (2020). A study of old maps in the north of town.", True),
        ("A study of old maps in the north", True),
        ("first line\n  A study of old-maps in the north, 3rd", True),
        ("See a study of old maps in the north.", False),
        ('"A study of old maps in the north of the sea"', False),
        ("Also (2020). A study of old mops in the north.", False),
        ("B. A study of old maps in the north of town and sea.", False),
        ("A study of old maps in the north of\ntown", True),
        ("One, two. Four small words here?", True),
        ("Four small words here too.", False),
    ],
)
def test_cited_titles(spark, text, hit):
    lists = spark.createDataFrame([(1, text), (2, None), (3, "")], "citing long, text string")
    titles = spark.createDataFrame([(7, TITLE), (8, "Too short title"), (9, None), (10, "Four small words here")], "cited long, title string")
    assert bool(g.titles_listed(lists, titles).collect()) == hit
