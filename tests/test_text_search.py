import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarlens.functions.glossary import TERMS, term_mentions, whole_term
from scholarlens.operators.encoder import DIM, composed, encode, encoded, place_of, source_hash, with_vectors
from scholarlens.operators.title_match import qualified, title_hits
from scholarlens.functions.text import normal_title

DASH = r"[\s\-‐-―−]+"


def forms(term):
    short, long, sensitive = term
    a = re.compile(rf"(?<!\w){re.escape(short.upper() if sensitive else short)}s?(?!\w)", 0 if sensitive else re.I)
    return a, re.compile(r"(?<!\w)" + DASH.join(map(re.escape, long.split())) + r"s?(?!\w)", re.I)


def term_of(query):
    q = re.sub(DASH, " ", query or "").strip()
    return next((k for k, t in enumerate(TERMS) if q and any(p.fullmatch(q) for p in forms(t))), None)


def count(text, k):
    return sum(len(p.findall(text or "")) for p in forms(TERMS[k]))


def fold(text):
    t = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join("".join(" " if unicodedata.category(c) == "Pd" or c == "−" else c for c in t).split())


def matches(query, title, corpus):
    """The rules, one after the other."""
    q, t = fold(query), fold(title)
    if not q:
        return False
    name = fold(re.split(r":|\s[-‐-―−]+\s|[–—―]", title or "", maxsplit=1)[0])
    if q in (t, name):
        return True
    term = term_of(query)
    if term is not None:
        return count(title, term) > 0
    whole = re.compile(rf"(?<!\w){re.escape(q)}(?!\w)")
    several = any(not c.isalnum() and not c.isspace() for c in q) or " " in q
    rare = len(q) >= 3 and sum(bool(whole.search(fold(x))) for x in corpus) <= 3
    return (several or rare) and bool(whole.search(t))


TITLES = [
    "Farmix: Centralized IoT store", "Farmix - a second one", "farmix", "Web-Based Farming", "web based farming", "The internet-of-things cart", "Patriot carts",
    "C++ for all", "C + + for none", "System one", "A system", "Systems", "system three", "The System: four", "Rare gem", None, "", "   ", "IT in schools", "it in schools",
    "Users' user interfaces", "Café — straße", "CAFE", "a.b", "a.b.c", "axb", "(OCR) reader", "optical\tcharacter recognition", "under_score word", "score",
]
QUERIES = [
    None, "", "  ", "Farmix", "FARMIX", "iot", "Internet of Things", "internet-of-things", "IT", "it", "web-based", "Web Based", "system", "gem", "ge", "rare gem", "c++", "+", "a.b",
    "a.b.", "ocr", "user interface", "UIs", "café", "STRASSE", "cart", "carts", "score", "one", "centralized iot", "(ocr)", "Farming", "in schools", "b", ".",
]


def test_title_rules_of_many_queries_at_once(spark):
    titles = spark.createDataFrame(list(enumerate(TITLES)), "id long, title string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    got = {(r.query_id, r.id) for r in title_hits(queries, titles, titles, TERMS).collect()}
    expect = {(a, b) for a, q in enumerate(QUERIES) for b, t in enumerate(TITLES) if matches(q, t, TITLES)}
    assert got == expect
    assert title_hits(queries.limit(0), titles, titles, TERMS).collect() == [] and title_hits(queries, titles.limit(0), titles, TERMS).collect() == []


def test_rarity_is_told_from_the_corpus_not_from_what_is_listed(spark):
    corpus = spark.createDataFrame([(k, "gem") for k in range(4)], "id long, title string")
    listed = corpus.filter("id = 0").withColumn("title", F.lit("a gem here"))
    asked = spark.createDataFrame([(1, "gem"), (2, "here")], "query_id int, query string")
    assert {r.query_id for r in title_hits(asked, listed, corpus, TERMS).collect()} == {2}
    norm = corpus.select("id", normal_title("title").alias("norm"))
    assert {r.query_id: r.qualifies for r in qualified(asked, norm, TERMS).collect()} == {1: False, 2: True}


def test_whole_terms_and_mentions(spark):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "id int, q string").select("id", whole_term("q", TERMS).alias("t"))
    assert {r.id: r.t for r in asked.collect()} == {k: term_of(q) for k, q in enumerate(QUERIES)}
    texts = [t or "" for t in TITLES] + ["IoT, IoTs and the Internet of  Things; patriot iot_x", "AI ai Ai's artificial-intelligence", "GUI UIs", "BHWs and barangay health workers"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.term): r.n for r in term_mentions(frame, TERMS).collect()}
    assert got == {(i, k): n for i, t in enumerate(texts) for k in range(len(TERMS)) if (n := count(t, k))}
    some = spark.createDataFrame([(0,)], "term int")
    assert {r.term for r in term_mentions(frame, TERMS, some).collect()} == {0}


def test_encoded_texts():
    v = np.array(encoded("The cat and THE dog"))
    plain = np.zeros(DIM)
    for w in ("the", "cat", "and", "the", "dog"):
        at, sign = place_of(w)
        plain[at] += sign
    assert v == pytest.approx(plain / np.linalg.norm(plain)) and encoded("dog the and CAT the") == pytest.approx(v)
    assert encoded(None) == encoded(" !? ") == [0.0] * DIM


def test_stored_vectors_stand_only_while_fresh_and_usable(spark):
    unit = [1.0] + [0.0] * (DIM - 1)
    cases = [(1, "a b", unit, "a b"), (2, "a b", unit, "old"), (3, "a b", None, "a b"), (4, "a b", [0.0] * DIM, "a b"), (5, "a b", unit[:9], "a b"), (6, "a b", [float("nan")] + unit[1:], "a b"), (7, None, unit, None), (8, "x", [2 * x for x in unit], "x")]
    rows = spark.createDataFrame(cases, "id long, title string, stored array<double>, made_from string")
    got = {r.id: (r.origin, r.vector) for r in with_vectors(rows, F.col("title"), F.col("stored"), source_hash("made_from") == source_hash("title")).collect()}
    assert {k: o for k, (o, _) in got.items()} == {1: "stored", 8: "stored", **dict.fromkeys((2, 3, 4, 5, 6, 7), "encoded")}
    assert got[1][1] == got[8][1] == unit and got[2][1] == pytest.approx(encoded("a b")) and got[7][1] == [0.0] * DIM
    assert rows.select(encode("title").alias("v")).filter("v is null").count() == 1


def test_composed_texts(spark):
    rows = spark.createDataFrame([(" T ", [" a ", "", "b"], "x "), (None, None, None), ("T", [], " ")], "t string, k array<string>, a string")
    assert [r[0] for r in rows.select(composed("t", "k", "a")).collect()] == ["T\n\na b\n\nx", "", "T"]
