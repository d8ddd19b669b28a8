"""Title matches of many queries at once: which queries may match by a part of a title, and the titles that each one names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.functions.glossary import term_mentions, whole_term
from scholarlens.functions.text import normal_title

#: Letters that a single word must have to be a name, and titles that may have it.
SHORTEST, MOST_TITLES = 3, 3

_WORD = r"[\p{L}\p{N}_]+"


def has_punctuation(text: str | Column) -> Column:
    """Has a text a character that is no letter, digit or white space?"""
    return (F.col(text) if isinstance(text, str) else text).rlike(r"[^\p{L}\p{N}\s]")


def name_part(title: str | Column) -> Column:
    """A title up to its first colon, long dash, or hyphen between blanks."""
    return F.split(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")), r":|\s[-‐-―−]+\s|[–—―]", 2)[0]


def _keys(text: str) -> Column:
    """What a text can be found by: its words, and each of its other characters but for white space."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{_WORD}|[^\p{{L}}\p{{N}}_\s]"), F.lit(0)))


def qualified(queries: DataFrame, titles: DataFrame, terms: list) -> DataFrame:
    """``queries`` (query_id, query) with ``norm``, ``term`` (a glossary term that is all of it) and ``qualifies``.

    A query qualifies if it is a glossary term, has punctuation, or is of two words or
    more; a single word of three characters or more does if at most three ``titles``
    (id, norm) have it as a whole word. Blank and null queries never do.
    """
    rows = queries.withColumn("norm", normal_title(F.coalesce("query", F.lit("")))).withColumn("term", whole_term("query", terms))
    rows = rows.withColumn("single", ~has_punctuation("norm") & ~F.contains("norm", F.lit(" ")) & (F.length("norm") >= SHORTEST))
    asked = rows.filter("single and term is null").select(F.col("norm").alias("word")).distinct()
    words = titles.select(F.explode(F.array_distinct(F.regexp_extract_all("norm", F.lit(_WORD), F.lit(0)))).alias("word"))
    spread = words.join(asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("titles"))
    rows = rows.join(spread, F.col("single") & (F.col("norm") == F.col("word")), "left").drop("word")
    several = has_punctuation("norm") | F.contains("norm", F.lit(" "))
    rare = F.col("single") & (F.coalesce("titles", F.lit(0)) <= MOST_TITLES)
    return rows.withColumn("qualifies", (F.col("norm") != "") & (F.col("term").isNotNull() | several | rare)).drop("single", "titles")


def title_hits(queries: DataFrame, titles: DataFrame, corpus: DataFrame, terms: list) -> DataFrame:
    """(query_id, id): the ``titles`` (id, title) that each of ``queries`` (query_id, query) matches.

    A title matches a query that it equals, or whose name part it equals, after
    folding; one that mentions the query's glossary term in either form; and, for a
    query that qualifies by the titles of ``corpus`` (id, title) and is no term, one in
    which the query stands between word ends. Every way is an equality join: on the
    whole, on the name part, on the words that a term begins with, or on a word of the
    query that a title must have as well; the last two are confirmed by a pattern.
    """
    folded = titles.select("id", "title", normal_title(F.coalesce("title", F.lit(""))).alias("norm"))
    folded = folded.withColumn("name", normal_title(name_part("title")))
    known = corpus.select("id", normal_title(F.coalesce("title", F.lit(""))).alias("norm"))
    asked = qualified(queries, known, terms).filter("norm <> ''")
    whole = asked.select("query_id", "norm").join(folded.select("id", "norm"), "norm")
    named = asked.select("query_id", F.col("norm").alias("name")).join(folded.select("id", "name"), "name")
    mentioned = term_mentions(titles.select("id", F.col("title").alias("text")), terms, asked.filter("term is not null").select("term"))
    mentioned = asked.filter("term is not null").select("query_id", "term").join(mentioned, "term")
    # word characters at the query's ends must not go on in the title
    escaped = F.regexp_replace("norm", r"([^\p{L}\p{N}_\s])", r"\\$1")
    parts = asked.filter("qualifies and term is null").select(
        "query_id", F.concat(F.lit(r"(?U)(?<!\w)"), escaped, F.lit(r"(?!\w)")).alias("pattern"), F.array_max(_keys("norm")).alias("key")
    )
    near = folded.select("id", "norm", F.explode(_keys("norm")).alias("key")).join(parts, "key").filter(F.rlike("norm", F.col("pattern")))
    hits = [x.select("query_id", "id") for x in (whole, named, mentioned, near)]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).unionByName(hits[3]).distinct()
