"""Words one edit apart by equality joins, and readings repaired by a second one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a line that can be repaired.
FEWEST, MOST = 3, 7


def deletions(word: str) -> Column:
    """A word and all that is left of it without one letter, each once."""
    length = F.length(word)
    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    shorter = F.transform(places, lambda k: F.concat(F.substring(F.col(word), F.lit(1), k - 1), F.substring(F.col(word), k + 1, length)))
    return F.array_distinct(F.concat(F.array(word), shorter))


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct ``words`` (word) that one insertion, deletion or change of a letter makes equal.

    Such two words share one of their deletions, so they meet by an equality join on
    those; what shares one and is two edits apart is told by the distance. A word has
    one key more than letters, and a key is shared by no more words than there are
    letters times places. Null words are left out.
    """
    rows = words.filter("word is not null").select("word").distinct()
    keys = rows.select("word", F.explode(deletions("word")).alias("key"))
    met = keys.select(F.col("word").alias("a"), "key").join(keys.select(F.col("word").alias("b"), "key"), "key").filter("a < b")
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


_TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[.'’\-][A-Za-zÀ-ÖØ-öø-ÿ]+)*"


def _letters(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"[^\p{L}]", "")


def repaired_lines(lines: DataFrame, readings: DataFrame) -> DataFrame:
    """``lines`` (doc, line, text) with ``repaired``: one word of a line of names set right where a second reading agrees on all others.

    A line is looked at if it has three to seven words, one of them an initial, and
    stands before the word ABSTRACT. Runs of as many words in the part of ``readings``
    (doc, text) before that word may differ from it in one word that is no initial and
    one letter apart. The word is taken if just one place of the line has such runs and
    they spell it in one way. Lines meet runs by an equality join on the document, the
    number of words, the place and the words around it; keys (doc, line) and doc must
    be unique.
    """
    tokens = F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))
    own = lines.filter(~F.col("text").rlike(r"(?i)\bABSTRACT\b")).select("doc", "line", tokens.alias("t"))
    own = own.withColumn("w", F.transform("t", _letters)).withColumn("n", F.size("t"))
    own = own.filter(F.col("n").between(FEWEST, MOST) & F.exists("w", lambda x: F.length(x) == 1))
    own = own.select("doc", "line", "n", "w", F.posexplode("w").alias("k", "word")).filter(F.length("word") > 1)
    own = own.select("doc", "line", "n", "k", "word", _around("w", F.col("k")).alias("around"))
    head = F.split("text", r"(?i)\bABSTRACT\b", 2)[0]
    other = readings.select("doc", F.regexp_extract_all(head, F.lit(_TOKEN), F.lit(0)).alias("t")).withColumn("w", F.transform("t", _letters))
    wanted = own.select("doc", "n").distinct()
    runs = other.join(wanted, "doc").filter(F.size("t") >= F.col("n"))
    runs = runs.select("doc", "n", "t", "w", F.explode(F.sequence(F.lit(1), F.size("t") - F.col("n") + 1)).alias("at"))
    runs = runs.select("doc", "n", F.slice("t", F.col("at"), F.col("n")).alias("t"), F.slice("w", F.col("at"), F.col("n")).alias("w"))
    runs = runs.select("doc", "n", "t", "w", F.posexplode("w").alias("k", "word"))
    runs = runs.select("doc", "n", "k", F.col("word").alias("other"), F.get("t", F.col("k")).alias("spelt"), _around("w", F.col("k")).alias("around")).distinct()
    met = own.join(runs, ["doc", "n", "k", "around"]).filter(F.levenshtein("word", "other", 1) == 1)
    ways = met.groupBy("doc", "line", "k").agg(F.count_distinct("spelt").alias("ways"), F.min("spelt").alias("spelt")).filter("ways = 1")
    sure = ways.groupBy("doc", "line").agg(F.count("*").alias("places"), F.min("k").alias("k"), F.min("spelt").alias("spelt")).filter("places = 1")
    # the text before the k-th word, the word, and the rest
    before = F.concat(F.lit(rf"^((?:.*?{_TOKEN}){{"), F.col("k").cast("string"), F.lit(rf"}}.*?){_TOKEN}"))
    joined = lines.join(sure.drop("places"), ["doc", "line"], "left")
    new = F.regexp_replace("text", before, F.concat(F.lit("$1"), F.col("spelt")))
    return joined.select("doc", "line", "text", F.when(F.col("spelt").isNull(), F.col("text")).otherwise(new).alias("repaired"))


def _around(words: str, k: Column) -> Column:
    """The words of an array in order, but for one place."""
    return F.array_join(F.transform(F.col(words), lambda w, i: F.when(i == k, F.lit("*")).otherwise(w)), " ")
