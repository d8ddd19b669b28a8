"""Column functions over text: normal forms, tokens, mentions and set comparisons."""

from __future__ import annotations

import functools
import itertools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scholarlens.functions.lines import let

#: Words that a title comparison leaves out.
TITLE_STOPS = ["the", "and", "for", "with", "from", "using", "based", "that", "this", "are", "was", "des", "les", "der", "die", "las", "los", "que"]


def squeezed(text: str | Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: str | Column) -> Column:
    """Squeezed and in one case, with sharp s as ss."""
    return F.replace(F.lower(squeezed(text)), F.lit("ß"), F.lit("ss"))


def _normal_title(text: str | None) -> str | None:
    if text is None:
        return None
    plain = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(" " if unicodedata.category(c) == "Pd" else c for c in plain).split())


# Spark has no Unicode normalisation
@F.pandas_udf(StringType())
def normal_title(texts: pd.Series) -> pd.Series:
    """Compatibility form, folded case, dashes as spaces, white space squeezed."""
    return texts.map(_normal_title)


@functools.cache
def _images() -> tuple[dict[str, str], dict[str, str]]:
    """What ASCII the compatibility forms of all other characters have: those with one letter, those with more."""
    found = {}
    for code in itertools.chain(range(0x80, 0xD800), range(0xE000, sys.maxunicode + 1)):
        image = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c.isascii())
        if image:
            found[chr(code)] = image
    return {c: x for c, x in found.items() if len(x) == 1}, {c: x for c, x in found.items() if len(x) > 1}


def ascii_form(text: str | Column) -> Column:
    """The ASCII of a text's compatibility form: accents are dropped, ligatures split, wide forms narrowed, other characters left out.

    Each character has its form by itself, so it is done by a table of characters and texts need not go to Python.
    """
    one, more = _images()
    table = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])

    def formed(t: Column) -> Column:
        # a pattern of all these characters would try each of them at every place
        several = F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[^\x00-\x7F]"), F.lit(0))), lambda c: c.isin(list(more)))
        split = F.aggregate(several, t, lambda done, c: F.replace(done, c, F.element_at(table, c)))
        return F.regexp_replace(F.translate(split, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")

    return let(F.col(text) if isinstance(text, str) else text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), formed(t)).otherwise(t))


def plain_words(text: str | Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spaced(tokens: Column) -> Column:
    """Tokens in one text, each between spaces of its own, so that runs can be counted by splitting."""
    return F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))


def mentions(spaced_text: str | Column, phrase: str) -> Column:
    """How often a phrase of lower-case words stands in a :func:`spaced` text."""
    needle = " " + "  ".join(phrase.split()) + " "
    return F.size(F.split(spaced_text, needle)) - 1


def is_about(head: Column, full: Column, length: Column, phrase: str) -> Column:
    """Is a text about a phrase: named in its head, or three times and once in 10,000 characters at least?"""
    n = mentions(full, phrase)
    return (mentions(head, phrase) > 0) | ((n >= 3) & (n * 10_000 / length >= 1.0))


def title_terms(title: str | Column) -> Column:
    """Distinct words of a title with three ASCII letters or more that are no stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(title), r"[^a-z\s]", " ")), r"\s+")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(TITLE_STOPS))
    return F.array_distinct(kept)


def name_segment(title: str | Column) -> Column:
    """What stands before the first colon or dash with spaces."""
    return F.trim(F.split(title, r":|\s[-–—]\s|—", 2)[0])


def whole_word(text: str | Column, word: str) -> Column:
    """Does a word stand in a text with no letter, digit or underscore at its sides?"""
    text = F.col(text) if isinstance(text, str) else text
    escaped = "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in word)
    return text.rlike(rf"(?Ui)(?<!\w){escaped}(?!\w)")


def percent(score: str | Column) -> Column:
    """A share as a percentage with one place, halves up."""
    return F.round((F.col(score) if isinstance(score, str) else score) * 100, 1)
