"""Fields of a manuscript's text as column expressions: gate, title, authors, abstract, keywords, year, program.

Every field is found on its own, so one that fails leaves the others; a field is a
struct (value, confidence), both null where nothing was found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarlens.functions.lines import let

#: Line patterns that tell a thesis, in the order in which they are listed.
MARKERS = {
    "abstract": r"abstract",
    "table_of_contents": r"table\s+of\s+contents",
    "chapter": r"chapter\s+(?:[0-9]+|[ivx]+|one)\b.*",
    "approval_sheet": r"approval\s+sheet",
    "acknowledgement": r"acknowledge?ments?",
    "presented_to": r".*\bpresented\s+to\s+the\s+faculty\b.*",
    "partial_fulfillment": r".*\bin\s+partial\s+fulfil?lment\b.*",
    "references": r"references|bibliography|literature\s+cited",
}
READABLE = 200
_STOPS = r"key\s?words?\b|chapter\b|table\s+of\s+contents|introduction\s*$|references\s*$|acknowledge"
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


def _field(value: Column, confidence: Callable[[Column], Column]) -> Column:
    def field(v: Column) -> Column:
        found = v.isNotNull() & (v != "")
        return F.struct(F.when(found, v).alias("value"), F.when(found, confidence(v)).alias("confidence"))

    return let(value, field)


def has_line(text: str, pattern: str) -> Column:
    return F.coalesce(F.col(text).rlike(rf"(?mi)^[ \t]*(?:{pattern})[ \t]*$"), F.lit(False))


def markers_of(text: str) -> Column:
    """Names of the structural markers that the text has, in their fixed order."""
    return F.array_compact(F.array(*[F.when(has_line(text, p), F.lit(name)) for name, p in MARKERS.items()]))


def gate(text: str, needed: int = 2) -> Column:
    """"pass" with enough markers, else "unreadable" for a short text and "not_a_thesis" for any other."""
    enough = F.size(markers_of(text)) >= needed
    short = F.length(F.coalesce(F.trim(text), F.lit(""))) < READABLE
    return F.when(short, "unreadable").when(enough, "pass").otherwise("not_a_thesis")


def letter_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))


def abstract_of(text: str) -> Column:
    """What follows a line "abstract" up to the next section, if it reads like one."""
    body = F.regexp_extract(text, rf"(?mi)^[ \t]*abstract[ \t]*$\n([\s\S]*?)(?=^[ \t]*(?:{_STOPS})|\z)", 1)
    body = F.trim(F.regexp_replace(body, r"\s+", " "))

    def good(b: Column) -> Column:
        return F.when(F.length(b).between(20, 6000) & (F.size(F.split(b, " ")) >= 20) & (letter_share(b) >= 0.6), b)

    return _field(let(body, good), lambda b: F.when(F.length(b) >= 200, "high").otherwise("medium"))


def keywords_of(text: str) -> Column:
    """Items of a line that begins with a keyword label, at most fifteen, repeats in another case left out."""
    line = F.regexp_extract(text, r"(?mi)^[ \t]*key\s?words?[ \t]*[:—-][ \t]*(.+)$", 1)
    items = F.filter(F.transform(F.split(line, r"[;,·•|]"), lambda x: F.trim(F.regexp_replace(x, r"[.\s]+$", ""))), lambda x: F.length(x).between(1, 64))

    def distinct(given: Column) -> Column:
        lower = F.transform(given, lambda x: F.lower(x))
        return F.slice(F.filter(given, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1), 1, 15)

    def field(kept: Column) -> Column:
        sure = F.when(F.size(kept) >= 3, "high").otherwise("medium")
        return F.struct(F.when(F.size(kept) > 0, F.array_join(kept, "; ")).alias("value"), F.when(F.size(kept) > 0, sure).alias("confidence"))

    return let(let(items, distinct), field)


def year_of(text: str, last: int) -> Column:
    """The latest month and year of the first 60 lines, else a year alone on a line, from 1980 to ``last``."""
    page = F.substring_index(F.col(text), "\n", 60)
    page = F.split(page, r"(?mi)^[ \t]*(?:abstract|chapter\b)", 2)[0]
    dated = F.regexp_extract_all(page, F.lit(rf"(?i)\b(?:{_MONTHS})\s+(?:[0-9]{{1,2}},?\s+)?((?:19|20)[0-9]{{2}})\b"), F.lit(1))
    alone = F.regexp_extract_all(page, F.lit(r"(?m)^[ \t]*((?:19|20)[0-9]{2})[ \t]*$"), F.lit(1))
    found = let(dated, lambda d: F.when(F.size(d) > 0, d).otherwise(alone))
    return _field(F.array_max(F.filter(found, lambda y: y.cast("int").between(1980, last))), lambda y: F.lit("high"))


def title_of(text: str) -> Column:
    """The lines before the first blank line, up to three, joined."""
    block = F.regexp_extract(text, r"\A\s*((?:[^\n]*\S[^\n]*\n?){1,3})", 1)

    def sure(title: Column) -> Column:
        words = F.size(F.split(title, " "))
        return F.when(words.between(5, 15), "high").when(words >= 3, "medium").otherwise("low")

    return _field(F.trim(F.regexp_replace(block, r"\s+", " ")), sure)


def authors_of(text: str) -> Column:
    """Name lines after a line "by", up to a blank line, at most twelve."""
    block = F.regexp_extract(text, r"(?mi)^[ \t]*(?:by|researchers?|authors?)[ \t]*:?[ \t]*$\n((?:[^\n]*\S[^\n]*(?:\n|\z)){1,12})", 1)
    names = F.filter(F.transform(F.split(block, r"\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"[0-9@]"))
    return _field(F.array_join(names, "; "), lambda n: F.lit("low"))


def program_of(text: str, programs: dict[str, str]) -> Column:
    """The first program whose pattern stands on a line with a degree."""
    lines = F.filter(F.split(text, r"\n"), lambda x: x.rlike(r"(?i)\b(?:bachelor|master|doctor|degree|b\.?s\.?|m\.?s\.?)\b"))
    joined = F.lower(F.array_join(lines, "\n"))
    value = let(joined, lambda j: F.coalesce(*[F.when(j.rlike(p), F.lit(name)) for name, p in programs.items()]))
    return _field(value, lambda v: F.lit("high"))
