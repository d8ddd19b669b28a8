"""Values as forms and requests give them: lists, authors' names, references, addresses and instants, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarlens.functions.lines import let
from scholarlens.functions.names import PARTICLES
from scholarlens.functions.text import squeezed

#: The longest name of a client's program that is kept.
AGENT = 255
_INSTANT = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{3}(?:\d{3})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def author_names(value: str | Column) -> Column:
    """Names of a line: parts at semicolons if there is one, else at commas before a capital; squeezed, blank ones left out."""
    value = F.trim(F.coalesce(_column(value), F.lit("")))
    parts = F.when(value.contains(";"), F.split(value, ";")).otherwise(F.split(value, r",\s*(?=[A-Z])"))
    return F.filter(F.transform(parts, squeezed), lambda x: x != "")


def listed_values(value: str | Column, authors: bool = False) -> Column:
    """A list given as JSON or as a line: of ``authors`` by their rule, else of parts between commas.

    Text that opens a JSON list and is none is read as a line. Null is an empty list.
    """
    text = F.trim(F.coalesce(_column(value), F.lit("")))
    parsed = F.when(text.rlike(r"(?s)^\[.*\]$"), F.from_json(text, "array<string>"))
    plain = author_names(text) if authors else F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parsed, plain)


def name_parts(name: str | Column) -> Column:
    """(given, surname): at the comma if there is one, else the last word with the particles before it; one word is a surname."""

    def parts(x: Column) -> Column:
        particles = f"(?:(?i:{'|'.join(sorted(PARTICLES))})\\s+)*"
        natural = rf"^(\S+(?:\s+\S+)*?)\s+({particles}\S+)$"
        comma, alone = x.contains(","), ~x.rlike(r"\s")
        given = F.when(comma, F.trim(F.regexp_extract(x, r"(?s)^[^,]*,(.*)$", 1))).when(alone, F.lit("")).otherwise(F.regexp_extract(x, natural, 1))
        surname = F.when(comma, F.trim(F.split_part(x, F.lit(","), F.lit(1)))).when(alone, x).otherwise(F.regexp_extract(x, natural, 2))
        return F.struct(squeezed(given).alias("given"), squeezed(surname).alias("surname"))

    return let(squeezed(_column(name)), parts)


def initials(given: Column) -> Column:
    words = F.filter(F.split(F.trim(F.replace(given, F.lit("."), F.lit(" "))), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")


def _joined(*parts: Column, by: str) -> Column:
    return F.concat_ws(by, *[F.nullif(p, F.lit("")) for p in parts])


def reference(authors: Column, year: str | Column, title: str | Column, style: str) -> Column:
    """A reference in the style "apa", "ieee" (above six authors et al.) or "mla" (above two et al.); blank authors are left out.

    Without a year it says "n.d."; without authors it begins with what comes next.
    """
    year, title = F.coalesce(_column(year).cast("string"), F.lit("n.d.")), _column(title)
    people = F.transform(F.filter(authors, lambda a: F.trim(a) != ""), name_parts)

    def apa(p: Column) -> Column:
        return _joined(p["surname"], initials(p["given"]), by=", ")

    def ieee(p: Column) -> Column:
        return _joined(initials(p["given"]), p["surname"], by=" ")

    def mla(p: Column) -> Column:
        return _joined(p["surname"], p["given"], by=", ")

    def with_people(p: Column) -> Column:
        n, first, last = F.size(p), F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)
        if style == "mla":
            both = F.concat(mla(first), F.lit(", and "), _joined(last["given"], last["surname"], by=" "))
            who = F.when(n > 2, F.concat(mla(first), F.lit(", et al. "))).when(n == 2, F.concat(both, F.lit(". "))).when(n == 1, F.concat(mla(first), F.lit(". ")))
            return F.concat(F.coalesce(who, F.lit("")), F.lit('"'), title, F.lit('." '), year, F.lit("."))
        named = F.transform(p, ieee if style == "ieee" else apa)
        before, end = F.array_join(F.slice(named, 1, F.greatest(n - 1, F.lit(0))), ", "), F.get(named, n - 1)
        if style == "ieee":
            who = F.when(n > 6, F.concat(F.get(named, F.lit(0)), F.lit(" et al., "))).when(n > 1, F.concat(before, F.lit(" and "), end, F.lit(", "))).when(n == 1, F.concat(end, F.lit(", ")))
            return F.concat(F.coalesce(who, F.lit("")), F.lit('"'), title, F.lit('," '), year, F.lit("."))
        who = F.when(n > 1, F.concat(before, F.lit(", & "), end, F.lit(" "))).when(n == 1, F.concat(end, F.lit(" ")))
        return F.concat(F.coalesce(who, F.lit("")), F.lit("("), year, F.lit("). "), title, F.lit("."))

    return let(people, with_people)


def client_address(forwarded: str | Column, remote: str | Column) -> Column:
    """The first address that a request was forwarded for, else the one it came from."""
    forwarded = _column(forwarded)
    return F.when(F.length(forwarded) > 0, F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))).otherwise(_column(remote))


def agent(name: str | Column) -> Column:
    return F.substring(_column(name), 1, AGENT)


def instant(text: str | Column) -> Column:
    """An ISO 8601 date or instant, in UTC where it names no zone; null for any other text."""
    text = F.trim(_column(text))
    zoned = F.regexp_replace(F.when(text.rlike(r"[T ].*(?:Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z"))), r"([+-]\d{2})(\d{2})$", "$1:$2")
    # Spark reads no instant without seconds
    zoned = F.regexp_replace(zoned, r"([T ]\d{2}:\d{2})([Z+-])", "$1:00$2")
    dated = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(zoned)
    return F.when(text.rlike(_INSTANT), dated.try_cast("timestamp"))
