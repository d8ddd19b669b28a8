"""Names, titles and contacts: column expressions, and small helpers behind vectorised functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Acronyms that keep their capitals in a title.
ACRONYMS = frozenset("AI AR API CNN GIS GPS GSM HTML ICT IOT IT LAN ML NLP OCR PHP PLC QR RFID SMS SQL SVM UI USB UX VR WAN XML".split())
_SMALL = frozenset("a an and as at by for from in of on or the to with".split())
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
MOBILE = r"(?:\+?63|0)[\s-]?9[0-9]{2}[\s-]?[0-9]{3}[\s-]?[0-9]{4}"
DIGITS = r"[0-9]{7,}"
PARTICLES = frozenset("da de del dela der di la las los san santa van von".split())


def has_contact(text: str | Column) -> Column:
    """Does a text hold an e-mail address, a mobile number or seven digits in a row?"""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(f"(?:{EMAIL})|(?:{MOBILE})|(?:{DIGITS})")


def without_contacts(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"(?:{EMAIL})|(?:{MOBILE})|(?:{DIGITS})", " "), r"\s+", " "))


def is_institutional(email: str | Column, domain: str) -> Column:
    """An address of ``domain`` or one of its subdomains."""
    return F.lower(email).rlike(rf"^[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)*{re.escape(domain.lower())}$")


def strong_password(word: str | Column) -> Column:
    word = F.col(word) if isinstance(word, str) else word
    return (F.length(word) >= 12) & word.rlike("[A-Za-z]") & word.rlike("[0-9]")


def despaced(text: str | Column) -> Column:
    """Lines that are set letter by letter ("T H E S I S") closed up; words in them are two spaces apart.

    A line counts as such with four tokens or more, of which 60 % are single
    characters and four are single letters.
    """

    def line(x: Column) -> Column:
        parts = F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != "")
        single = F.filter(parts, lambda t: F.length(t) == 1)
        letters = F.filter(single, lambda t: t.rlike(r"\p{L}"))
        spaced = (F.size(parts) >= 4) & (F.size(single) >= 0.6 * F.size(parts)) & (F.size(letters) >= 4)
        words = F.transform(F.split(F.trim(x), r"\s{2,}"), lambda w: F.regexp_replace(w, r"\s", ""))
        return F.when(spaced, F.array_join(words, " ")).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def near(a: str | Column, b: str | Column) -> Column:
    """One edit apart at most."""
    return F.levenshtein(a, b) <= 1


def _title_case(text: str | None) -> str | None:
    if text is None or text.upper() != text or not any(c.isalpha() for c in text):
        return text

    def part(word: str, first: bool) -> str:
        bare = word.strip(".,:;()'\"")
        if bare in ACRONYMS:
            return word
        if word.endswith("'S"):
            return part(word[:-2], first) + "'s"
        lower = word.lower()
        if not first and lower.strip(".,:;") in _SMALL:
            return lower
        return re.sub(r"[^\W\d_]", lambda m: m[0].upper(), lower, count=1)

    out = []
    for k, word in enumerate(text.split(" ")):
        first = k == 0 or out[-1].endswith(":")
        pieces = re.split(r"([-/])", word)
        out.append("".join(p if p in "-/" else part(p, first or j > 0) for j, p in enumerate(pieces) if p))
    return " ".join(out)


# per-word rules with exceptions; no built-in covers them
@F.pandas_udf(StringType())
def title_case(titles: pd.Series) -> pd.Series:
    """Titles in capitals set in title case; acronyms, hyphenated parts and possessives kept. Others stay."""
    return titles.map(_title_case)


def _ratio(a: str, b: str) -> float:
    """100 x (1 - edits / length) with insertions and deletions, from the longest common subsequence."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    if both and (left == both or right == both):
        return 100.0
    return max(_ratio(both, left) if both else 0.0, _ratio(both, right) if both else 0.0, _ratio(left, right))


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts as sets of words, 0 to 100; 100 when one holds the other."""
    return pd.Series([token_set(x, y) for x, y in zip(a, b)], dtype="float64")


def split_name(name: str) -> tuple[str, str]:
    """(given, surname): at the comma if there is one, else the last word with the particles before it."""
    if "," in name:
        surname, given = name.split(",", 1)
        return given.strip(), surname.strip()
    words = name.split()
    k = len(words) - 1
    while k > 1 and words[k - 1].lower() in PARTICLES:
        k -= 1
    return " ".join(words[:k]), " ".join(words[k:])


def _cited(name: str, style: str) -> str:
    given, surname = split_name(name)
    letters = " ".join(f"{w[0].upper()}." for w in given.replace(".", " ").split())
    if style == "mla":
        return f"{surname}, {given}" if given else surname
    if style == "ieee":
        return f"{letters} {surname}".strip()
    return f"{surname}, {letters}" if letters else surname


def citation(authors: list[str], year: int | None, title: str, style: str) -> str:
    """A reference in the style "apa", "ieee" (above six authors et al.) or "mla" (above two et al.)."""
    names = [_cited(a, style) for a in authors if a.strip()]
    if style == "mla":
        if len(names) > 2:
            who = f"{names[0]}, et al"
        elif len(names) == 2:
            given, surname = split_name(authors[1])
            who = f"{names[0]}, and {given} {surname}".strip()
        else:
            who = "".join(names)
        return f'{who}. "{title}." {year if year is not None else "n.d."}.'.lstrip(". ")
    if style == "ieee":
        who = f"{names[0]} et al." if len(names) > 6 else " and ".join(filter(None, [", ".join(names[:-1]), names[-1] if names else ""]))
        return f'{who}, "{title}," {year if year is not None else "n.d."}.'.lstrip(", ")
    who = names[0] if len(names) == 1 else f"{', '.join(names[:-1])}, & {names[-1]}" if names else ""
    return f"{who} ({year if year is not None else 'n.d.'}). {title}.".lstrip()
