"""Names of programs and institutions, as scans give them, held against what is known."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scholarlens.functions.lines import let
from scholarlens.functions.names import token_set

#: Programs and the spellings that stand for them, in the order in which a part of a name is looked for.
ALIASES = [
    ("bsis", "BS Information System"), ("bs-is", "BS Information System"), ("bs is", "BS Information System"),
    ("bs information systems", "BS Information System"), ("bs information system", "BS Information System"),
    ("bachelor of science in information systems", "BS Information System"), ("bachelor of science in information system", "BS Information System"),
    ("information systems", "BS Information System"), ("information system", "BS Information System"),
    ("bsit", "BS Information Technology"), ("bs-it", "BS Information Technology"), ("bs it", "BS Information Technology"),
    ("bs information technology", "BS Information Technology"), ("bs information technologies", "BS Information Technology"),
    ("bachelor of science in information technology", "BS Information Technology"), ("information technology", "BS Information Technology"),
    ("bscs", "BS Computer Science"), ("bs-cs", "BS Computer Science"), ("bs cs", "BS Computer Science"), ("bs computer science", "BS Computer Science"),
    ("bachelor of science in computer science", "BS Computer Science"), ("computer science", "BS Computer Science"),
    ("act", "Associate in Computer Technology"), ("associate in computer technology", "Associate in Computer Technology"),
    ("associate computer technology", "Associate in Computer Technology"), ("computer technology", "Associate in Computer Technology"),
]
#: The institution's names, words of which two are enough, and the likeness from which a name is taken.
INSTITUTIONS = ["Pampanga State University", "Don Honorio Ventura State University", "DHVSU", "PSU"]
ENOUGH = 75.0


def cleaned(name: str | Column) -> Column:
    """Lower case, no punctuation but hyphens, white space squeezed."""
    bare = F.regexp_replace(F.lower(F.col(name) if isinstance(name, str) else name), r"(?U)[^\w\s-]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def normal_program(name: str | Column) -> Column:
    """The program that a name means: by a spelling that is all of it, else by the first that it holds or that holds it; others stay as they are.

    Null and empty names are null. A name without a letter or digit is held by every
    spelling, so it means the first program.
    """
    name = F.col(name) if isinstance(name, str) else name
    known = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(p).alias("program")) for a, p in ALIASES])

    def meant(clean: Column) -> Column:
        exact = F.filter(known, lambda k: k["alias"] == clean)
        part = F.filter(known, lambda k: F.contains(clean, k["alias"]) | F.contains(k["alias"], clean))
        return F.coalesce(F.get(exact, F.lit(0))["program"], F.get(part, F.lit(0))["program"])

    # a name is cleaned once; a branch for each spelling would not fit into one compiled method
    return F.when(F.length(name) > 0, F.coalesce(let(cleaned(name), meant), name))


def named_institution(name: str | Column) -> Column:
    """Which rule says without a doubt that a name is the institution's: "exact", "words" or "abbreviation"; null if none does."""

    def told(lower: Column) -> Column:
        def has(word):
            return F.contains(lower, F.lit(word)).cast("int")

        words = has("don") + has("honorio") + has("ventura")
        cut = (has("ventur") == 1) & ((has("don") == 1) | (has("honorio") == 1))
        return (
            F.when(lower.isin([n.lower() for n in INSTITUTIONS]), "exact")
            .when((has("pampanga") == 1) & (has("state") == 1), "words")
            .when(has("dhvsu") == 1, "abbreviation")
            .when((words >= 2) | cut, "words")
        )

    return let(F.lower(F.trim(F.col(name) if isinstance(name, str) else name)), told)


def _likeness(name: str) -> float:
    words, best = set(name.split()), 0.0
    length = len(" ".join(words))
    for known in (n.lower() for n in INSTITUTIONS):
        # words in common, or lengths that allow three quarters of alike letters
        if words & set(known.split()) or min(length, len(known)) >= ENOUGH / (200 - ENOUGH) * max(length, len(known)):
            best = max(best, token_set(name, known))
    return best


@F.pandas_udf(DoubleType())
def institution_likeness(names: pd.Series) -> pd.Series:
    """The best likeness of lower-case names to the institution's as sets of words, of such as can reach the bar; each name of a batch once, 0 for null."""
    places, distinct = pd.factorize(names)
    return pd.Series(np.array([_likeness(n) for n in distinct] + [0.0])[places])


def matched_institutions(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``rule``: how column ``name`` was found to be the institution's, null if it is not.

    Rules on words decide first. Only names that they leave open are held against the
    institution's names as sets of words ("likeness"), which needs Python: without a
    word in common two texts are 75 % alike only if the shorter has three fifths of the
    other's length. Rows stay where they are, so a name that many share costs no shuffle.
    """
    told = named_institution(name)
    alike = institution_likeness(F.when(told.isNull(), F.lower(F.trim(name)))) >= ENOUGH
    return rows.withColumn("rule", F.coalesce(told, F.when(alike, "likeness")))
