"""A text encoder without a model: hashed words as a unit vector, and stored vectors that are fresh enough to stand for it."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from scholarlens.operators.vectors import dot, unit_vector

#: Name and version of the encoder; a stored vector holds for the text and the model that made it.
MODEL, DIM = "hashed-words-1", 64
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def place_of(word: str) -> tuple[int, int]:
    """(component, sign) of a word, from its MD5 digest: three digits tell the component, the fourth the sign."""
    digest = hashlib.md5(word.encode(errors="replace"), usedforsecurity=False).hexdigest()
    return int(digest[:3], 16) % DIM, 1 if digest[3] < "8" else -1


def _vector(text: str, places: dict) -> np.ndarray:
    total = np.zeros(DIM)
    for word in _WORD.findall(text.lower()):
        if word not in places:
            places[word] = place_of(word)
        at, sign = places[word]
        total[at] += sign
    length = np.sqrt((total**2).sum())
    return total / length if length else total


def encoded(text: str | None) -> list[float]:
    """The unit vector of one text; zeros for a null or blank one, or one whose words cancel out."""
    return _vector(text or "", {}).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def encode(texts: pd.Series) -> pd.Series:
    """:func:`encoded` for a column; null stays null. Words met in a batch are hashed once."""
    places: dict = {}
    return texts.map(lambda t: None if t is None else _vector(t, places).tolist())


def source_hash(text: str | Column) -> Column:
    """What a stored vector is bound to: the model and the text."""
    return F.sha2(F.concat(F.lit(f"{MODEL}\0"), text), 256)


def composed(title: str, keywords: str, abstract: str) -> Column:
    """The text that stands for a work: title, keywords, abstract, those that are blank left out; the head counts most to encoders with a limit."""
    parts = [F.trim(title), F.array_join(F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k != ""), " "), F.trim(abstract)]
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n\n")


def with_vectors(rows: DataFrame, text: Column, stored: Column, fresh: Column | None = None) -> DataFrame:
    """``rows`` with ``vector``, ``stored`` as a unit vector where it is usable and ``fresh``, else ``text`` encoded; ``origin`` tells which.

    Only the texts of the others pass through Python. A column named vector or origin is replaced.
    """
    unit = unit_vector("_stored", DIM)
    kept = F.when(F.coalesce(fresh, F.lit(False)), unit) if fresh is not None else unit
    out = rows.withColumn("_stored", stored).withColumn("_text", text).withColumn("_kept", kept).drop("_stored")
    made = encode(F.when(F.col("_kept").isNull(), F.coalesce("_text", F.lit(""))))
    origin = F.when(F.col("_kept").isNotNull(), "stored").otherwise("encoded")
    return out.withColumns({"vector": F.coalesce("_kept", made), "origin": origin}).drop("_kept", "_text")


def best_score(vector: str, variants: str) -> Column:
    """The best dot product of a vector with those of a query's spellings, clipped to -1 and 1; not rounded."""
    best = F.array_max(F.transform(variants, lambda v: dot(F.col(vector), v)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), best))
