"""Rules that rows must keep: fields of an entry, edges between works, one open request an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stripped(values: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(values), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def _sized(text: str, least: int, most: int) -> Column:
    return F.length(F.trim(F.coalesce(F.col(text), F.lit("")))).between(least, most)


def _listed(values: str, most: int, longest: int) -> Column:
    """At least one value that is not blank, at most ``most`` of them, none too long; blank ones do not count."""
    kept = _stripped(values)
    return F.size(kept).between(1, most) & ~F.exists(kept, lambda x: F.length(x) > longest)


def entry_faults(programs: list[str]) -> Column:
    """Fields of an entry (title, abstract, authors, keywords, program, year) that break their rule, in that order; null is at fault."""
    rules = {
        "title": _sized("title", 5, 500),
        "abstract": _sized("abstract", 20, 10_000),
        "authors": _listed("authors", 10, 160),
        "keywords": _listed("keywords", 20, 80),
        "program": F.coalesce(F.col("program").isin(programs), F.lit(False)),
        "year": F.coalesce(F.col("year").between(1980, 2100), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(~kept, F.lit(name)) for name, kept in rules.items()]))


def edge_faults(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, fault, n): distinct pairs at fault and their rows: "missing end", "self" or "repeated", in that order.

    Pairs are counted before the shuffle, so copies of one edge do not meet in a task.
    """
    counted = edges.groupBy(source, target).agg(F.count("*").alias("n"))
    fault = (
        F.when(F.col(source).isNull() | F.col(target).isNull(), "missing end")
        .when(F.col(source) == F.col(target), "self")
        .when(F.col("n") > 1, "repeated")
    )
    return counted.select(source, target, fault.alias("fault"), "n").filter("fault is not null")


def unpaired(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Rows of which exactly one of two columns is null."""
    return rows.filter(F.col(one).isNull() != F.col(other).isNull())


def repeated_pending(requests: DataFrame, state: str = "pending") -> DataFrame:
    """(email, n, first_id): addresses, trimmed and in one case, with more than one request (id, email, status) in ``state``; null ones do not count."""
    rows = requests.filter((F.col("status") == state) & F.col("email").isNotNull())
    counted = rows.groupBy(F.lower(F.trim("email")).alias("email")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return counted.filter("n > 1")
