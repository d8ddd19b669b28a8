"""Search with facets, lookups within what a reader may see, and the figures of a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that see what waits for review.
PRIVILEGED = ("faculty", "administrator")


def holds_all(query: str, columns: list[str]) -> Column:
    """Is every word of ``query`` part of one of the columns, in either case? A blank query holds for all rows."""
    lower = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    hit = F.lit(True)
    for word in query.lower().split():
        one = F.lit(False)
        for c in lower:
            one = one | F.contains(c, F.lit(word))
        hit = hit & one
    return hit


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): how many rows have each value of each column, and of all rows under the facet "all".

    One pass and one shuffle for all columns, by grouping sets; a null value is counted
    as such. Without rows there is none.
    """
    texts = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counted = texts.groupingSets([[c] for c in columns] + [[]], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns])
    facet, value = F.lit("all"), F.lit(None).cast("string")
    for c in columns:
        kept = F.col(f"_{c}") == 0
        facet, value = F.when(kept, F.lit(c)).otherwise(facet), F.when(kept, F.col(c)).otherwise(value)
    return counted.select(facet.alias("facet"), value.alias("value"), "n").filter("n > 0")


def flag(text: str | None) -> bool | None:
    """A strict flag of a request: "true" or "false" in either case, None without one; anything else is an error."""
    if text is None:
        return None
    known = {"true": True, "false": False}
    if text.strip().lower() not in known:
        raise ValueError("the flag must be 'true' or 'false'")
    return known[text.strip().lower()]


def listed(rows: DataFrame, reader: str, role: str, mine: str | None = None, review: str | None = None) -> DataFrame:
    """The rows (uploader, status, subject, reviewed_at) that a reader asks for, of those the reader may see.

    ``mine`` narrows to the reader's own. ``review`` is "pending" or "reviewed", for
    privileged roles alone: approved rows of which subject and time of review are both
    null, or both given; rows with one of them are in neither.
    """
    if role not in PRIVILEGED:
        rows = rows.filter((F.col("status") == "approved") | (F.col("uploader") == reader))
    if flag(mine):
        rows = rows.filter(F.col("uploader") == reader)
    if review is not None:
        if role not in PRIVILEGED:
            raise PermissionError("the review of subjects is for privileged roles")
        if review not in ("pending", "reviewed"):
            raise ValueError("review must be 'pending' or 'reviewed'")
        parts = [F.col(c).isNull() if review == "pending" else F.col(c).isNotNull() for c in ("subject", "reviewed_at")]
        rows = rows.filter((F.col("status") == "approved") & parts[0] & parts[1])
    return rows


def looked_up(asked: DataFrame, key: str, rows: DataFrame, shown: list[str]) -> DataFrame:
    """``asked`` with the columns ``shown`` of the row whose id its text ``key`` is, and ``found``.

    Text that is no number, that no row has, and that only rows outside ``rows`` have
    are told in one way. Ids of ``rows`` are unique; the names of both sides differ.
    """
    text = F.trim(F.col(key))
    number = F.when(text.rlike(r"^[0-9]{1,18}$"), text.cast("long"))
    known = rows.select(F.col("id").alias("_id"), *shown, F.lit(True).alias("found"))
    joined = asked.withColumn("_key", number).join(known, F.col("_key") == F.col("_id"), "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False))).drop("_key", "_id")


def dashboard(works: DataFrame, roles: DataFrame, last_year: int, since: Column, most: int = 10) -> DataFrame:
    """One record a role (role) over works (id, program, year, status, created_at, keywords, ready): totals and lists.

    ``programs``, ``growth`` and ``keywords`` are arrays of (name, n): approved works by
    program, the largest first, of the last ten years by year, and the ``most`` used
    keywords, ties by name; ``busiest`` is the first program. ``pending`` is null for
    roles without the right. Lists are counted before they are gathered: a program
    list has as many entries as there are programs, the others at most ten and
    ``most``. Without works all counts are 0 and lists empty.
    """
    approved = F.col("status") == "approved"
    totals = works.agg(
        F.count("*").alias("total"),
        F.count_if(approved).alias("approved"),
        F.count_if(approved & F.col("ready")).alias("semantic_ready"),
        F.count_if(F.col("created_at") >= since).alias("recent"),
        F.count_if(F.col("status") == "pending_review").alias("waiting"),
    )
    kept = works.filter(approved)
    grouped = kept.select("program", F.col("year").cast("string").alias("year")).groupingSets([["program"], ["year"]], "program", "year")
    grouped = grouped.agg(F.count("*").alias("n"), F.grouping("program").alias("g"))
    words = kept.select(F.explode("keywords").alias("k")).select(F.trim(F.lower("k")).alias("name")).filter("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    words = words.orderBy(F.desc("n"), "name").limit(most)
    one = F.struct("name", "n")

    def gathered(kind: str) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, one))

    def ranked(entries: Column) -> Column:
        return F.transform(F.array_sort(F.transform(entries, lambda x: F.struct((-x["n"]).alias("m"), x["name"].alias("name")))), lambda x: F.struct(x["name"].alias("name"), (-x["m"]).alias("n")))

    lists = (
        grouped.filter("g = 0").select(F.lit("program").alias("kind"), F.col("program").alias("name"), "n")
        .unionByName(grouped.filter(f"g = 1 and cast(year as int) >= {last_year - 9}").select(F.lit("year").alias("kind"), F.col("year").alias("name"), "n"))
        .unionByName(words.select(F.lit("keyword").alias("kind"), "name", "n"))
        .agg(ranked(gathered("program")).alias("programs"), F.array_sort(gathered("year")).alias("growth"), ranked(gathered("keyword")).alias("keywords"))
    )
    # totals and lists are one row each
    pending = F.when(F.col("role").isin(*PRIVILEGED), F.col("waiting"))
    return roles.crossJoin(totals).crossJoin(lists).select(
        "role", "total", "approved", "semantic_ready", "recent", F.get("programs", F.lit(0))["name"].alias("busiest"),
        "programs", "growth", "keywords", pending.alias("pending"),
    )


def first_of(rows: DataFrame, key: str, value: str, order: list[Column], most: int) -> DataFrame:
    """(key, values): the first ``most`` values of each key in a total order; Spark limits the ranking before the shuffle."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= most)
    kept = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", value))).alias("v"))
    return kept.select(key, F.transform("v", lambda x: x[value]).alias("values"))
