"""URL filters over dated lists: validity intervals and an as-of join with the time of fetching.

A list entry is a domain (``example.org`` covers its subdomains) or a host with a
path prefix (``example.org/shop/``), listed or delisted at a time. An entry holds
from a listing to the next event of the same entry and category. A capture is
held against every domain above its host and every prefix of its path, by an
equality join on the entry with the time test in the join, so a capture meets at
most one interval of an entry and category. Captures of one URL at one time are
joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.llm.common import free_name

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: str) -> Column:
    """Lower-case host of a URL without user and port; "" where there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def entries_above(url: str) -> Column:
    """All list keys that cover a URL: domains of two labels or more, the bare host, and host with path prefixes."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    steps = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(steps, lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def validity(events: DataFrame) -> DataFrame:
    """(entry, category, valid_from, valid_to) from dated events (entry, category, at, listed boolean).

    Entries are compared in lower case. An interval runs from a listing to the next event of its entry and category,
    open-ended if there is none. Of events at one time the delisting wins; events
    without entry, time or flag are ignored; repeated events count once.
    """
    events = events.withColumn("entry", F.lower("entry"))
    known = events.filter("entry is not null and at is not null and listed is not null").groupBy("entry", "category", "at")
    known = known.agg(F.bool_and("listed").alias("listed"))
    following = F.lead("at").over(Window.partitionBy("entry", "category").orderBy("at"))
    return known.withColumn("valid_to", following).filter("listed").select(
        "entry", "category", F.col("at").alias("valid_from"), "valid_to"
    )


def listed_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_at and any others) with n_entries, entries and blocked.

    ``entries`` names what covers the URL at its time of fetching as category:entry,
    sorted and comma-joined. A null URL, a URL without host and a null time match
    nothing and are not blocked. Every row of ``captures`` stays, repeated ones too;
    columns of it that are named like the three that are added, in any case, give way.
    """
    captures = captures.drop(*[c for c in captures.columns if c.lower() in ("n_entries", "entries", "blocked")])
    url_name, at_name, found_name = (free_name(c, captures.columns) for c in ("found_url", "found_at", "found_names"))
    key = captures.select("url", "fetched_at").filter("url is not null and fetched_at is not null").distinct()
    wanted = key.select("url", "fetched_at", F.explode(entries_above("url")).alias("entry"))
    intervals = validity(events)
    active = wanted.alias("w").join(
        intervals.alias("i"),
        (F.col("w.entry") == F.col("i.entry"))
        & (F.col("w.fetched_at") >= F.col("i.valid_from"))
        & (F.col("i.valid_to").isNull() | (F.col("w.fetched_at") < F.col("i.valid_to"))),
    )
    name = F.concat_ws(":", F.coalesce("i.category", F.lit("")), "w.entry")
    found = active.groupBy("w.url", "w.fetched_at").agg(F.array_sort(F.collect_set(name)).alias("names"))
    found = found.select(F.col("url").alias(url_name), F.col("fetched_at").alias(at_name), F.col("names").alias(found_name))
    joined = captures.join(found, (F.col("url") == F.col(url_name)) & (F.col("fetched_at") == F.col(at_name)), "left")
    count = F.when(F.col(found_name).isNull(), 0).otherwise(F.size(found_name))
    return joined.select(
        *[captures[c] for c in captures.columns],
        count.cast("long").alias("n_entries"),
        F.coalesce(F.array_join(found_name, ","), F.lit("")).alias("entries"),
        (count > 0).alias("blocked"),
    )


def derived_events(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of ``pages`` alone, by the digits of each host's digest.

    A quarter of the hosts' domains is listed as spam and, in half of the cases,
    delisted 90 days later and listed again 60 days after that; the /en/ part of
    another quarter of the hosts is listed as adult from a day on.
    """

    def digit(host: Column, k: int) -> Column:
        return (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(host), k, 1)) - 1).cast("long")

    hosts = pages.select(host_of("url").alias("host")).filter("host <> ''").distinct()
    host = F.col("host")
    day = digit(host, 2) * 20

    def event(entry, category, at, listed):
        return F.struct(entry.alias("entry"), F.lit(category).alias("category"), at.alias("at"), F.lit(listed).alias("listed"))

    spam, adult = digit(host, 1) < 4, digit(host, 1).between(4, 7)
    again = spam & (digit(host, 3) < 8)
    events = F.array(
        F.when(spam, event(host, "spam", day, True)),
        F.when(again, event(host, "spam", day + 90, False)),
        F.when(again, event(host, "spam", day + 150, True)),
        F.when(adult, event(F.concat(host, F.lit("/en/")), "adult", day, True)),
    )
    return hosts.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*")
