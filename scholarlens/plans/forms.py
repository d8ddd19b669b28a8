"""Values of forms, references in three styles, sources of requests, and rules of entry over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.functions.values import client_address, instant, listed_values, name_parts, reference
from scholarlens.operators.integrity import edge_faults, entry_faults, repeated_pending
from scholarlens.plans.search import _CITED, citation_edges
from scholarlens.registry import query
from scholarlens.sources.views import KEYWORDS_SQL, WORKS_SQL, read, works


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 99_999))


_CAPITALS = f"""{WORKS_SQL}, {KEYWORDS_SQL}, people AS (SELECT k.id, w.year, list_transform(k.keywords, lambda x: upper(x[1]) || x[2:]) AS c
  FROM keyworded k JOIN works w ON w.id = k.id WHERE len(k.keywords) = 5 AND regexp_matches(array_to_string(k.keywords, ''), '^[a-z]+$'))"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, year, c): works of five plain keywords, which stand for names in capitals."""
    rows = works(spark, sf_dir).select("id", "year", "keywords").filter((F.size("keywords") == 5) & F.array_join("keywords", "").rlike("^[a-z]+$"))
    return rows.select("id", "year", F.transform("keywords", capital).alias("c"))


@query(
    "author_fields",
    f"""WITH {_CAPITALS}, read_ AS (SELECT id, CASE id % 6 WHEN 0 THEN [c[1] || ' ' || c[2], c[3] || ', ' || c[4]] WHEN 1 THEN [c[1] || ', ' || c[2], c[3] || ' ' || c[4]]
      WHEN 2 THEN [c[1] || ' ' || c[2], c[3] || ' de ' || c[4]] WHEN 3 THEN ['["' || c[1] || '"', c[2] || '"'] WHEN 4 THEN [c[1] || ', lower ' || c[2]] ELSE [] END AS names FROM people)
    SELECT id, len(names) AS n, array_to_string(names, ' | ') AS names, CASE id % 6 WHEN 0 THEN c2 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN '["' || c1 || '"' WHEN 4 THEN c1 END AS surname
    FROM (SELECT r.*, p.c[1] AS c1, p.c[2] AS c2 FROM read_ r JOIN people p ON p.id = r.id)""",
)
def author_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors read from a field that holds a JSON list, parts between semicolons or commas, a broken list, one name, or nothing."""
    c, k = [F.get("c", F.lit(i)) for i in range(5)], F.col("id") % 6
    field = (
        F.when(k == 0, F.to_json(F.array(F.concat_ws(" ", c[0], c[1]), F.concat_ws(", ", c[2], c[3]))))
        .when(k == 1, F.concat(c[0], F.lit(", "), c[1], F.lit(" ;  "), c[2], F.lit("  "), c[3], F.lit(";")))
        .when(k == 2, F.concat(c[0], F.lit(" "), c[1], F.lit(", "), c[2], F.lit(" de "), c[3]))
        .when(k == 3, F.concat(F.lit('["'), c[0], F.lit('", '), c[1], F.lit('"')))
        .when(k == 4, F.concat(c[0], F.lit(", lower "), c[1]))
        .otherwise(" ")
    )
    rows = people(spark, sf_dir).select("id", listed_values(field, authors=True).alias("names"))
    surname = name_parts(F.get("names", F.lit(0)))["surname"]
    return rows.select("id", F.size("names").cast("long").alias("n"), F.array_join("names", " | ").alias("names"), surname.alias("surname"))


_N = "CAST(id % 9 AS INT)"
_LAST = "n.surname[-1]"


@query(
    "references_in_styles",
    f"""WITH {_CAPITALS}, sized AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'n.d.' ELSE CAST(year AS VARCHAR) END AS y, {_N} AS n,
      list_transform(range({_N}), lambda i: CASE WHEN i % 2 = 1 THEN 'de ' ELSE '' END || c[2 + i % 4]) AS s, c[1] AS g FROM people),
    parts AS (SELECT *, g[1] || '.' AS i, list_transform(s, lambda x: x || ', ' || g[1] || '.') AS a, list_transform(s, lambda x: g[1] || '. ' || x) AS e FROM sized)
    SELECT id, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN a[1] || ' ' ELSE array_to_string(a[1:n - 1], ', ') || ', & ' || a[n] || ' ' END || '(' || y || '). Work ' || CAST(id AS VARCHAR) || '.' AS apa,
      CASE WHEN n = 0 THEN '' WHEN n = 1 THEN e[1] || ', ' WHEN n > 6 THEN e[1] || ' et al., ' ELSE array_to_string(e[1:n - 1], ', ') || ' and ' || e[n] || ', ' END
        || '"Work ' || CAST(id AS VARCHAR) || '," ' || y || '.' AS ieee,
      CASE WHEN n = 0 THEN '' WHEN n = 1 THEN s[1] || ', ' || g || '. ' WHEN n = 2 THEN s[1] || ', ' || g || ', and ' || g || ' ' || s[2] || '. ' ELSE s[1] || ', ' || g || ', et al. ' END
        || '"Work ' || CAST(id AS VARCHAR) || '." ' || y || '.' AS mla FROM parts""",
)
def references_in_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of works with none to eight authors, some surnames with a particle, some works without a year."""
    c, i = F.col("c"), F.col("id")
    slots = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda x: x < i % 9)
    authors = F.transform(slots, lambda x: F.concat(F.get(c, F.lit(0)), F.when(x % 2 == 1, " de ").otherwise(" "), F.get(c, (x % 4 + 1).cast("int"))))
    rows = people(spark, sf_dir).select("id", authors.alias("authors"), F.when(i % 4 != 0, F.col("year")).alias("year"))
    title = F.concat(F.lit("Work "), F.col("id").cast("string"))
    return rows.select("id", *[reference(F.col("authors"), "year", title, s).alias(s) for s in ("apa", "ieee", "mla")])


@query(
    "request_sources",
    """WITH r AS (SELECT ts, event_type, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || CAST(user_id % 20 AS VARCHAR) WHEN 1 THEN '172.16.0.' || CAST(user_id % 10 AS VARCHAR)
        ELSE '192.168.0.' || CAST(event_id % 7 AS VARCHAR) END AS address FROM events WHERE event_id % 5 <> 4)
    SELECT address, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us
    FROM r WHERE ts >= TIMESTAMP '2024-01-04 16:00:00' AND ts <= TIMESTAMP '2024-01-20 12:30:00' GROUP BY address""",
)
def request_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a span of time by the address they came from; bounds are ISO 8601 with and without a zone, requests without a readable time are left out."""
    i, user = F.col("event_id"), F.col("user_id")
    forwarded = F.when(i % 4 == 0, F.concat(F.lit("10.0.0."), (user % 20).cast("string"), F.lit(" , 8.8.8.8"))).when(i % 4 == 1, F.concat(F.lit("172.16.0."), (user % 10).cast("string"))).when(i % 4 == 2, "")
    remote = F.concat(F.lit("192.168.0."), (i % 7).cast("string"))
    events = read(spark, sf_dir, "events")
    written = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(i % 5 == 4, "?").when(i % 5 == 3, "Z").otherwise(""))
    rows = events.select(client_address(forwarded, remote).alias("address"), "event_type", instant(written).alias("at"))
    low, high = instant(F.lit("2024-01-05T00:00:00+08:00")), instant(F.lit("2024-01-20T12:30"))
    rows = rows.filter(F.col("at").between(low, high))
    return rows.groupBy("address").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.min(F.unix_micros("at")).alias("first_us")
    )


_ENTRY = f"""{WORKS_SQL}, {KEYWORDS_SQL}, entries AS (SELECT w.id, trim(w.title) AS title, trim(w.abstract, ' ') AS abstract, w.program, w.year - 40 * CAST(w.id % 5 = 4 AS INT) AS year,
  CASE WHEN w.id % 7 = 0 THEN [' '] WHEN w.id % 7 = 1 THEN list_transform(range(11), lambda i: 'A' || CAST(i AS VARCHAR)) ELSE ['A', ' ', 'B'] END AS authors,
  CASE WHEN w.id % 6 = 0 THEN list_append(k.keywords, repeat('k', 81)) ELSE k.keywords END AS keywords FROM works w JOIN keyworded k ON k.id = w.id)"""


@query(
    "entry_faults",
    f"""WITH {_ENTRY}, told AS (SELECT id, array_to_string(list_filter([
      CASE WHEN length(title) < 5 OR length(title) > 500 THEN 'title' END, CASE WHEN length(abstract) < 20 OR length(abstract) > 10000 THEN 'abstract' END,
      CASE WHEN id % 7 < 2 THEN 'authors' END, CASE WHEN len(keywords) = 0 OR id % 6 = 0 THEN 'keywords' END,
      CASE WHEN program NOT IN ('en', 'fr', 'de') THEN 'program' END, CASE WHEN year < 1980 OR year > 2100 THEN 'year' END], lambda x: x IS NOT NULL), ',') AS faults FROM entries)
    SELECT * FROM told WHERE faults <> ''""",
)
def entry_faults_of_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a form would refuse, with the fields at fault; authors and keywords are spoilt by the number of the work."""
    i = F.col("id")
    authors = (
        F.when(i % 7 == 0, F.array(F.lit(" ")))
        .when(i % 7 == 1, F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.concat(F.lit("A"), k.cast("string"))))
        .otherwise(F.array(F.lit("A"), F.lit(" "), F.lit("B")))
    )
    keywords = F.when(i % 6 == 0, F.array_append("keywords", F.repeat(F.lit("k"), 81))).otherwise(F.col("keywords"))
    year = F.col("year") - F.when(i % 5 == 4, 40).otherwise(0)
    rows = works(spark, sf_dir).select("id", "title", "abstract", "program", year.alias("year"), authors.alias("authors"), keywords.alias("keywords"))
    found = rows.select("id", F.array_join(entry_faults(["en", "fr", "de"]), ",").alias("faults"))
    return found.filter("faults <> ''")


@query(
    "edge_faults",
    f"""WITH {WORKS_SQL}, {_CITED}, given AS (SELECT citing, cited FROM edges UNION ALL SELECT citing, cited FROM edges WHERE citing % 3 = 0
      UNION ALL SELECT id, id FROM works WHERE id % 50 = 0 UNION ALL SELECT id, NULL FROM works WHERE id % 70 = 0)
    SELECT citing, cited, fault, n FROM (SELECT citing, cited, count(*) AS n, CASE WHEN citing IS NULL OR cited IS NULL THEN 'missing end' WHEN citing = cited THEN 'self'
      WHEN count(*) > 1 THEN 'repeated' END AS fault FROM given GROUP BY citing, cited) WHERE fault IS NOT NULL""",
)
def edge_faults_of_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a table of citations must not hold: to itself, twice, or without an end; a third is given twice, some of the others are made."""
    edges = citation_edges(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("citing", "cited")
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    own = ids.filter("id % 50 = 0").select(F.col("id").alias("citing"), F.col("id").alias("cited"))
    open_ = ids.filter("id % 70 = 0").select(F.col("id").alias("citing"), F.lit(None).cast("long").alias("cited"))
    return edge_faults(edges.unionByName(edges.filter("citing % 3 = 0")).unionByName(own).unionByName(open_), "citing", "cited")


@query(
    "repeated_requests",
    """WITH r AS (SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS email, CASE event_type WHEN 'error' THEN 'pending' ELSE 'denied' END AS status FROM events)
    SELECT email, count(*) AS n, min(event_id) AS first_id FROM r WHERE status = 'pending' GROUP BY email HAVING count(*) > 1""",
)
def repeated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, in either case, with more than one pending request; an error stands for one."""
    i = F.col("event_id")
    email = F.concat(F.when(i % 2 == 0, " U").otherwise("u"), F.col("user_id").cast("string"))
    status = F.when(F.col("event_type") == "error", "pending").otherwise("denied")
    rows = read(spark, sf_dir, "events").select(i.alias("id"), email.alias("email"), status.alias("status"))
    return repeated_pending(rows)
