"""Listings, filters and statistics of the repository of works."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlens.registry import query
from scholarlens.sources.views import KEYWORDS_SQL, WORKS_SQL, read, subjects, works

LAST_YEAR = 2024
PAGE, PAGE_SIZE = 2, 20


def visible(uploader: str, privileged: bool = False) -> Column:
    """Rows that a reader may see: all of them, or approved ones and one's own."""
    return F.lit(True) if privileged else (F.col("status") == "approved") | (F.col("uploader") == uploader)


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a totally ordered listing, with the number of all rows in ``total``."""
    total = rows.agg(F.count("*").alias("total"))
    # total is one row
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(total)


@query(
    "corpus_overview",
    f"""WITH {WORKS_SQL}, ready AS (SELECT vec_id FROM embeddings)
    SELECT count(*) AS total, count(*) FILTER (status = 'approved') AS approved,
      count(*) FILTER (status = 'pending_review') AS pending, count(ready.vec_id) AS semantic_ready,
      count(*) FILTER (created_at > TIMESTAMP '2024-01-01' + to_minutes(CAST((SELECT max(doc_id) FROM documents) - 300 AS INT))) AS recent
    FROM works LEFT JOIN ready ON ready.vec_id = works.id""",
)
def corpus_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all, approved, pending, embedded and recent works in one pass."""
    ready = subjects(spark, sf_dir).select("id", F.lit(1).alias("has_vector"))
    rows = works(spark, sf_dir).select("id", "status", "created_at").join(ready, "id", "left")
    last = rows.agg((F.max("created_at") - F.expr("interval 300 minutes")).alias("since"))
    return rows.crossJoin(last).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "pending_review").alias("pending"),
        F.count("has_vector").alias("semantic_ready"),
        F.count_if(F.col("created_at") > F.col("since")).alias("recent"),
    )


@query(
    "program_distribution",
    f"""WITH {WORKS_SQL}, counted AS (SELECT program, count(*) AS n FROM works WHERE status = 'approved' GROUP BY program)
    SELECT program, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share, row_number() OVER (ORDER BY n DESC, program) = 1 AS most_active FROM counted""",
)
def program_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved works by program, with the share of all and the most active one; ties by name."""
    counted = works(spark, sf_dir).filter("status = 'approved'").groupBy("program").agg(F.count("*").alias("n"))
    totals = counted.agg(F.sum("n").alias("all"), F.max(F.struct("n")).alias("top"))
    best = counted.orderBy(F.desc("n"), "program").limit(1).select(F.col("program").alias("best"))
    joined = counted.crossJoin(totals).crossJoin(best)
    return joined.select("program", "n", (F.col("n") / F.col("all").cast("double")).alias("share"), (F.col("program") == F.col("best")).alias("most_active"))


@query(
    "growth_by_year",
    f"WITH {WORKS_SQL} SELECT year, count(*) AS n FROM works WHERE status = 'approved' AND year >= {LAST_YEAR - 9} GROUP BY year",
)
def growth_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved works of each of the last ten years."""
    rows = works(spark, sf_dir).filter((F.col("status") == "approved") & (F.col("year") >= LAST_YEAR - 9))
    return rows.groupBy("year").agg(F.count("*").alias("n"))


@query(
    "top_keywords",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, flat AS (
      SELECT trim(lower(unnest(keywords))) AS keyword, id FROM keyworded WHERE status = 'approved')
    SELECT keyword, count(*) AS n, min(id) AS first_work FROM flat WHERE keyword <> ''
    GROUP BY keyword ORDER BY n DESC, first_work, keyword LIMIT 10""",
)
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most used keywords of approved works; ties by first use, then by name."""
    flat = works(spark, sf_dir).filter("status = 'approved'").select("id", F.explode("keywords").alias("k"))
    flat = flat.select("id", F.trim(F.lower("k")).alias("keyword")).filter("keyword <> ''")
    counted = flat.groupBy("keyword").agg(F.count("*").alias("n"), F.min("id").alias("first_work"))
    return counted.orderBy(F.desc("n"), "first_work", "keyword").limit(10)


@query(
    "visible_listing_page",
    f"""WITH {WORKS_SQL}, rows AS (SELECT id, title, program, year, status FROM works
      WHERE (status = 'approved' OR uploader = 'src3') AND program = 'en' AND year >= 2018)
    SELECT *, (SELECT count(*) FROM rows) AS total FROM rows ORDER BY year DESC, title, id LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE * (PAGE - 1)}""",
)
def visible_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of what one uploader may see, filtered by program and year."""
    rows = works(spark, sf_dir).filter(visible("src3") & (F.col("program") == "en") & (F.col("year") >= 2018))
    rows = rows.select("id", "title", "program", "year", "status")
    return page_of(rows, [F.desc("year"), F.col("title"), F.col("id")], PAGE, PAGE_SIZE)


@query(
    "keyword_exact_match",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, flat AS (SELECT id, unnest(keywords) AS k FROM keyworded),
    top AS (SELECT k FROM flat GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)
    SELECT DISTINCT id, k AS keyword FROM flat WHERE k IN (SELECT k FROM top)""",
)
def keyword_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with the most common keyword among theirs, compared without case and white space."""
    flat = works(spark, sf_dir).select("id", F.explode("keywords").alias("k"))
    flat = flat.withColumn("keyword", F.regexp_replace(F.trim(F.lower("k")), r"\s+", " "))
    top = flat.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(1)
    return flat.join(F.broadcast(top.select("keyword")), "keyword").select("id", "keyword").distinct()


@query(
    "ids_filter",
    f"""WITH {WORKS_SQL} SELECT id, title, status FROM works WHERE id IN (SELECT p_partkey * 3 FROM part)""",
)
def ids_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose ids are in a list; unknown ids are silently absent."""
    wanted = read(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("id"))
    return works(spark, sf_dir).select("id", "title", "status").join(wanted, "id", "left_semi")


@query(
    "substring_fallback",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL} SELECT w.id, w.title FROM works w JOIN keyworded k ON k.id = w.id
    WHERE contains(lower(w.title), 'tion') OR contains(lower(w.uploader), 'src1') OR contains(array_to_string(k.keywords, ' '), 'thation')""",
)
def substring_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works in which a needle occurs in the title, the uploader or the keywords."""
    title, uploader = F.lower("title"), F.lower("uploader")
    hit = title.contains("tion") | uploader.contains("src1") | F.array_join("keywords", " ").contains("thation")
    return works(spark, sf_dir).filter(hit).select("id", "title")


@query(
    "constraint_violations",
    f"""WITH {WORKS_SQL} SELECT id, array_to_string(list_filter([
      CASE WHEN program NOT IN ('en', 'fr', 'de') THEN 'program' END,
      CASE WHEN year < 1980 OR year > 2023 THEN 'year' END,
      CASE WHEN length(title) < 5 OR length(title) > 500 THEN 'title' END,
      CASE WHEN length(abstract) < 20 OR length(abstract) > 10000 THEN 'abstract' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM works WHERE violations <> ''""",
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that break a rule of entry, with the names of the rules in a fixed order."""
    rules = {
        "program": ~F.col("program").isin("en", "fr", "de"),
        "year": ~F.col("year").between(1980, 2023),
        "title": ~F.length("title").between(5, 500),
        "abstract": ~F.length("abstract").between(20, 10_000),
    }
    broken = F.concat_ws(",", *[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return works(spark, sf_dir).select("id", broken.alias("violations")).filter("violations <> ''")


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the digests h of each status, rows being in order of status; a task holds one batch and one hash.

    Null digests are left out; a status with no other has a null hash.
    """
    names = ["status", "fingerprint"]

    def row(status, state):
        return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (status, state and state.hexdigest())], names=names)

    begun, at, state = False, None, None
    for batch in batches:
        for status, h in zip(batch.column("status").to_pylist(), batch.column("h").to_pylist()):
            if begun and status != at:
                yield row(at, state)
            if not begun or status != at:
                begun, at, state = True, status, None
            if h is not None:
                state = state or hashlib.sha256()
                state.update(h.encode())
    if begun:
        yield row(at, state)


@query(
    "corpus_fingerprint",
    f"""WITH {WORKS_SQL}, digests AS (
      SELECT status, id, sha256(CAST(id AS VARCHAR) || chr(31) || title || chr(31) || abstract || chr(31) || program) AS h FROM works)
    SELECT status, count(*) AS n, max(id) AS last_id, sha256(string_agg(h, '' ORDER BY id)) AS fingerprint FROM digests GROUP BY status""",
)
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the rows of each review state, in order of id: equal when nothing that it covers has changed."""
    sep = F.lit("\x1f")
    row = F.sha2(F.concat("id", sep, "title", sep, "abstract", sep, "program"), 256)
    digests = works(spark, sf_dir).select("status", "id", row.alias("h"))
    counted = digests.groupBy("status").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))
    ordered = digests.repartition("status").sortWithinPartitions("status", "id")
    hashed = ordered.select("status", "h").mapInArrow(chained, "status string, fingerprint string")
    return counted.join(hashed, counted["status"].eqNullSafe(hashed["status"])).select(counted["status"], "n", "last_id", "fingerprint")


@query(
    "manifest_reconcile",
    """WITH manifest AS (SELECT doc_id FROM labels WHERE quality = 1), stored AS (SELECT vec_id AS doc_id FROM embeddings)
    SELECT coalesce(m.doc_id, s.doc_id) AS id, CASE WHEN s.doc_id IS NULL THEN 'missing' ELSE 'additional' END AS state
    FROM manifest m FULL JOIN stored s ON s.doc_id = m.doc_id WHERE m.doc_id IS NULL OR s.doc_id IS NULL""",
)
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a manifest has and the store lacks, and the other way round."""
    manifest = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("m"))
    stored = subjects(spark, sf_dir).select(F.col("id").alias("s"))
    both = manifest.join(stored, F.col("m") == F.col("s"), "full").filter("m is null or s is null")
    return both.select(F.coalesce("m", "s").alias("id"), F.when(F.col("s").isNull(), "missing").otherwise("additional").alias("state"))


@query(
    "public_preview",
    """WITH counted AS (SELECT e.label AS subject, count(*) AS n FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id
      WHERE l.quality = 1 GROUP BY e.label)
    SELECT CAST(subject AS BIGINT) AS subject, n FROM counted ORDER BY n DESC, subject LIMIT 4""",
)
def public_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four subjects with the most reviewed works; ties by code."""
    reviewed = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    counted = subjects(spark, sf_dir).select("id", "subject").join(reviewed, "id").groupBy("subject").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "subject").limit(4)


@query(
    "subject_shares_with_other",
    """WITH counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM counted),
    folded AS (SELECT CASE WHEN k < 7 THEN source ELSE 'other' END AS label, sum(n) AS n, count(*) AS members FROM ranked GROUP BY 1)
    SELECT label, CAST(n AS BIGINT) AS n, members, round(n / max(n) OVER (), 4) AS of_max FROM folded""",
)
def subject_shares_with_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six largest sources and one bucket for the rest, each against the largest."""
    counted = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "source").limit(6).select("source", F.lit(True).alias("top"))
    label = F.when(F.col("top"), F.col("source")).otherwise("other")
    folded = counted.join(top, "source", "left").groupBy(label.alias("label")).agg(F.sum("n").alias("n"), F.count("*").alias("members"))
    largest = folded.agg(F.max("n").alias("most"))
    return folded.crossJoin(largest).select("label", "n", "members", F.round(F.col("n") / F.col("most"), 4).alias("of_max"))


@query(
    "suggest_values",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, flat AS (
      SELECT k, created_at, i FROM (SELECT created_at, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS i FROM keyworded WHERE status = 'approved')
      WHERE contains(lower(k), 'ti')), firsts AS (
      SELECT k, row_number() OVER (PARTITION BY lower(k) ORDER BY created_at, i) AS r FROM flat)
    SELECT k AS suggestion, starts_with(lower(k), 'ti') AS is_prefix FROM firsts WHERE r = 1 ORDER BY NOT is_prefix, lower(k) LIMIT 5""",
)
def suggest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keyword suggestions for a needle: the first spelling of each, prefix matches first, then by name."""
    rows = works(spark, sf_dir).filter("status = 'approved'").select("created_at", F.posexplode("keywords").alias("i", "k"))
    rows = rows.filter(F.lower("k").contains("ti"))
    firsts = rows.groupBy(F.lower("k").alias("folded")).agg(F.min_by("k", F.struct("created_at", "i")).alias("suggestion"))
    firsts = firsts.withColumn("is_prefix", F.col("folded").startswith("ti"))
    return firsts.orderBy(~F.col("is_prefix"), "folded").limit(5).select("suggestion", "is_prefix")


@query(
    "uploader_profile",
    f"""WITH {WORKS_SQL} SELECT w.uploader, coalesce(nullif(trim(coalesce(s.s_name, '')), ''), w.uploader) AS display_name,
      count(*) AS n, count(*) FILTER (w.status = 'approved') AS approved
    FROM works w LEFT JOIN supplier s ON 'src' || CAST(s.s_suppkey AS VARCHAR) = w.uploader GROUP BY ALL""",
)
def uploader_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by uploader with a display name from a dimension table, the key itself where there is none."""
    people = read(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), "s_suppkey").alias("uploader"), "s_name")
    counted = works(spark, sf_dir).groupBy("uploader").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "approved").alias("approved"))
    name = F.coalesce(F.nullif(F.trim(F.coalesce("s_name", F.lit(""))), F.lit("")), F.col("uploader"))
    return counted.join(people, "uploader", "left").select("uploader", name.alias("display_name"), "n", "approved")


#: Version of the fingerprint's form, and rows, then blocks, of one digest.
FORM, ROWS_OF_A_BLOCK = "library-2", 10_000
_COVERED = ["title", "abstract", "program", "uploader", "year", "created", "keywords"]
_PREFIXED = " || ".join(f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '-')" for c in _COVERED)


@query(
    "library_fingerprint",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, covered AS (SELECT w.id, w.status, w.title, w.abstract, w.program, w.uploader, CAST(w.year AS VARCHAR) AS year,
      CAST(epoch_us(w.created_at) AS VARCHAR) AS created, array_to_string(k.keywords, chr(31)) AS keywords FROM works w JOIN keyworded k ON k.id = w.id),
    digests AS (SELECT status, id, sha256('{FORM}:' || CAST(id AS VARCHAR) || ':' || {_PREFIXED}) AS h FROM covered),
    blocks AS (SELECT status, id // {ROWS_OF_A_BLOCK} AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY id, h)) AS h FROM digests GROUP BY ALL),
    upper AS (SELECT status, b // {ROWS_OF_A_BLOCK} AS b, sum(n) AS n, sha256(string_agg(h, '' ORDER BY b)) AS h FROM blocks GROUP BY status, b // {ROWS_OF_A_BLOCK})
    SELECT status, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM upper GROUP BY status""",
)
def library_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each review state over digests of blocks of ten thousand rows, and of as many blocks.

    Every field has its length before it, so that no two rows read alike, and the form
    has a version. A block is a range of ids, so its digests are as many as it has ids,
    and blocks of one state are hashed by different tasks.
    """
    rows = works(spark, sf_dir).select(
        "id", "status", "title", "abstract", "program", "uploader", F.col("year").cast("string").alias("year"),
        F.unix_micros(F.col("created_at").cast("timestamp")).cast("string").alias("created"), F.array_join("keywords", "\x1f").alias("keywords"),
    )
    prefixed = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in _COVERED]
    row = F.sha2(F.concat(F.lit(f"{FORM}:"), F.col("id").cast("string"), F.lit(":"), *prefixed), 256)

    def hashed(order: list[str]):
        # as many as a block has members
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "h"))), lambda x: x["h"]), ""), 256).alias("h")

    level = rows.select("status", "id", row.alias("h")).groupBy("status", F.floor(F.col("id") / ROWS_OF_A_BLOCK).alias("b")).agg(F.count("*").alias("n"), hashed(["id"]))
    level = level.groupBy("status", F.floor(F.col("b") / ROWS_OF_A_BLOCK).alias("c")).agg(F.sum("n").alias("n"), hashed(["b"]))
    level = level.withColumnRenamed("c", "b").groupBy("status").agg(F.sum("n").alias("n"), hashed(["b"]))
    return level.withColumnRenamed("h", "fingerprint")
