"""Projections and filters of single works: composed texts, excerpts, file names, review state, authors' words, citing works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlens.functions.text import squeezed
from scholarlens.plans.search import _CITED, citation_edges
from scholarlens.registry import query
from scholarlens.sources.views import KEYWORDS_SQL, WORKS_SQL, read, subjects, works

EXCERPT, FILE_NAME, PREVIEW = 300, 120, 500

#: Reviewed works with their subject; a subject counts as reviewed with an odd id.
_REVIEWED = "reviewed AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS subject, vec_id % 2 = 1 AS reviewed FROM embeddings)"


def composed(*parts: str | Column) -> Column:
    """The parts that are not blank, trimmed, with an empty line between them."""
    trimmed = [F.trim(F.col(p) if isinstance(p, str) else p) for p in parts]
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in trimmed])


def excerpt(text: str | Column, most: int = EXCERPT) -> Column:
    """A text of ``most`` characters at most, cut after a word and marked by an ellipsis."""
    text = squeezed(text)
    cut = F.regexp_replace(F.substring(text, 1, most + 1), r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(cut, 1, most), F.lit("…")))


def file_name(title: str | Column, year: str | Column) -> Column:
    """A title as a file name: colons as dashes, no forbidden characters, cut after a word, with the year in brackets."""
    year = F.col(year) if isinstance(year, str) else year
    plain = F.regexp_replace(F.regexp_replace(title, r"\s*:", " -"), r'[<>"/\\|?*\x00-\x1F]', "")
    plain = squeezed(plain)
    cut = F.regexp_replace(F.substring(plain, 1, FILE_NAME + 1), r"\s+\S*$", "")
    short = F.when(F.length(plain) <= FILE_NAME, plain).otherwise(F.substring(cut, 1, FILE_NAME))
    return F.concat(short, F.lit(" ("), year.cast("string"), F.lit(").pdf"))


@query(
    "composed_texts",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, parts AS (SELECT w.id, trim(w.title) AS t, array_to_string(k.keywords, ' ') AS k, trim(w.abstract, ' ') AS a,
      trim(substring(w.abstract, 1, 2000), ' ') AS f FROM works w JOIN keyworded k ON k.id = w.id)
    SELECT id, sha256(concat_ws(chr(10) || chr(10), nullif(t, ''), nullif(k, ''), nullif(a, ''), nullif(f, ''))) AS encoded_text,
      sha256(concat_ws(chr(10) || chr(10), nullif(t, ''), nullif(a, ''), nullif(k, ''))) AS described_text FROM parts""",
)
def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts that are encoded (keywords second, a head of the full text last) and described by terms (no full text)."""
    rows = works(spark, sf_dir).withColumn("k", F.array_join("keywords", " "))
    encoded = composed("title", "k", "abstract", F.substring("abstract", 1, 2000))
    return rows.select("id", F.sha2(encoded, 256).alias("encoded_text"), F.sha2(composed("title", "abstract", "k"), 256).alias("described_text"))


_SHORT = r"""CASE WHEN length({c}) <= {n} THEN {c} ELSE substring(regexp_replace(substring({c}, 1, {n} + 1), '\s+\S*$', ''), 1, {n}) || '{end}' END"""
_SQUEEZED = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query(
    "work_excerpts",
    f"""WITH {WORKS_SQL}, s AS (SELECT id, year, {_SQUEEZED.format(c='abstract')} AS a, abstract,
      {_SQUEEZED.format(c=r"regexp_replace(regexp_replace(title, '\s*:', ' -', 'g'), '[<>\"/\\|?*\x00-\x1F]', '', 'g')")} AS f FROM works)
    SELECT id, {_SHORT.format(c='a', n=EXCERPT, end='…')} AS excerpt, {_SHORT.format(c='f', n=FILE_NAME, end='')} || ' (' || CAST(year AS VARCHAR) || ').pdf' AS file_name,
      CASE WHEN length(abstract) <= {PREVIEW} THEN abstract ELSE substring(abstract, 1, {PREVIEW}) || '...' END AS preview FROM s""",
)
def work_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An excerpt cut after a word, a name for the file, and a plain cut preview of each work."""
    preview = F.when(F.length("abstract") <= PREVIEW, F.col("abstract")).otherwise(F.concat(F.substring("abstract", 1, PREVIEW), F.lit("...")))
    return works(spark, sf_dir).select(
        "id", excerpt("abstract").alias("excerpt"), file_name("title", "year").alias("file_name"), preview.alias("preview")
    )


def reviewed_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject, reviewed): a work's subject; it counts as reviewed with an odd id."""
    return subjects(spark, sf_dir).select("id", "subject", (F.col("id") % 2 == 1).alias("reviewed"))


@query(
    "work_details",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, {_REVIEWED}
    SELECT w.id, w.title, w.program, w.year, w.status, w.uploader, len(k.keywords) AS n_keywords, array_to_string(k.keywords, ', ') AS keyword_list,
      length(w.abstract) AS abstract_length, CASE WHEN r.reviewed THEN r.subject END AS subject, r.id IS NOT NULL AS semantic_ready,
      w.uploader = 'src3' AS is_mine FROM works w JOIN keyworded k ON k.id = w.id LEFT JOIN reviewed r ON r.id = w.id""",
)
def work_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of each work for one reader; its subject is shown only once it has been reviewed."""
    rows = works(spark, sf_dir).join(reviewed_subjects(spark, sf_dir).withColumn("ready", F.lit(True)), "id", "left")
    return rows.select(
        "id", "title", "program", "year", "status", "uploader",
        F.size("keywords").cast("long").alias("n_keywords"),
        F.array_join("keywords", ", ").alias("keyword_list"),
        F.length("abstract").cast("long").alias("abstract_length"),
        F.when(F.col("reviewed"), F.col("subject")).alias("subject"),
        F.coalesce("ready", F.lit(False)).alias("semantic_ready"),
        (F.col("uploader") == "src3").alias("is_mine"),
    )


@query(
    "subject_review_queue",
    f"""WITH {WORKS_SQL}, {_REVIEWED} SELECT w.id, CASE WHEN r.reviewed THEN 'reviewed' ELSE 'pending' END AS review
    FROM works w LEFT JOIN reviewed r ON r.id = w.id WHERE w.status = 'approved'""",
)
def subject_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved works by the state of their subject's review; one without a subject is pending."""
    rows = works(spark, sf_dir).filter("status = 'approved'").select("id").join(reviewed_subjects(spark, sf_dir), "id", "left")
    return rows.select("id", F.when(F.col("reviewed"), "reviewed").otherwise("pending").alias("review"))


@query(
    "missing_vectors",
    f"""WITH {WORKS_SQL} SELECT w.id, sha256('encoder' || chr(31) || w.title) AS title_key FROM works w LEFT JOIN embeddings e ON e.vec_id = w.id
    WHERE e.vec_id IS NULL OR len(e.embedding) = 0""",
)
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that have no usable vector, with the key under which their title's vector would be kept."""
    ready = subjects(spark, sf_dir).filter(F.size("vector") > 0).select("id")
    key = F.sha2(F.concat(F.lit("encoder\x1f"), "title"), 256)
    return works(spark, sf_dir).join(ready, "id", "left_anti").select("id", key.alias("title_key"))


_NAMES = r"named AS (SELECT p_partkey AS id, p_name AS author, regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+') AS w FROM part)"


@query(
    "author_match",
    f"WITH {_NAMES} SELECT id, author FROM named WHERE len(list_filter(['widget', 'red'], lambda q: NOT list_contains(w, q))) = 0",
)
def author_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of whose names all words of a query are words, in any order; queries under three letters match none."""
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("author"))
    return names.filter(named_by("author", "Widget, RED"))


def named_by(author: str | Column, wanted: str) -> Column:
    """Are all words of ``wanted``, three characters or more together, words of a name?"""
    asked = F.regexp_extract_all(F.lower(F.lit(wanted)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = F.regexp_extract_all(F.lower(author), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return (F.size(F.array_except(asked, words)) == 0) & (F.length(F.array_join(asked, "")) >= 3)


@query(
    "citing_works",
    f"""WITH {WORKS_SQL}, {_CITED}, seen AS (SELECT e.cited, w.id, w.title, w.year, w.status = 'approved' OR w.uploader = 'src3' AS shown
      FROM edges e JOIN works w ON w.id = e.citing WHERE w.status <> 'rejected' AND e.citing <> e.cited)
    SELECT cited, id, title, year, row_number() OVER (PARTITION BY cited ORDER BY year DESC, title, id) AS place,
      (SELECT count(*) FROM seen h WHERE h.cited = seen.cited AND NOT h.shown) AS hidden FROM seen WHERE shown""",
)
def citing_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works that cite each target, newest first, as one reader sees them, and how many are hidden from that reader."""
    edges = citation_edges(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).filter("citing <> cited")
    rows = works(spark, sf_dir).filter("status <> 'rejected'").select(
        F.col("id").alias("citing"), "title", "year", ((F.col("status") == "approved") | (F.col("uploader") == "src3")).alias("shown")
    )
    seen = edges.join(rows, "citing")
    hidden = seen.groupBy("cited").agg(F.count_if(~F.col("shown")).alias("hidden"))
    order = Window.partitionBy("cited").orderBy(F.desc("year"), "title", "citing")
    shown = seen.filter("shown").withColumn("place", F.row_number().over(order).cast("long")).join(hidden, "cited")
    return shown.select("cited", F.col("citing").alias("id"), "title", "year", "place", "hidden")


@query(
    "subject_keyword_mode",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, flat AS (SELECT CAST(e.label AS BIGINT) AS subject, unnest(k.keywords) AS keyword FROM keyworded k JOIN embeddings e ON e.vec_id = k.id),
    counted AS (SELECT subject, keyword, count(*) AS n FROM flat GROUP BY subject, keyword),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, keyword) AS r FROM counted)
    SELECT subject, keyword, n FROM ranked WHERE r = 1""",
)
def subject_keyword_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common keyword of each subject's works; ties by name."""
    flat = works(spark, sf_dir).select("id", "keywords").join(subjects(spark, sf_dir).select("id", "subject"), "id")
    counted = flat.select("subject", F.explode("keywords").alias("keyword")).groupBy("subject", "keyword").agg(F.count("*").alias("n"))
    best = counted.groupBy("subject").agg(F.min_by(F.struct("keyword", "n"), F.struct(-F.col("n"), "keyword")).alias("b"))
    return best.select("subject", "b.keyword", "b.n")


@query(
    "share_offsets",
    f"""WITH {WORKS_SQL}, counted AS (SELECT program, count(*) AS n FROM works WHERE status = 'approved' GROUP BY program)
    SELECT program, n, CAST(coalesce(sum(n) OVER (ORDER BY n DESC, program ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM counted""",
)
def share_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved works by program, the largest first, with the sum of all before: where a slice of a ring begins."""
    counted = works(spark, sf_dir).filter("status = 'approved'").groupBy("program").agg(F.count("*").alias("n"))
    # one row a program: the window is as small as the enumeration
    before = Window.orderBy(F.desc("n"), "program").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("program", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


_JOBS = """attempts AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 'exception' WHEN event_type = 'click' THEN 'refused' ELSE 'done' END AS outcome,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events)"""


@query(
    "job_outcomes",
    f"""WITH {_JOBS}, closed AS (SELECT user_id, min(attempt) FILTER (outcome <> 'exception') AS closing FROM attempts WHERE attempt <= 3 GROUP BY user_id)
    SELECT a.event_id, a.user_id, a.attempt, CASE WHEN a.outcome = 'done' THEN 'succeeded' WHEN a.outcome = 'refused' OR a.attempt >= 3 THEN 'failed' ELSE 'queued' END AS state
    FROM attempts a JOIN closed c ON c.user_id = a.user_id WHERE a.attempt <= coalesce(c.closing, 3)""",
)
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a job after each attempt: done succeeds, a refusal fails for good, an exception queues it again up to the third."""
    kind = F.when(F.col("event_type") == "error", "exception").when(F.col("event_type") == "click", "refused").otherwise("done")
    # a user's log is a job, its first three events the attempts; Spark limits them before the shuffle
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tries = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("outcome"))
    tries = tries.withColumn("attempt", F.row_number().over(order)).filter("attempt <= 3")
    closing = F.min(F.when(F.col("outcome") != "exception", F.col("attempt"))).over(Window.partitionBy("user_id"))
    live = tries.withColumn("closing", closing).filter(F.col("attempt") <= F.coalesce("closing", F.lit(3)))
    over = (F.col("outcome") == "refused") | (F.col("attempt") >= 3)
    state = F.when(F.col("outcome") == "done", "succeeded").when(over, "failed").otherwise("queued")
    return live.select("event_id", "user_id", F.col("attempt").cast("long").alias("attempt"), state.alias("state"))


@query(
    "active_tokens",
    """WITH t AS (SELECT sha256(CAST(user_id AS VARCHAR) || chr(31) || event_type) AS token, user_id, ts, event_id, event_type FROM events),
    gone AS (SELECT user_id, max(ts) AS revoked FROM events WHERE event_type = 'error' GROUP BY user_id),
    latest AS (SELECT token, user_id, max(ts) AS issued FROM t WHERE event_type <> 'error' GROUP BY token, user_id)
    SELECT l.token, l.user_id FROM latest l LEFT JOIN gone g ON g.user_id = l.user_id
    WHERE (g.revoked IS NULL OR g.revoked < l.issued) AND l.issued > (SELECT max(ts) FROM events) - INTERVAL 7 DAY""",
)
def active_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are neither expired after a week nor revoked: an error revokes all earlier tokens of its user."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    token = F.sha2(F.concat(F.col("user_id").cast("string"), F.lit("\x1f"), "event_type"), 256)
    by_type = events.groupBy("user_id", "event_type").agg(F.max("ts").alias("issued"))
    gone = by_type.filter("event_type = 'error'").select("user_id", F.col("issued").alias("revoked"))
    rows = by_type.filter("event_type <> 'error'").join(gone, "user_id", "left").crossJoin(events.agg(F.max("ts").alias("now")))
    live = rows.filter("(revoked is null or revoked < issued) and issued > now - interval 7 days")
    return live.select(token.alias("token"), "user_id")
