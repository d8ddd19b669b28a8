"""Search with facets, review lists, lookups, dashboards and subject charts over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.operators.facets import dashboard, facets, first_of, holds_all, listed, looked_up
from scholarlens.operators.integrity import unpaired
from scholarlens.plans.repository import LAST_YEAR
from scholarlens.registry import query
from scholarlens.sources.views import KEYWORDS_SQL, WORKS_SQL, read, subjects, works

_ROLES = ["student", "faculty", "administrator"]
_REVIEWS = f"""{WORKS_SQL}, kept AS (SELECT w.*, CASE WHEN w.id % 3 > 0 THEN CAST(e.label AS BIGINT) END AS subject,
  CASE WHEN w.id % 3 > 0 AND w.id % 10 <> 7 THEN w.created_at END AS reviewed_at FROM works w LEFT JOIN embeddings e ON e.vec_id = w.id)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with their subject for two thirds of the ids and the time of its review, which one in ten ids lacks."""
    i = F.col("id")
    rows = works(spark, sf_dir).drop("keywords").join(subjects(spark, sf_dir).select("id", F.col("subject").alias("s")), "id", "left")
    has = i % 3 > 0
    return rows.withColumns({"subject": F.when(has, F.col("s")), "reviewed_at": F.when(has & (i % 10 != 7), F.col("created_at"))}).drop("s")


@query(
    "faceted_search",
    f"""WITH {WORKS_SQL}, hit AS (SELECT program, status, CAST(year AS VARCHAR) AS year FROM works
      WHERE (contains(lower(title), 'en') OR contains(lower(uploader), 'en') OR contains(lower(program), 'en'))
        AND (contains(lower(title), 'src') OR contains(lower(uploader), 'src') OR contains(lower(program), 'src')))
    SELECT 'program' AS facet, program AS value, count(*) AS n FROM hit GROUP BY program UNION ALL SELECT 'status', status, count(*) FROM hit GROUP BY status
    UNION ALL SELECT 'year', year, count(*) FROM hit GROUP BY year UNION ALL SELECT 'all', NULL, count(*) FROM hit HAVING count(*) > 0""",
)
def faceted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of which title, uploader or program hold both words of a query, counted by program, state and year in one pass."""
    hit = works(spark, sf_dir).filter(holds_all("EN src", ["title", "uploader", "program"]))
    return facets(hit, ["program", "status", "year"])


@query(
    "review_lists",
    f"""WITH {_REVIEWS}
    SELECT 'pending' AS list, id, title FROM kept WHERE status = 'approved' AND subject IS NULL AND reviewed_at IS NULL
    UNION ALL SELECT 'reviewed', id, title FROM kept WHERE status = 'approved' AND subject IS NOT NULL AND reviewed_at IS NOT NULL
    UNION ALL SELECT 'own', id, title FROM kept WHERE uploader = 'src3'""",
)
def review_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose subject waits for review, works reviewed, and what one student has handed in."""
    rows = reviews(spark, sf_dir)
    lists = {
        "pending": listed(rows, "src3", "faculty", review="pending"),
        "reviewed": listed(rows, "src3", "faculty", mine="false", review="reviewed"),
        "own": listed(rows, "src3", "student", mine="TRUE"),
    }
    out = None
    for name, part in lists.items():
        part = part.select(F.lit(name).alias("list"), "id", "title")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "subject_pairing_faults",
    f"WITH {_REVIEWS} SELECT id, subject, reviewed_at IS NOT NULL AS reviewed FROM kept WHERE (subject IS NULL) <> (reviewed_at IS NULL)",
)
def subject_pairing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with a subject and no time of review, or the other way round."""
    return unpaired(reviews(spark, sf_dir), "subject", "reviewed_at").select("id", "subject", F.col("reviewed_at").isNotNull().alias("reviewed"))


@query(
    "looked_up_works",
    f"""WITH {WORKS_SQL}, asked AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 4 THEN event_id ELSE user_id END AS wanted FROM events)
    SELECT a.event_id, w.id IS NOT NULL AS found, w.title, w.status FROM asked a
    LEFT JOIN works w ON w.id = a.wanted AND (w.status = 'approved' OR w.uploader = 'src3')""",
)
def looked_up_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests for single works get: malformed ids, unknown ids and works that the reader may not see are not found alike."""
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    key = F.when(i % 5 == 0, F.concat(user, F.lit("x"))).when(i % 5 == 4, F.concat(F.lit(" "), i.cast("string"))).otherwise(user)
    asked = read(spark, sf_dir, "events").select("event_id", key.alias("key"))
    seen = listed(works(spark, sf_dir), "src3", "student")
    return looked_up(asked, "key", seen, ["title", "status"]).select("event_id", "found", "title", "status")


def _text(entries: str) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",")


@query(
    "dashboards",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, since AS (SELECT TIMESTAMP '2024-01-01 05:00:00' AS t),
    t AS (SELECT count(*) AS total, count(*) FILTER (status = 'approved') AS approved,
      count(*) FILTER (status = 'approved' AND id IN (SELECT vec_id FROM embeddings)) AS semantic_ready,
      count(*) FILTER (created_at >= (SELECT t FROM since)) AS recent, count(*) FILTER (status = 'pending_review') AS waiting FROM works),
    p AS (SELECT program AS name, count(*) AS n FROM works WHERE status = 'approved' GROUP BY program),
    y AS (SELECT year AS name, count(*) AS n FROM works WHERE status = 'approved' AND year >= {LAST_YEAR - 9} GROUP BY year),
    k AS (SELECT k AS name, count(*) AS n FROM (SELECT unnest(keywords) AS k FROM keyworded WHERE status = 'approved') GROUP BY k ORDER BY n DESC, k LIMIT 10)
    SELECT r.role, t.total, t.approved, t.semantic_ready, t.recent, (SELECT name FROM p ORDER BY n DESC, name LIMIT 1) AS busiest,
      (SELECT string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FROM p) AS programs, (SELECT string_agg(name || ':' || n, ',' ORDER BY name) FROM y) AS growth,
      (SELECT string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FROM k) AS keywords, CASE WHEN r.role <> 'student' THEN t.waiting END AS pending
    FROM t, (SELECT unnest(['student', 'faculty', 'administrator']) AS role) r""",
)
def dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that each role sees of the repository, with their lists as text."""
    ready = subjects(spark, sf_dir).select("id", F.lit(True).alias("ready"))
    rows = works(spark, sf_dir).drop("abstract", "title").join(ready, "id", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
    roles = spark.createDataFrame([(r,) for r in _ROLES], "role string")
    found = dashboard(rows, roles, LAST_YEAR, F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    return found.withColumns({c: _text(c) for c in ("programs", "growth", "keywords")})


@query(
    "subject_charts",
    f"""WITH {_REVIEWS}, vocabulary AS (SELECT CAST(p_partkey AS BIGINT) AS subject FROM part WHERE p_partkey < 60), s AS (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, id) AS r
      FROM kept WHERE status = 'approved' AND subject IS NOT NULL),
    c AS (SELECT subject, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS samples FROM s GROUP BY subject)
    SELECT v.subject, c.n, c.samples, row_number() OVER (ORDER BY c.n DESC, v.subject) AS bar FROM vocabulary v JOIN c ON c.subject = v.subject ORDER BY bar LIMIT 8""",
)
def subject_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest subjects of a vocabulary with their newest three works; subjects without works have no bar."""
    vocabulary = read(spark, sf_dir, "part").filter("p_partkey < 60").select(F.col("p_partkey").alias("subject"))
    kept = reviews(spark, sf_dir).filter("status = 'approved' and subject is not null").select("subject", "id", "created_at")
    counted = kept.groupBy("subject").agg(F.count("*").alias("n"))
    top = vocabulary.join(counted, "subject").orderBy(F.desc("n"), "subject").limit(8)
    newest = first_of(kept.join(top.select("subject"), "subject", "left_semi"), "subject", "id", [F.desc("created_at"), F.col("id")], 3)
    # eight rows are numbered
    bars = top.agg(F.collect_list(F.struct((-F.col("n")).alias("m"), "subject")).alias("s")).select(F.posexplode(F.array_sort("s")).alias("bar", "s"))
    bars = bars.select((F.col("bar") + 1).cast("long").alias("bar"), F.col("s.subject").alias("subject"), (-F.col("s.m")).alias("n"))
    samples = F.array_join(F.transform("values", lambda x: x.cast("string")), ",")
    return bars.join(newest, "subject").select("subject", "n", samples.alias("samples"), "bar")
