"""Uploads, stored files, acronyms that a glossary lacks, and reports of overlap over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.functions.glossary import acronym_candidates
from scholarlens.operators.facets import first_of
from scholarlens.operators.vectors import ADVICE, NOT_MEASURED, advice, overlap_reports
from scholarlens.plans.forms import _CAPITALS, people
from scholarlens.plans.vectors import _DOT, DIM
from scholarlens.registry import query
from scholarlens.sources.files import MANUSCRIPTS, SCANS, file_states, refused
from scholarlens.sources.views import read, subjects

_KINDS = ["pdf", "docx", "png", "jpg", "txt"]
_HEADS = ["25504446", "504B0304", "89504E470D0A1A0A", "FFD8FFE0", "00"]
_LIMIT = 5_000


@query(
    "upload_checks",
    f"""WITH f AS (SELECT doc_id AS id, doc_id % 5 AS named, CASE WHEN doc_id % 4 = 0 THEN (doc_id + 1) % 5 ELSE doc_id % 5 END AS held,
      octet_length(encode(text)) + CASE CASE WHEN doc_id % 4 = 0 THEN (doc_id + 1) % 5 ELSE doc_id % 5 END WHEN 2 THEN 8 WHEN 4 THEN 1 ELSE 4 END AS size FROM documents)
    SELECT id, CASE WHEN id % 23 = 0 THEN 'MISSING_FILE' WHEN size > {_LIMIT} THEN 'FILE_TOO_LARGE' WHEN named > 1 THEN 'FILE_TYPE_NOT_ALLOWED' WHEN named <> held THEN 'FILE_TYPE_MISMATCH' END AS as_manuscript,
      CASE WHEN id % 23 = 0 THEN 'MISSING_FILE' WHEN size > {_LIMIT} THEN 'FILE_TOO_LARGE' WHEN named NOT IN (0, 2, 3) THEN 'FILE_TYPE_NOT_ALLOWED' WHEN held = 4 THEN 'FILE_CORRUPT'
        WHEN held = 1 THEN 'FILE_TYPE_MISMATCH' END AS as_scan FROM f""",
)
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each text, set after the first bytes of a file type, is refused as a manuscript and as a scan; a fourth begins otherwise than named."""
    i = F.col("doc_id")
    held = F.when(i % 4 == 0, (i + 1) % 5).otherwise(i % 5)
    head = F.unhex(F.get(F.array(*[F.lit(h) for h in _HEADS]), held.cast("int")))
    name = F.concat(F.lit("Work.v"), i.cast("string"), F.lit("."), F.get(F.array(*[F.lit(k) for k in _KINDS]), (i % 5).cast("int")))
    content = F.when(i % 23 != 0, F.concat(head, F.encode("text", "UTF-8")))
    rows = read(spark, sf_dir, "documents").select(i.alias("id"), name.alias("name"), content.alias("content"))
    return rows.select("id", refused("name", "content", MANUSCRIPTS, _LIMIT).alias("as_manuscript"), refused("name", "content", SCANS, _LIMIT, True).alias("as_scan"))


@query(
    "stored_file_states",
    """WITH named AS (SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'f/' || CAST(doc_id * 2 AS VARCHAR) END AS name FROM documents),
    listing AS (SELECT 'f/' || CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 9 END AS length FROM orders WHERE o_orderkey % 7 <> 3)
    SELECT id, CASE WHEN coalesce(name, '') = '' THEN 'blank' WHEN length IS NULL THEN 'missing' WHEN length = 0 THEN 'empty' ELSE 'present' END AS file_state
    FROM named LEFT JOIN listing ON path = name""",
)
def stored_file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the file of each work is named, listed and not empty; orders stand for the listing."""
    i = F.col("doc_id")
    name = F.when(i % 9 == 1, "").when(i % 9 != 0, F.concat(F.lit("f/"), (i * 2).cast("string")))
    rows = read(spark, sf_dir, "documents").select(i.alias("id"), name.alias("name"))
    path, length = F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderstatus") == "P", 0).otherwise(9)
    listing = read(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 3").select(path.alias("path"), length.alias("length"))
    return file_states(rows, "name", listing).select("id", "file_state")


@query(
    "unknown_acronyms",
    f"""WITH {_CAPITALS}, pairs AS (SELECT id, c[1][1] || c[2][1] AS acronym, c[1] || ' ' || c[2] AS form FROM people UNION ALL
      SELECT id, c[3][1] || c[4][1] || c[5][1], c[3] || ' and ' || c[4] || '-' || c[5] FROM people WHERE id % 2 = 0),
    counted AS (SELECT acronym, form, count(*) AS n FROM pairs WHERE acronym NOT IN ('AI', 'IT') GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY acronym ORDER BY n DESC, form) AS r FROM counted)
    SELECT acronym, CAST(sum(n) AS BIGINT) AS n, string_agg(form || ' (' || n || ')', ' | ' ORDER BY r) FILTER (r <= 3) AS forms FROM ranked GROUP BY acronym""",
)
def unknown_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms in brackets that two known ones are not, by how often they stand, with their three most common long forms."""
    c = [F.get("c", F.lit(i)) for i in range(5)]

    def letters(*words):
        return F.concat(F.lit(" ("), *[F.substring(w, 1, 1) for w in words], F.lit(")"))

    one = F.concat(F.lit("On "), c[0], F.lit(" "), c[1], letters(c[0], c[1]), F.lit("."))
    two = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" It has "), c[2], F.lit(" and "), c[3], F.lit("-"), c[4], letters(*c[2:]), F.lit(".")))
    pairs = people(spark, sf_dir).select(F.explode(acronym_candidates(F.concat(one, F.coalesce(two, F.lit(""))))).alias("p"))
    pairs = pairs.select(F.split_part("p", F.lit("\t"), F.lit(1)).alias("acronym"), F.split_part("p", F.lit("\t"), F.lit(2)).alias("form"))
    counted = pairs.filter(~F.col("acronym").isin("AI", "IT")).groupBy("acronym", "form").agg(F.count("*").alias("n"))
    sums = counted.groupBy("acronym").agg(F.sum("n").alias("n"))
    shown = counted.withColumn("shown", F.concat("form", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    top = first_of(shown, "acronym", "shown", [F.desc("n"), F.col("form")], 3)
    return sums.join(top, "acronym").select("acronym", "n", F.array_join("values", " | ").alias("forms"))


def _advised() -> str:
    return "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ADVICE.items()) + f" ELSE '{NOT_MEASURED}' END"


@query(
    "overlap_reports",
    f"""WITH p AS (SELECT vec_id AS id, embedding AS v, CASE WHEN vec_id % 150 = 0 THEN 'missing_title_embedding' WHEN vec_id % 250 = 0 THEN 'dimension_mismatch' END AS reason
      FROM embeddings WHERE vec_id % 50 = 0),
    scored AS (SELECT p.id, c.vec_id AS m, {_DOT.format(a="p.v", b="c.embedding")} AS s FROM p JOIN embeddings c ON c.vec_id <> p.id WHERE p.reason IS NULL),
    top AS (SELECT id, max(s) AS best FROM scored GROUP BY id), chosen AS (SELECT id, min(m) AS match_id, min_by(s, m) AS s FROM scored JOIN top USING (id) WHERE s >= best - 1e-6 GROUP BY id),
    told AS (SELECT p.id, c.match_id, round(c.s, 4) AS score, CASE WHEN c.s >= 0.85 THEN 'High Overlap' WHEN c.s >= 0.6 THEN 'Moderate' WHEN c.s IS NOT NULL THEN 'Clean' ELSE 'Not computed' END AS label,
      p.reason, (SELECT count(*) FROM embeddings) AS corpus_size FROM p LEFT JOIN chosen c ON c.id = p.id)
    SELECT *, {_advised()} AS advice FROM told""",
)
def overlap_reports_of_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on every fiftieth row, some of whose vectors are lost or cut: the closest other row, a label, what to do, or why nothing was measured."""
    rows = subjects(spark, sf_dir).select("id", "vector")
    i = F.col("id")
    spoilt = F.when(i % 150 == 0, F.lit(None)).when(i % 250 == 0, F.slice("vector", 1, 9)).otherwise(F.col("vector"))
    found = overlap_reports(rows, rows.filter("id % 50 = 0").withColumn("vector", spoilt), DIM)
    return found.withColumn("advice", advice("label"))
