"""Applicants derived from the documents, their checks and what is logged of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.operators.verification import OTHER_INSTITUTIONS, OTHER_PROGRAMS, first_held, logged_events, verified
from scholarlens.registry import query
from scholarlens.sources.views import KEYWORDS_SQL, WORKS_SQL, works

#: The applicants of the queries as DuckDB SQL; the same rules as applicants() below.
_APPLICANTS = f"""{WORKS_SQL}, {KEYWORDS_SQL}, named AS (SELECT k.id, k.abstract, k.keywords[1] AS f, k.keywords[2] AS l, k.id % 8 AS m FROM
  (SELECT w.id, w.abstract, x.keywords FROM works w JOIN keyworded x ON x.id = w.id) k WHERE len(k.keywords) >= 2),
fields AS (SELECT *, CASE WHEN id % 11 <> 0 THEN f || ' ' || l END AS full_name,
  CASE m WHEN 1 THEN NULL WHEN 2 THEN 'Holy Angel University' WHEN 3 THEN 'DHVSU' ELSE 'Pampanga State University' END AS institution,
  CASE m WHEN 3 THEN NULL WHEN 4 THEN 'Colege of Computting Studdies' WHEN 5 THEN 'College of Law' ELSE 'CCS' END AS college,
  CASE m WHEN 6 THEN 'BS Nursing' WHEN 7 THEN NULL WHEN 3 THEN 'BS Information Technology' ELSE 'BS Information System' END AS program,
  CASE WHEN id % 13 <> 0 THEN CAST(40 + (id * 7) % 60 AS DOUBLE) END AS confidence,
  CASE id % 10 WHEN 0 THEN 'approved' WHEN 1 THEN 'denied' ELSE 'processing' END AS state FROM named),
applicants AS (SELECT *, concat_ws(chr(10), institution, college, CASE WHEN m = 1 AND id % 3 = 0 THEN 'Honorio' END,
  CASE WHEN id % 5 = 0 THEN 'Name: ' || f ELSE 'Name: ' || f || ' ' || l END,
  'No. 2023-' || CAST(100000 + id AS VARCHAR) || CASE WHEN id % 7 = 0 THEN '9' ELSE '' END || '.', abstract) AS text FROM fields)"""


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One applicant a work that has two keywords, which are the name; fields, scan and state of the request go by its number."""
    k, m = F.col("keywords"), F.col("id") % 8
    rows = works(spark, sf_dir).select("id", "abstract", "keywords").filter(F.size(k) >= 2)
    rows = rows.select("id", "abstract", m.alias("m"), F.get(k, F.lit(0)).alias("first_name"), F.get(k, F.lit(1)).alias("last_name"))
    m, i, name = F.col("m"), F.col("id"), F.concat_ws(" ", "first_name", "last_name")
    number = F.concat(F.lit("2023"), (i + 100_000).cast("string"))
    rows = rows.withColumns({
        "full_name": F.when(i % 11 != 0, name),
        "institution": F.when(m == 2, "Holy Angel University").when(m == 3, "DHVSU").when(m != 1, "Pampanga State University"),
        "college": F.when(m == 4, "Colege of Computting Studdies").when(m == 5, "College of Law").when(m != 3, "CCS"),
        "program": F.when(m == 6, "BS Nursing").when(m == 3, "bsit").when(m != 7, "Information Systems"),
        "confidence": F.when(i % 13 != 0, (i * 7 % 60 + 40).cast("double")),
        "state": F.when(i % 10 == 0, "approved").when(i % 10 == 1, "denied").otherwise("processing"),
        "email": F.concat(number, F.lit("@school.edu")),
    })
    shown = F.when(i % 5 == 0, F.col("first_name")).otherwise(name)
    printed = F.concat(F.lit("No. 2023-"), (i + 100_000).cast("string"), F.when(i % 7 == 0, "9").otherwise(""), F.lit("."))
    hint = F.when((m == 1) & (i % 3 == 0), "Honorio")
    return rows.withColumn("text", F.concat_ws("\n", "institution", "college", hint, F.concat(F.lit("Name: "), shown), printed, "abstract"))


# what the rules give on the applicants, in DuckDB
_JUDGED = r"""words AS (SELECT *, regexp_extract_all(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[a-z0-9]+') AS w,
  list_filter([CASE WHEN full_name IS NULL THEN 'missing: full_name' END, CASE WHEN m = 1 THEN 'missing: institution' END,
    CASE WHEN m = 7 THEN 'missing: program' END, CASE WHEN m = 2 THEN 'invalid institution: ' || institution END,
    CASE WHEN m = 5 THEN 'invalid college: ' || college END, CASE WHEN m = 6 THEN 'invalid program: ' || program END], lambda x: x IS NOT NULL) AS said FROM applicants),
told AS (SELECT *, len(list_filter(said, lambda x: starts_with(x, 'invalid'))) > 0 AS clear,
  regexp_matches(lower(text), 'dhvsu|pampanga|honorio|ventur') OR
    CAST(contains(lower(text), 'psu') AS INT) + CAST(contains(lower(text), 'ccs') AS INT) + CAST(contains(lower(text), 'college of computing') AS INT) >= 2 AS signs,
  list_filter([CASE WHEN NOT (list_contains(w, name_of(f)) AND list_contains(w, name_of(l))) THEN 'name_mismatch' END,
    CASE WHEN NOT regexp_matches(text, '(^|[^0-9])' || array_to_string(string_split('2023' || CAST(100000 + id AS VARCHAR), ''), '[ -]?') || '([^0-9]|$)')
      THEN 'student_number_mismatch' END], lambda x: x IS NOT NULL) AS off FROM words),
first_ AS (SELECT *, CASE WHEN confidence IS NULL THEN 'scan_failed' WHEN clear THEN 'rule_validation_failed' WHEN len(said) > 0 AND NOT signs THEN 'invalid_institution'
  WHEN len(said) > 0 THEN 'incomplete_extraction' WHEN confidence >= 75 THEN 'high_confidence' WHEN confidence >= 60 THEN 'ocr_medium_confidence' ELSE 'ocr_low_confidence' END AS why FROM told),
second_ AS (SELECT *, CASE WHEN why = 'scan_failed' THEN 'error' WHEN why IN ('rule_validation_failed', 'invalid_institution') THEN 'rejected'
  WHEN why = 'high_confidence' AND len(off) = 0 THEN 'auto_approved' ELSE 'pending_manual_review' END AS status,
  CASE WHEN why = 'high_confidence' AND len(off) > 0 THEN off[1] ELSE why END AS reason FROM first_),
judged AS (SELECT id, text, state, CASE WHEN status = 'error' THEN '' ELSE array_to_string(list_concat(said,
    CASE WHEN why = 'invalid_institution' THEN ['no sign of the institution'] ELSE [] END,
    CASE WHEN why LIKE 'ocr%' THEN ['confidence ' || printf('%.1f', confidence)] ELSE [] END,
    CASE WHEN status = 'pending_manual_review' THEN off ELSE [] END), '; ') END AS flags, status, reason FROM second_)"""
# a name's one word, as the rules read it
_JUDGED = _JUDGED.replace("name_of(f)", r"lower(regexp_replace(strip_accents(f), '[^\x00-\x7F]', '', 'g'))").replace(
    "name_of(l)", r"lower(regexp_replace(strip_accents(l), '[^\x00-\x7F]', '', 'g'))"
)


@query(
    "verified_applicants",
    f"""WITH {_APPLICANTS}, {_JUDGED}, ended AS (SELECT id, CASE WHEN state = 'processing' THEN status END AS status, CASE WHEN state = 'processing' THEN reason END AS reason,
      CASE WHEN state = 'processing' THEN flags END AS flags, CASE WHEN state <> 'processing' THEN state WHEN status = 'auto_approved' THEN 'pending_email_verification'
        WHEN status = 'rejected' THEN 'denied' ELSE 'pending' END AS request_state FROM judged)
    SELECT *, CASE request_state WHEN 'pending' THEN 'pending_manual_review' WHEN 'denied' THEN 'rejected' ELSE request_state END AS reported FROM ended""",
)
def verified_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on each applicant whose request is open, why, what was flagged, and how the request stands then."""
    found = verified(applicants(spark, sf_dir))
    return found.select("id", "status", "reason", F.array_join("flags", "; ").alias("flags"), "request_state", "reported")


@query(
    "verification_events",
    f"""WITH {_APPLICANTS}, {_JUDGED}, open AS (SELECT *, CASE WHEN status = 'error' THEN ['started', 'error']
      ELSE ['started', 'completed', CASE status WHEN 'pending_manual_review' THEN 'pending_review' ELSE status END] END AS e FROM judged WHERE state = 'processing'),
    flat AS (SELECT id, text, reason, len(e) AS n, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM open)
    SELECT id, CAST(k - 1 AS BIGINT) AS step, 'access_request.verification.' || x AS event_type, sha256(text) AS document, CASE WHEN k = n THEN reason END AS reason FROM flat""",
)
def verification_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is logged of each check: its start, its completion and its outcome, or its start and an error."""
    return logged_events(verified(applicants(spark, sf_dir)), "id")


def _first(names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(text), '{n.lower()}') THEN '{n}'" for n in names) + " END"


@query(
    "other_schools",
    f"""WITH {_APPLICANTS}, found AS (SELECT id, {_first(OTHER_INSTITUTIONS)} AS institution, {_first(OTHER_PROGRAMS)} AS program
      FROM (SELECT id, text || chr(10) || coalesce(program, '') AS text FROM applicants))
    SELECT * FROM found WHERE institution IS NOT NULL OR program IS NOT NULL""",
)
def other_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants whose document names another school or program anywhere, and the first such name of the lists."""
    rows = applicants(spark, sf_dir)
    # programs as the oracle's table has them; only the nursing one is of another school
    program = F.when(F.col("m") == 6, "BS Nursing").otherwise("")
    rows = rows.select("id", F.concat("text", F.lit("\n"), program).alias("text"))
    found = rows.select("id", first_held("text", OTHER_INSTITUTIONS).alias("institution"), first_held("text", OTHER_PROGRAMS).alias("program"))
    return found.filter("institution is not null or program is not null")
