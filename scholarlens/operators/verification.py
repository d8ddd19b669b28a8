"""Checks of applicants against their scanned documents: rules on fields, the decision, whose document it is, and what is logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.functions.lines import let
from scholarlens.functions.text import ascii_form
from scholarlens.operators.identity import ALIASES, matched_institutions, normal_program

#: Colleges that are allowed, the programs' own names, and names that tell another school or program.
COLLEGES = ["college of computing studies", "ccs"]
PROGRAMS = list(dict.fromkeys(p for _, p in ALIASES))
OTHER_INSTITUTIONS = [
    "University of the Philippines", "UP", "Holy Angel University", "HAU", "Angeles University Foundation", "AUF",
    "Ateneo", "De La Salle", "DLSU", "UST", "University of Santo Tomas",
]
OTHER_PROGRAMS = [
    "BS Biology", "BS Nursing", "BS Accountancy", "BS Civil Engineering", "BS Electrical Engineering",
    "BS Mechanical Engineering", "BS Architecture", "BS Psychology", "BS Business Administration", "BSBA",
]
#: Words of which one tells the institution, and words of which two do; confidences of a scan.
TELLING, SUPPORTING = ["dhvsu", "pampanga", "honorio", "ventura", "ventur"], ["psu", "ccs", "college of computing"]
HIGH, MEDIUM = 75.0, 60.0
#: States of a request after each decision, and what a job reports for each state.
REQUEST_STATES = {"auto_approved": "processing", "pending_manual_review": "pending", "rejected": "denied", "error": "pending"}
REPORTED = {"pending_email_verification": "pending_email_verification", "pending": "pending_manual_review", "denied": "rejected", "approved": "approved"}
_EVENTS = {"auto_approved": "auto_approved", "pending_manual_review": "pending_review", "rejected": "rejected", "error": "error"}
_EVENT = "access_request.verification."


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _mapped(key: Column, values: dict[str, str], default: Column | None = None) -> Column:
    found = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in values.items()])
    return found if default is None else F.coalesce(found, default)


def name_words(text: str | Column) -> Column:
    """Words of ASCII letters and digits in lower case, accents dropped; none for null."""
    plain = F.lower(ascii_form(F.coalesce(_column(text), F.lit(""))))
    return F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))


def name_on_document(first: str | Column, last: str | Column, text: str | Column) -> Column:
    """Does a text hold all words of the last name and one of the first as whole words? Single letters do not count."""
    words = name_words(text)
    given, family = (F.filter(name_words(n), lambda w: F.length(w) > 1) for n in (first, last))
    return (F.size(family) > 0) & (F.size(F.array_except(family, words)) == 0) & F.arrays_overlap(given, words)


def number_on_document(email: str | Column, text: str | Column) -> Column:
    """Does a text hold the digits before the @ as a whole number, of which any two may be a space or a hyphen apart?

    False for an address without them. The pattern is made of each row's digits.
    """
    number = F.split_part(F.coalesce(_column(email), F.lit("")), F.lit("@"), F.lit(1))
    digits = F.regexp_replace(F.regexp_replace(number, r"([0-9])", "$1[ -]?"), r"\[ -\]\?$", "")
    pattern = F.concat(F.lit(r"(?<!\d)"), digits, F.lit(r"(?!\d)"))
    return number.rlike("^[0-9]+$") & F.regexp_like(F.coalesce(_column(text), F.lit("")), F.when(number.rlike("^[0-9]+$"), pattern).otherwise("x"))


def first_held(text: str | Column, names: list[str]) -> Column:
    """The first of ``names`` that a text holds anywhere, in either case; null if none."""
    known = F.array(*[F.lit(n) for n in names])
    return let(F.lower(_column(text)), lambda lower: F.get(F.filter(known, lambda n: F.contains(lower, F.lower(n))), F.lit(0)))


def college_allowed(college: str | Column) -> Column:
    lower = F.lower(F.trim(_column(college)))
    return lower.isin(COLLEGES) | (F.contains(lower, F.lit("comput")) & F.contains(lower, F.lit("stud")))


def institution_told(text: str | Column) -> Column:
    """Does a text tell the institution, by one telling word or by two supporting ones?"""

    def told(lower: Column) -> Column:
        supporting = sum((F.contains(lower, F.lit(w)).cast("int") for w in SUPPORTING), F.lit(0))
        return lower.rlike("|".join(TELLING)) | (supporting >= 2)

    return let(F.lower(F.coalesce(_column(text), F.lit(""))), told)


def rule_failures(rows: DataFrame, negative: bool) -> DataFrame:
    """``rows`` (full_name, institution, college, program, text) with ``failures``: (field, kind, actual) in the order of the rules.

    ``kind`` is "invalid" or "missing"; an empty field is missing. With ``negative``
    names of other schools and programs anywhere in the text count first, and their
    field is not missing then. A college may be missing where the program is known.
    """
    rows = matched_institutions(rows.withColumn("program", normal_program("program")), "institution").withColumnRenamed("rule", "_rule")
    other_school = first_held("text", OTHER_INSTITUTIONS) if negative else F.lit(None).cast("string")
    other_program = first_held("text", OTHER_PROGRAMS) if negative else F.lit(None).cast("string")
    rows = rows.withColumns({"_school": other_school, "_other": other_program})
    known = F.coalesce(F.col("program").isin(PROGRAMS), F.lit(False))

    def given(field: str) -> Column:
        return F.coalesce(F.length(field) > 0, F.lit(False))

    def failure(field: str, kind: str, actual: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), actual.cast("string").alias("actual"))

    def invalid(field: str, actual: Column) -> Column:
        return failure(field, "invalid", actual)

    def missing(field: str) -> Column:
        return failure(field, "missing", F.lit(None))

    failures = [
        F.when(F.col("_school").isNotNull(), invalid("institution", F.col("_school"))),
        F.when(F.col("_other").isNotNull(), invalid("program", F.col("_other"))),
        F.when(~given("full_name"), missing("full_name")),
        F.when(~given("institution") & F.col("_school").isNull(), missing("institution")),
        F.when(~given("college") & ~known, missing("college")),
        F.when(~given("program") & F.col("_other").isNull(), missing("program")),
        F.when(given("institution") & F.col("_rule").isNull(), invalid("institution", F.col("institution"))),
        F.when(given("college") & ~college_allowed("college"), invalid("college", F.col("college"))),
        F.when(given("program") & ~known, invalid("program", F.col("program"))),
    ]
    return rows.withColumn("failures", F.array_compact(F.array(*failures))).drop("_rule", "_school", "_other")


def verified(rows: DataFrame, negative: bool = False) -> DataFrame:
    """``rows`` with ``failures``, ``status``, ``reason``, ``flags``, ``request_state`` and ``reported``.

    ``rows`` has full_name, institution, college, program, text and confidence of a
    scan (null: it failed), first_name, last_name and email of the applicant, and
    ``state`` of the request; these nine names and those that are added are taken. A
    request that is not "processing" has been dealt with: it keeps its state and gets
    no status, so a second run changes nothing. A rejection stays one; a name or a
    number that is not on the document sends any other to a person.
    """
    rows = rule_failures(rows, negative)
    broken, clear = F.size("failures") > 0, F.exists("failures", lambda f: f["kind"] == "invalid")
    told, c = institution_told("text"), F.col("confidence")
    reason = (
        F.when(c.isNull(), "scan_failed")
        .when(clear, "rule_validation_failed")
        .when(broken & ~told, "invalid_institution")
        .when(broken, "incomplete_extraction")
        .when(c >= HIGH, "high_confidence")
        .when(c >= MEDIUM, "ocr_medium_confidence")
        .otherwise("ocr_low_confidence")
    )
    rows = rows.withColumn("reason", reason)
    of_reason = {"scan_failed": "error", "rule_validation_failed": "rejected", "invalid_institution": "rejected", "high_confidence": "auto_approved"}
    status = _mapped(F.col("reason"), of_reason, F.lit("pending_manual_review"))
    said = F.transform(
        "failures",
        lambda f: F.when(f["kind"] == "missing", F.concat(F.lit("missing: "), f["field"])).otherwise(
            F.concat(F.lit("invalid "), f["field"], F.lit(": "), f["actual"])
        ),
    )
    own = F.array_compact(
        F.array(
            F.when(F.col("reason") == "invalid_institution", F.lit("no sign of the institution")),
            F.when(F.col("reason").isin("ocr_medium_confidence", "ocr_low_confidence"), F.format_string("confidence %.1f", c)),
        )
    )
    off = F.array_compact(
        F.array(
            F.when(~name_on_document("first_name", "last_name", "text"), F.lit("name_mismatch")),
            F.when(~number_on_document("email", "text"), F.lit("student_number_mismatch")),
        )
    )
    rows = rows.withColumns({"status": status, "flags": F.concat(said, own), "_off": off})
    demoted = ~F.col("status").isin("rejected", "error") & (F.size("_off") > 0)
    rows = rows.withColumns({
        "reason": F.when(demoted & (F.col("status") == "auto_approved"), F.get("_off", F.lit(0))).otherwise(F.col("reason")),
        "flags": F.when(F.col("status") == "error", F.array().cast("array<string>")).when(demoted, F.concat("flags", "_off")).otherwise(F.col("flags")),
        "status": F.when(demoted, "pending_manual_review").otherwise(F.col("status")),
    })
    open_ = F.coalesce(F.col("state") == "processing", F.lit(False))
    rows = rows.withColumns({x: F.when(open_, F.col(x)) for x in ("failures", "status", "reason", "flags")})
    # an approval is followed by a letter that waits for its answer
    after = F.when(F.col("status") == "auto_approved", "pending_email_verification").otherwise(_mapped(F.col("status"), REQUEST_STATES, F.lit("pending")))
    rows = rows.withColumn("request_state", F.when(open_, after).otherwise(F.col("state")))
    return rows.withColumn("reported", _mapped(F.col("request_state"), REPORTED, F.lit("processing"))).drop("_off")


def logged_events(rows: DataFrame, key: str) -> DataFrame:
    """(key, step, event_type, document, reason): what is logged of each row of :func:`verified` that got a status.

    A scan that failed starts and ends in an error; others start, are completed and
    decided. ``document`` is the digest of the text, ``reason`` stands with the end.
    """
    last = F.concat(F.lit(_EVENT), _mapped(F.col("status"), _EVENTS))
    started, completed = F.lit(_EVENT + "started"), F.lit(_EVENT + "completed")
    steps = F.when(F.col("status") == "error", F.array(started, last)).otherwise(F.array(started, completed, last))
    rows = rows.filter("status is not null").select(key, "reason", F.sha2(F.col("text"), 256).alias("document"), F.size(steps).alias("n"), F.posexplode(steps).alias("step", "event_type"))
    reason = F.when(F.col("step") == F.col("n") - 1, F.col("reason"))
    return rows.select(key, F.col("step").cast("long").alias("step"), "event_type", "document", reason.alias("reason"))
