"""Extraction queries. The texts are invented, so manuscripts are set from them and their fields found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.functions import manuscripts as m
from scholarlens.functions.text import squeezed
from scholarlens.operators.author_lines import detected_authors
from scholarlens.operators.keyword_lines import detected_keywords
from scholarlens.registry import query
from scholarlens.sources.views import KEYWORDS_SQL, WORKS_SQL, keywords_of, read, title_of, works

MONTHS = ["January", "March", "June", "October"]


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, manuscript): title page, abstract, keywords and a first chapter around the text of each work."""
    month = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), (F.col("id") % 4 + 1).cast("int"))
    parts = [
        F.col("title"), F.lit(""), F.lit("A thesis presented to the faculty"), F.lit(""), F.lit("by"), F.concat(F.lit("Author of "), "program"), F.lit(""),
        F.concat_ws(" ", month, F.col("year").cast("string")), F.lit(""), F.lit("ABSTRACT"), squeezed("abstract"), F.lit(""),
        F.concat(F.lit("Keywords: "), F.array_join("keywords", "; ")), F.lit(""), F.lit("CHAPTER 1"), F.lit("INTRODUCTION"),
    ]
    return works(spark, sf_dir).select("id", F.concat_ws("\n", *parts).alias("manuscript"))


@query(
    "manuscript_fields",
    rf"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, w AS (SELECT w.id, w.title, w.program, w.year, k.keywords,
      trim(regexp_replace(w.abstract, '\s+', ' ', 'g')) AS body FROM works w JOIN keyworded k ON k.id = w.id),
    good AS (SELECT *, length(body) BETWEEN 20 AND 6000 AND len(string_split(body, ' ')) >= 20
      AND length(regexp_replace(body, '[^\p{{L}}]', '', 'g')) / greatest(length(body), 1) >= 0.6 AS ok FROM w)
    SELECT id, CASE WHEN ok THEN sha256(body) END AS abstract_digest, CASE WHEN ok THEN CASE WHEN length(body) >= 200 THEN 'high' ELSE 'medium' END END AS abstract_confidence,
      nullif(array_to_string(keywords, '; '), '') AS keywords, CASE WHEN len(keywords) >= 3 THEN 'high' WHEN len(keywords) > 0 THEN 'medium' END AS keywords_confidence,
      CAST(year AS VARCHAR) AS year, title, 'Author of ' || program AS authors FROM good""",
)
def manuscript_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstract, keywords, year, title and authors found again in each manuscript, with confidence."""
    text = "manuscript"
    found = manuscripts(spark, sf_dir).select(
        "id", m.abstract_of(text).alias("a"), m.keywords_of(text).alias("k"), m.year_of(text, 2025).alias("y"), m.title_of(text).alias("t"), m.authors_of(text).alias("n")
    )
    return found.select(
        "id",
        F.sha2("a.value", 256).alias("abstract_digest"),
        F.col("a.confidence").alias("abstract_confidence"),
        F.col("k.value").alias("keywords"),
        F.col("k.confidence").alias("keywords_confidence"),
        F.col("y.value").alias("year"),
        F.col("t.value").alias("title"),
        F.col("n.value").alias("authors"),
    )


@query(
    "manuscript_gate",
    """WITH g AS (SELECT doc_id, length(trim(text)) < 200 AS short FROM documents)
    SELECT 'text' AS kind, CASE WHEN short THEN 'unreadable' ELSE 'not_a_thesis' END AS outcome, count(*) AS n FROM g GROUP BY ALL
    UNION ALL SELECT 'manuscript', 'pass', count(*) FROM documents WHERE length(text) >= 200""",
)
def manuscript_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the thesis gate for plain texts and for the manuscripts of the longer ones."""
    plain = read(spark, sf_dir, "documents").select(F.lit("text").alias("kind"), m.gate("text").alias("outcome"))
    long = works(spark, sf_dir).filter(F.length("abstract") >= 200).select("id")
    made = manuscripts(spark, sf_dir).join(long, "id").select(F.lit("manuscript").alias("kind"), m.gate("manuscript").alias("outcome"))
    return plain.unionByName(made).groupBy("kind", "outcome").agg(F.count("*").alias("n"))


@query(
    "keyword_blocks",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, k AS (SELECT id, keywords AS k, id % 8 AS layout FROM keyworded WHERE len(keywords) = 5)
    SELECT id, CASE layout WHEN 0 THEN array_to_string(k, '; ') WHEN 3 THEN '' WHEN 1 THEN array_to_string(k[1:2], '; ') WHEN 5 THEN array_to_string(k[1:2], '; ') ELSE array_to_string(k[1:3], '; ') END AS keywords,
      CASE WHEN layout = 3 THEN 'low' WHEN layout IN (1, 2, 5) THEN 'medium' ELSE 'high' END AS confidence FROM k""",
)
def keyword_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each work set in eight layouts by its number, and found by their lines.

    Wrapped, under the label, cut off, no label at all, before an author, with an item
    twice, with an open end, and before prose.
    """
    k, layout = F.col("keywords"), F.col("id") % 8
    some = [F.get(k, F.lit(i)) for i in range(5)]
    given = [
        F.concat(F.lit("Keywords: "), F.array_join(F.slice(k, 1, 3), ", "), F.lit(",\n"), F.array_join(F.slice(k, 4, 2), ", ")),
        F.concat(F.lit("KEYWORDS\n\n"), F.array_join(F.slice(k, 1, 2), "; "), F.lit("\n\nINTRODUCTION")),
        F.concat(F.lit("Keywords: "), F.array_join(F.slice(k, 1, 3), ", "), F.lit(",")),
        F.concat(F.lit("keywords, "), some[0], F.lit(" and others")),
        F.concat(F.lit("Keywords: "), F.array_join(F.slice(k, 1, 3), ", "), F.lit("\nSantos, Juan P.")),
        F.concat(F.lit("Index Terms — "), F.concat_ws(" | ", some[0], some[1], some[0])),
        F.concat(F.lit("Keywords: "), F.array_join(F.slice(k, 1, 2), ", "), F.lit(",\n"), some[2]),
        F.concat(F.lit("Keywords: "), F.array_join(F.slice(k, 1, 3), ", "), F.lit("\nThe study was done in town.")),
    ]
    text = F.concat(F.lit("ABSTRACT\nof it.\n"), F.coalesce(*[F.when(layout == i, x) for i, x in enumerate(given)]), F.lit("\n\nCHAPTER 1"))
    made = works(spark, sf_dir).select("id", "keywords").filter(F.size(k) == 5).select("id", text.alias("manuscript"))
    found = detected_keywords(made, "manuscript")
    return found.select("id", F.array_join("found_keywords", "; ").alias("keywords"), F.col("keywords_confidence").alias("confidence"))


@query(
    "author_blocks",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, k AS (SELECT id, id % 4 AS layout, upper(keywords[1][1]) || keywords[1][2:] AS a, upper(keywords[2][1]) || keywords[2][2:] AS b FROM keyworded
      WHERE len(keywords) = 5 AND regexp_matches(keywords[1] || keywords[2], '^[a-z]+$'))
    SELECT id, CASE layout WHEN 0 THEN a || ' B. ' || b || '; ' || b || ' ' || a WHEN 1 THEN a || ' ' || b || '; ' || b || ' C. ' || a WHEN 2 THEN a || ', ' || b || ' P.; ' || b || ', ' || a ELSE '' END AS authors FROM k""",
)
def author_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of each work set on a title page in four ways by its number: under "by", beside it, in one line by surnames, and in prose, which names nobody."""
    k = F.col("keywords")
    # the keywords go through a generator, so that no filter computes them again
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.explode(F.array(keywords_of("text"))).alias("keywords"))
    rows = rows.filter(F.size(k) == 5).select("id", title_of("text").alias("title"), F.get(k, F.lit(0)).alias("x"), F.get(k, F.lit(1)).alias("y"))
    rows = rows.filter(F.concat("x", "y").rlike("^[a-z]+$"))

    def capital(word: str):
        return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 99999))

    rows = rows.select("id", "title", capital("x").alias("a"), capital("y").alias("b"))
    a, b = F.col("a"), F.col("b")
    given = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("by\n\n"), a, F.lit(" B. "), b, F.lit(" one@two.edu\n"), b, F.lit(" "), a, F.lit("\n\n\n\nThe rest")))
        .when(F.col("id") % 4 == 1, F.concat(F.lit("Submitted by: "), a, F.lit(" "), b, F.lit("\n"), b, F.lit(" C. "), a, F.lit("\nINTRODUCTION")))
        .when(F.col("id") % 4 == 2, F.concat(F.lit("Researchers: "), a, F.lit(", "), b, F.lit(" P. "), b, F.lit(", "), a))
        .otherwise(F.concat(F.lit("Researchers used the old way.\n"), a, F.lit(" B. "), b))
    )
    made = rows.select("id", "title", F.concat("title", F.lit("\n"), given).alias("page"))
    found = detected_authors(made, "page", "title").select("id", F.array_join("found_authors", "; ").alias("authors"))
    # a work is a row of documents and labels; the names go through that join, not the texts
    return found.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left")


PROGRAMS = {"AUTOMOBILE": "bscs", "BUILDING": "bsit", "FURNITURE": "bsis"}


@query(
    "identity_decision",
    """WITH c AS (SELECT c_custkey AS id, (c_acctbal + 1000) / 110.0 AS confidence, c_mktsegment AS segment,
      list_filter([CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'program not allowed' END,
        CASE WHEN c_nationkey % 7 = 0 THEN 'institution missing' END, CASE WHEN c_custkey % 11 = 0 THEN 'name mismatch' END], lambda x: x IS NOT NULL) AS failures FROM customer)
    SELECT id, CASE WHEN list_contains(failures, 'program not allowed') THEN 'rejected'
      WHEN list_contains(failures, 'institution missing') THEN 'rejected' WHEN list_contains(failures, 'name mismatch') THEN 'manual'
      WHEN confidence >= 75 THEN 'approved' ELSE 'manual' END AS decision,
      CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END AS band, array_to_string(failures, ', ') AS failures FROM c""",
)
def identity_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on each applicant: clear faults reject, a mismatch or a poor scan goes to a person, the rest passes."""
    people = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), ((F.col("c_acctbal") + 1000) / 110.0).alias("confidence"), "c_mktsegment", "c_nationkey"
    )
    failures = F.array_compact(
        F.array(
            F.when(~F.col("c_mktsegment").isin(*PROGRAMS), F.lit("program not allowed")),
            F.when(F.col("c_nationkey") % 7 == 0, F.lit("institution missing")),
            F.when(F.col("id") % 11 == 0, F.lit("name mismatch")),
        )
    )
    clear = F.exists(failures, lambda f: f.contains("not allowed")) | F.array_contains(failures, "institution missing")
    decision = F.when(clear, "rejected").when(F.array_contains(failures, "name mismatch"), "manual").when(F.col("confidence") >= 75, "approved").otherwise("manual")
    band = F.when(F.col("confidence") >= 75, "high").when(F.col("confidence") >= 60, "medium").otherwise("low")
    return people.select("id", decision.alias("decision"), band.alias("band"), F.array_join(failures, ", ").alias("failures"))
