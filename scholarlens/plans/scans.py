"""Scanned and stored documents: abstracts by page, words one edit apart, names, visual rows, and tables in versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.operators import abstracts as A
from scholarlens.operators.edits import one_edit_pairs, repaired_lines
from scholarlens.operators.identity import ALIASES, matched_institutions, normal_program
from scholarlens.operators.visual import NEAR, visual_rows
from scholarlens.plans.search import _CITED, citation_edges
from scholarlens.registry import query
from scholarlens.sources.folders import shared_folder, stored
from scholarlens.sources.versions import append_absent, read_version
from scholarlens.sources.views import read

#: Words of a line and lines of a page that texts are set in.
WORDS, LINES = 10, 18


def set_in_pages(docs: DataFrame) -> DataFrame:
    """(doc, page, pos, line): ``docs`` (doc_id, text, source) set in pages with a running head, a number, and an abstract in their third line.

    The abstract has 4 to 33 lines and ends with a full stop for even ids; after it come
    keywords, a section in capitals or not, a chapter, or nothing, by the id.
    """
    k, w = F.col("doc_id"), F.col("w")
    # the words go through a generator, so that no filter and no line computes them again
    words = F.array_remove(F.split("text", r"\s+"), "")
    rows = docs.select("doc_id", "source", F.explode(F.array(words)).alias("w")).filter(F.size("w") >= 5 * WORDS)
    last = F.floor((F.size(w) - 1) / WORDS).cast("int")
    lines = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * WORDS + 1, WORDS), " "))
    rows = rows.select("doc_id", "source", lines.alias("l"), (k * 7 % 30 + 4).cast("int").alias("m"))
    body = F.slice("l", 4, F.col("m"))
    stop = F.when(k % 2 == 0, F.lit(".")).otherwise(F.lit(""))
    body = F.transform(body, lambda x, i: F.when(i == F.size(body) - 1, F.concat(x, stop)).otherwise(x))
    closing = F.array(
        F.when(k % 5 == 0, "last words Keywords: one, two").when(k % 5 == 1, "INTRODUCTION").when(k % 5 == 2, "Chapter 1").when(k % 5 == 3, "methods").otherwise("")
    )
    whole = F.concat(F.slice("l", 1, 3), F.array(F.lit("Abstract")), body, closing, F.slice("l", F.col("m") + 4, 1 << 30))
    rows = rows.select("doc_id", "source", F.explode(F.array(whole)).alias("whole"))
    # pages with their head and foot, from the one array
    pages = F.sequence(F.lit(0), F.floor((F.size("whole") - 1) / LINES).cast("int"))
    rows = rows.select(F.col("doc_id").alias("doc"), "source", "whole", F.explode(pages).alias("page"))
    real = F.slice("whole", F.col("page") * LINES + 1, LINES)

    def placed(pos: Column | int, line: Column) -> Column:
        return F.struct((pos if isinstance(pos, Column) else F.lit(pos)).cast("long").alias("pos"), line.alias("line"))

    head, foot = placed(0, F.concat(F.lit("Works of "), "source")), placed(99, (F.col("page") + 1).cast("string"))
    every = F.concat(F.array(head), F.transform(real, lambda x, i: placed(i + 1, x)), F.array(foot))
    return rows.select("doc", F.col("page").cast("long").alias("page"), F.inline(every))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


_PAGES = rf"""w AS (SELECT doc_id, source, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, source, list_transform(range(0, (len(w) - 1) // {WORDS} + 1), lambda i: array_to_string(w[i * {WORDS} + 1:i * {WORDS} + {WORDS}], ' ')) AS l, doc_id * 7 % 30 + 4 AS m FROM w WHERE len(w) >= {5 * WORDS}),
b AS (SELECT *, l[4:m + 3] AS body FROM l),
whole AS (SELECT doc_id, source, list_concat(l[1:3], ['Abstract'], list_transform(body, lambda x, i: CASE WHEN i = len(body) AND doc_id % 2 = 0 THEN x || '.' ELSE x END),
  [CASE doc_id % 5 WHEN 0 THEN 'last words Keywords: one, two' WHEN 1 THEN 'INTRODUCTION' WHEN 2 THEN 'Chapter 1' WHEN 3 THEN 'methods' ELSE '' END], l[m + 4:]) AS x FROM b),
flat AS (SELECT doc_id AS doc, source, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i FROM whole),
placed AS (SELECT doc, source, i // {LINES} AS page, i % {LINES} + 1 AS pos, line FROM flat),
lines AS (SELECT doc, page, pos, line FROM placed UNION ALL SELECT DISTINCT doc, page, 0, 'Works of ' || source FROM placed UNION ALL SELECT DISTINCT doc, page, 99, CAST(page + 1 AS VARCHAR) FROM placed)"""


@query(
    "recovered_abstracts",
    rf"""WITH {_PAGES}, sq AS (SELECT doc, page, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM lines WHERE page < {A.PAGES}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS top, row_number() OVER (PARTITION BY doc, page ORDER BY pos DESC) AS foot FROM sq WHERE line <> ''),
    margins AS (SELECT DISTINCT doc, page, line FROM ranked WHERE top <= {A.MARGIN} OR foot <= {A.MARGIN}),
    gone AS (SELECT m.* FROM margins m JOIN (SELECT doc, line FROM margins GROUP BY doc, line HAVING count(*) > 1) r ON r.doc = m.doc AND r.line = m.line),
    clean AS (SELECT s.* FROM sq s LEFT JOIN gone g ON g.doc = s.doc AND g.page = s.page AND g.line = s.line
      WHERE s.line = '' OR NOT (regexp_matches(s.line, '{_re2(A.NUMBER)}') OR regexp_matches(s.line, '{_re2(A.INSTITUTION)}') OR (g.doc IS NOT NULL AND NOT (length(s.line) >= {A.MARGIN_LENGTH}
        OR regexp_matches(s.line, '{_re2(A.HEADING)}') OR regexp_matches(s.line, '{_re2(A.STOP)}') OR regexp_matches(s.line, '[.!?]$'))))),
    heads AS (SELECT doc, page AS p0, pos AS at0, regexp_extract(line, '{_re2(A.HEADING)}', 1) AS rest FROM clean WHERE regexp_matches(line, '{_re2(A.HEADING)}')
      AND (doc, page) NOT IN (SELECT doc, page FROM clean WHERE regexp_matches(line, '{_re2(A.CONTENTS)}'))),
    aft AS (SELECT h.*, c.page, c.pos, c.line, coalesce(lag(c.line) OVER (PARTITION BY h.doc, h.p0, h.at0 ORDER BY c.page, c.pos), h.rest) AS prior
      FROM heads h JOIN clean c ON c.doc = h.doc AND ((c.page = h.p0 AND c.pos > h.at0) OR c.page = h.p0 + 1) WHERE c.line <> ''),
    typed AS (SELECT *, CASE WHEN regexp_matches(line, '{_re2(A.KEYWORDS)}') THEN 'keywords'
      WHEN regexp_matches(line, '{_re2(A.STOP)}') OR (regexp_matches(line, '{_re2(A.SECTION)}') AND (regexp_matches(line, '^[\p{{Lu}}\p{{Nd}}]') OR regexp_matches(prior, '[.!?]$'))) THEN 'end'
      WHEN regexp_matches(line, '{_re2(A.HEADING)}') OR regexp_matches(line, '\.{{3}}|-{{3}}|,{{3}}|!{{3}}|\?{{3}}|={{3}}|\*{{3}}|…{{3}}|·{{3}}|#{{3}}|/{{3}}')
        OR (upper(line) = line AND lower(line) <> line AND contains(line, ' ')) THEN 'unsure' END AS kind FROM aft),
    ends AS (SELECT doc, p0, at0, min((page, pos)) AS place, arg_min(kind, (page, pos)) AS kind, arg_min(line, (page, pos)) AS line FROM typed WHERE kind IS NOT NULL GROUP BY doc, p0, at0),
    bodies AS (SELECT e.doc, e.p0, e.at0, list(t.line ORDER BY t.page, t.pos) FILTER (t.line IS NOT NULL) AS mid, any_value(e.kind) AS kind, any_value(e.line) AS line
      FROM ends e LEFT JOIN typed t ON t.doc = e.doc AND t.p0 = e.p0 AND t.at0 = e.at0 AND (t.page, t.pos) < e.place WHERE e.kind <> 'unsure' GROUP BY e.doc, e.p0, e.at0),
    parts AS (SELECT b.doc, b.p0, b.at0, length(h.rest) + coalesce(list_sum(list_transform(mid, lambda x: length(x))), 0) AS size, list_filter(list_concat([h.rest], coalesce(mid, []),
      [CASE WHEN kind = 'keywords' THEN trim(regexp_extract(line, '^(.*?){_re2(A.KEYWORDS).replace("(?i)", "")}', 1, 'i')) ELSE '' END]), lambda x: x <> '') AS p FROM bodies b JOIN heads h ON h.doc = b.doc AND h.p0 = b.p0 AND h.at0 = b.at0),
    texts AS (SELECT *, trim(regexp_replace(regexp_replace(array_to_string(p, chr(10)), '-\n(\p{{Ll}})', '\1', 'g'), '\s+', ' ', 'g')) AS abstract FROM parts WHERE size <= {A.MOST_CHARS} AND len(p) > 0),
    judged AS (SELECT *, string_split(abstract, ' ') AS ws FROM texts),
    good AS (SELECT * FROM judged WHERE length(abstract) <= {A.MOST_CHARS} AND len(ws) >= {A.FEWEST_WORDS} AND length(regexp_replace(abstract, '[^\p{{L}}]', '', 'g')) >= {A.LETTERS} * length(abstract)
      AND regexp_matches(abstract, '{_re2(A.FINISHED)}') AND len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{L}}$'))) <= {A.SINGLE} * len(ws) AND NOT contains(abstract, '�'))
    SELECT doc, CAST(arg_min(p0, (p0, at0)) AS BIGINT) AS page, arg_min(abstract, (p0, at0)) AS abstract,
      arg_min(CASE WHEN len(list_filter(p, lambda x: len(string_split(x, ' ')) <= 2)) * 3 > len(p) OR len(ws) < {A.SHORT} THEN 'medium' ELSE 'high' END, (p0, at0)) AS confidence FROM good GROUP BY doc""",
)
def recovered_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The abstract of each document set in pages, where one can be told for sure."""
    return A.recovered(set_in_pages(read(spark, sf_dir, "documents"))).select("doc", F.col("page").cast("long").alias("page"), "abstract", "confidence")


#: Documents that a word of the vocabulary must stand in.
COMMON = 20


@query(
    "near_words",
    rf"""WITH words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS word FROM documents),
    vocabulary AS (SELECT word FROM words GROUP BY word HAVING count(*) >= {COMMON})
    SELECT a.word AS a, b.word AS b FROM vocabulary a JOIN vocabulary b ON a.word < b.word AND abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) = 1""",
)
def near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of common runs of four ASCII letters or more that are one edit apart."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("word"))
    return one_edit_pairs(words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON))


@query(
    "repaired_names",
    r"""WITH w AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) >= 4)[1:4] AS w FROM documents),
    f AS (SELECT * FROM w WHERE len(w) = 4),
    made AS (SELECT doc, w, doc % 6 AS kind, w[1] || ' ' || w[2] || ' J. ' || w[3] AS told,
      CASE doc % 6 WHEN 0 THEN substr(w[1], 1, 1) || 'zz' || substr(w[1], 4) WHEN 1 THEN substr(w[1], 1, 2) || '1' || substr(w[1], 4) WHEN 2 THEN w[1] || 'q' WHEN 3 THEN substr(w[1], 2) ELSE w[1] END AS spoilt FROM f)
    SELECT doc, CASE WHEN kind = 4 THEN 'ABSTRACT ' ELSE '' END || spoilt || ' ' || w[2] || CASE WHEN kind = 5 THEN ' ' ELSE ' J. ' END || w[3] AS text,
      CASE WHEN kind IN (0, 2, 3) AND levenshtein(lower(spoilt), lower(w[1])) = 1 THEN told ELSE CASE WHEN kind = 4 THEN 'ABSTRACT ' ELSE '' END || spoilt || ' ' || w[2] || CASE WHEN kind = 5 THEN ' ' ELSE ' J. ' END || w[3] END AS repaired FROM made""",
)
def repaired_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of names made of each document's words, of which the first is spoilt by a rule, and what a second reading makes of them.

    One letter more, less or other is set right; two other letters, a digit within a word (which
    makes two words of it), a line of an abstract and one without an initial are not.
    """
    k = F.col("doc")
    # runs of four letters or more; four words of each text are read by many branches, the texts once
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), 1, 4)
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array(words)).alias("w"))
    rows = stored(rows.filter(F.size("w") == 4), "name-words")
    a, b, c = (F.get("w", F.lit(i)) for i in range(3))
    spoilt = (
        F.when(k % 6 == 0, F.concat(F.substring(a, 1, 1), F.lit("zz"), F.substring(a, 4, 99999)))
        .when(k % 6 == 1, F.concat(F.substring(a, 1, 2), F.lit("1"), F.substring(a, 4, 99999)))
        .when(k % 6 == 2, F.concat(a, F.lit("q")))
        .when(k % 6 == 3, F.substring(a, 2, 99999))
        .otherwise(a)
    )
    line = F.concat(F.when(k % 6 == 4, "ABSTRACT ").otherwise(""), spoilt, F.lit(" "), b, F.when(k % 6 == 5, " ").otherwise(" J. "), c)
    lines = rows.select("doc", F.lit(0).alias("line"), line.alias("text"))
    readings = rows.select("doc", F.concat(F.lit("by "), a, F.lit(" "), b, F.lit(" J. "), c, F.lit(" and others ABSTRACT "), spoilt, F.lit("x "), b, F.lit(" J. "), c).alias("text"))
    return repaired_lines(lines, readings).select("doc", "text", "repaired")


_CLEAN = r"trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}_\s-]', '', 'g'), '\s+', ' ', 'g'))"
_PROGRAMS = ["BS. Information  Systems!", "bsit", "The B.S. in Computer Science (main)", "comp", "Nursing", "", "BS-CS", "Associate, Computer Technology"]


@query(
    "program_names",
    f"""WITH given AS (SELECT c_custkey AS id, CASE c_custkey % 9 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_PROGRAMS))} ELSE c_mktsegment END AS name FROM customer),
    c AS (SELECT *, {_CLEAN} AS c FROM given)
    SELECT id, name, CASE WHEN name <> '' THEN coalesce(CASE c {" ".join(f"WHEN '{a}' THEN '{p}'" for a, p in ALIASES)} END,
      CASE {" ".join(f"WHEN contains(c, '{a}') OR contains('{a}', c) THEN '{p}'" for a, p in ALIASES)} END, name) END AS program FROM c""",
)
def program_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program that each customer's name for it means; the names are given by the number."""
    k = F.col("c_custkey")
    name = F.coalesce(*[F.when(k % 9 == i, F.lit(v)) for i, v in enumerate(_PROGRAMS)], F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name")).select("id", "name", normal_program("name").alias("program"))


#: What scans make of an institution's name, and the rule that tells it.
_SCHOOLS = [
    ("pampanga state UNIVERSITY ", "exact"), ("State College of Pampanga", "words"), ("Don Honorio Ventur", "words"), ("DHVSU - main campus", "abbreviation"),
    ("Ventur Hs Tate University", "likeness"), ("State University Don", "likeness"), ("Holy Angel University", None), ("University of the East", None),
]


@query(
    "institution_names",
    "WITH t(k, name, rule) AS (VALUES "
    + ", ".join(f"({k}, '{n}', {'NULL' if r is None else chr(39) + r + chr(39)})" for k, (n, r) in enumerate(_SCHOOLS))
    + """), given AS (SELECT s_suppkey AS id, s_suppkey % 9 AS k, s_name FROM supplier)
    SELECT g.id, coalesce(t.name, g.s_name) AS name, t.rule FROM given g LEFT JOIN t ON t.k = g.k""",
)
def institution_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers' names are the institution's, and by which rule; eight of nine are given by the number."""
    k = F.col("s_suppkey")
    name = F.coalesce(*[F.when(k % 9 == i, F.lit(n)) for i, (n, _) in enumerate(_SCHOOLS)], F.col("s_name"))
    return matched_institutions(read(spark, sf_dir, "supplier").select(k.alias("id"), name.alias("name")), "name").select("id", "name", "rule")


_PIECES = r"""pieces AS (SELECT doc_id AS page, i AS piece, length(w[i]) * CAST(1.7 AS DOUBLE) + (i % 4) * CAST(11 AS DOUBLE) AS y, CAST((i * 37) % 101 AS DOUBLE) AS x, w[i] AS word FROM
  (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda z: z <> '')[1:60] AS w FROM documents)))"""


@query(
    "visual_rows",
    rf"""WITH RECURSIVE {_PIECES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, piece) AS rn FROM pieces),
    a AS (SELECT page, rn, x, y, piece, word, y AS anchor FROM o WHERE rn = 1 UNION ALL
      SELECT o.page, o.rn, o.x, o.y, o.piece, o.word, CASE WHEN o.y - a.anchor > CAST({NEAR} AS DOUBLE) THEN o.y ELSE a.anchor END FROM a JOIN o ON o.page = a.page AND o.rn = a.rn + 1)
    SELECT page, row_number() OVER (PARTITION BY page ORDER BY anchor DESC) AS "row", anchor, string_agg(word, ' ' ORDER BY x, word) AS text FROM a GROUP BY page, anchor""",
)
def visual_rows_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty words of each text as pieces of a page, whose heights come from their lengths, put together to rows."""
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda z: z != ""), 1, 60)
    flat = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(words).alias("p", "text")).withColumn("piece", F.col("p") + 1)
    y = F.length("text") * F.lit(1.7) + (F.col("piece") % 4) * F.lit(11.0)
    pieces = flat.select("page", "piece", (F.col("piece") * 37 % 101).alias("x"), y.alias("y"), "text")
    return visual_rows(pieces)


@query(
    "file_digests",
    """WITH f AS (SELECT page_id AS id, sha256(html) AS actual, CASE WHEN page_id % 7 = 0 THEN sha256(html || ' ') WHEN page_id % 6 <> 1 THEN sha256(html) END AS stored,
      CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 11 = 0 THEN sha256('x') ELSE sha256(html) END END AS listed FROM pages)
    SELECT id, actual, CASE WHEN listed IS NULL THEN 'not listed' WHEN listed <> actual THEN 'file differs from list' WHEN stored IS NULL THEN 'not stored'
      WHEN stored <> actual THEN 'file differs from store' ELSE 'same' END AS state FROM f""",
)
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored file's digest against the one kept with its row and the one of the manifest; both of these are made by rules on the id."""
    k = F.col("page_id")
    files = read(spark, sf_dir, "pages").select(k.alias("id"), "html")
    actual = files.select("id", F.sha2("html", 256).alias("actual"))
    kept = F.when(F.col("id") % 7 == 0, F.sha2(F.concat("html", F.lit(" ")), 256)).otherwise(F.sha2("html", 256))
    kept = files.filter((F.col("id") % 7 == 0) | (F.col("id") % 6 != 1)).select("id", kept.alias("stored"))
    listed = files.filter(F.col("id") % 5 != 0).select("id", F.when(F.col("id") % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("html", 256)).alias("listed"))
    rows = actual.join(kept, "id", "left").join(listed, "id", "left")
    state = (
        F.when(F.col("listed").isNull(), "not listed")
        .when(F.col("listed") != F.col("actual"), "file differs from list")
        .when(F.col("stored").isNull(), "not stored")
        .when(F.col("stored") != F.col("actual"), "file differs from store")
        .otherwise("same")
    )
    return rows.select("id", "actual", state.alias("state"))


EDGES = "citing long, cited long, batch long"


@query(
    "citation_versions",
    f"WITH {_CITED} SELECT citing, cited, CASE WHEN citing % 2 = 0 THEN 1 ELSE 2 END AS batch FROM edges",
)
def citation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of citations after two runs that each found them: of even works, then of all; a citation keeps the run that found it."""
    folder = f"{shared_folder(spark)}/citations-{uuid.uuid4().hex}"
    edges = citation_edges(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    append_absent(edges.filter("citing % 2 = 0").withColumn("batch", F.lit(1).cast("long")), folder, EDGES, ["citing", "cited"])
    append_absent(edges.withColumn("batch", F.lit(2).cast("long")), folder, EDGES, ["citing", "cited"])
    return read_version(spark, folder, EDGES)
