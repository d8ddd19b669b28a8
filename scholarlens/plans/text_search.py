"""Search by text: queries are encoded with their glossary spellings, titles meet rules, and stored vectors count while they are fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlens.functions.glossary import TERMS, expansions, term_mentions, whole_term
from scholarlens.functions.text import normal_title
from scholarlens.operators.encoder import DIM, MODEL, best_score, composed, encode, encoded, source_hash, with_vectors
from scholarlens.operators.title_match import title_hits
from scholarlens.operators.vectors import band, dot
from scholarlens.registry import query
from scholarlens.sources.views import KEYWORDS_SQL, WORKS_SQL, read, subjects, works

FLOOR, MEANINGFUL, PAGE = 0.1, 0.35, 20
#: A reader, and what is asked for: every branch of the title rules has a text, "" lists nothing.
READER = "src3"
ASKED = [(0, ""), (1, "iot"), (2, "Internet  of Things"), (3, "src7 en"), (4, "OCR based tion"), (5, "tion."), (6, "UI"), (7, "is"), (8, "IoT-based")]
CANDIDATE = "  A User Interface for the tion and thand of IoT  "

#: The texts are invented words, so titles get glossary forms by the id's remainder, as SQL and as columns.
_FORMS = {0: " IoT-based", 1: ": Internet of Things", 2: " - OCR", 3: ", User Interfaces"}
_TITLED = "title || CASE id % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _FORMS.items()) + " ELSE '' END"

_DIGIT = "(instr('0123456789abcdef', substr(h, {k}, 1)) - 1)"


def _encoded_sql(name: str, source: str, text: str) -> str:
    """CTEs that leave the unit vector of each (id, ``text``) of ``source`` as rows (id, k, x) in ``name``."""
    place = f"({_DIGIT.format(k=1)} * 256 + {_DIGIT.format(k=2)} * 16 + {_DIGIT.format(k=3)}) % {DIM}"
    return rf"""{name}_h AS (SELECT id, md5(unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'))) AS h FROM {source}),
    {name}_s AS (SELECT id, {place} AS k, sum(CASE WHEN substr(h, 4, 1) < '8' THEN 1 ELSE -1 END) AS x FROM {name}_h GROUP BY ALL),
    {name} AS (SELECT s.id, s.k, s.x / l.l AS x FROM {name}_s s JOIN (SELECT id, sqrt(sum(x * x)) AS l FROM {name}_s GROUP BY id) l ON l.id = s.id WHERE l.l > 0)"""


_STORED = "stored AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose titles name a glossary term, in one of four forms, for two thirds of the ids."""
    rest = F.col("id") % 6
    ending = F.coalesce(*[F.when(rest == k, F.lit(v)) for k, v in _FORMS.items()], F.lit(""))
    return works(spark, sf_dir).withColumn("title", F.concat("title", ending))


@query(
    "title_rank",
    f"""WITH {WORKS_SQL}, t AS (SELECT id, {_TITLED} AS title FROM works WHERE status = 'approved'),
    fresh AS (SELECT t.id FROM t JOIN embeddings e ON e.vec_id = t.id WHERE t.id % 3 <> 0), {_STORED},
    stale AS (SELECT * FROM t WHERE id NOT IN (SELECT id FROM fresh)), {_encoded_sql("made", "stale", "title")},
    asked AS (SELECT 0 AS id, '{CANDIDATE}' AS title), {_encoded_sql("q", "asked", "title")},
    vectors AS (SELECT s.id, s.k, s.x FROM stored s JOIN fresh f ON f.id = s.id UNION ALL SELECT id, k, x FROM made),
    scored AS (SELECT t.id, greatest(-1, least(1, coalesce(sum(v.x * q.x), 0))) AS s, bool_or(f.id IS NULL) AS encoded
      FROM t LEFT JOIN vectors v ON v.id = t.id LEFT JOIN q ON q.k = v.k LEFT JOIN fresh f ON f.id = t.id GROUP BY t.id)
    SELECT id, round(s, 4) AS score, CASE WHEN encoded THEN 'encoded' ELSE 'stored' END AS origin,
      CASE WHEN round(s, 4) >= 0.85 THEN 'HIGH' WHEN round(s, 4) >= 0.6 THEN 'MODERATE' ELSE 'LOW' END AS band
    FROM scored WHERE round(s, 4) >= {MEANINGFUL}""",
)
def title_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles near enough to a proposed one; a stored title vector counts only for the title and model that it was made from.

    Stored vectors are those of ``embeddings``; the hash kept with every third is that
    of another title, as after a change of the title, so these and works without a
    vector are encoded.
    """
    candidate = CANDIDATE.strip()
    rows = titled(spark, sf_dir).filter("status = 'approved'").select("id", "title")
    kept = subjects(spark, sf_dir).select("id", F.col("vector").alias("stored"))
    rows = rows.join(kept, "id", "left").withColumn("hash", source_hash(F.when(F.col("id") % 3 == 0, F.concat(F.lit("old "), "title")).otherwise(F.col("title"))))
    found = with_vectors(rows, F.col("title"), F.col("stored"), F.col("hash") == source_hash("title"))
    q = F.array(*[F.lit(x) for x in encoded(candidate)])
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("vector", q))), 4)
    scored = found.select("id", score.alias("score"), "origin").filter(F.col("score") >= MEANINGFUL)
    return scored.select("id", "score", "origin", band("score").alias("band"))


@query(
    "stale_vectors",
    f"""WITH {WORKS_SQL}, t AS (SELECT w.id, {_TITLED} AS title, e.vec_id FROM works w LEFT JOIN embeddings e ON e.vec_id = w.id)
    SELECT id, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'stale' END AS reason, sha256('{MODEL}' || chr(0) || title) AS source_hash FROM t
    WHERE vec_id IS NULL OR id % 3 = 0""",
)
def stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose title vector must be made anew, why, and the hash that the new one will carry."""
    kept = subjects(spark, sf_dir).select("id", F.lit(True).alias("has"))
    rows = titled(spark, sf_dir).select("id", "title").join(kept, "id", "left")
    held = source_hash(F.when(F.col("id") % 3 == 0, F.concat(F.lit("old "), "title")).otherwise(F.col("title")))
    reason = F.when(F.col("has").isNull(), "missing").when(held != source_hash("title"), "stale")
    return rows.select("id", reason.alias("reason"), source_hash("title").alias("source_hash")).filter("reason is not null")


def query_vectors(queries: DataFrame) -> DataFrame:
    """(query_id, variants): the vectors of each query's spellings, none for blank queries."""
    spelt = queries.select("query_id", F.explode(expansions("query", TERMS)).alias("text"))
    made = spelt.select("query_id", encode("text").alias("vector"))
    return made.groupBy("query_id").agg(F.collect_list("vector").alias("variants"))


_SPELT = """spelt(id, query_id, text) AS (VALUES (1, 1, 'iot'), (2, 1, 'internet of things'), (3, 2, 'Internet  of Things'), (4, 2, 'iot'), (5, 3, 'src7 en'),
  (6, 4, 'OCR based tion'), (7, 4, 'optical character recognition based tion'), (8, 5, 'tion.'), (9, 6, 'UI'), (10, 6, 'user interface'), (11, 7, 'is'),
  (12, 8, 'IoT-based'), (13, 8, 'internet of things based'))"""
_COMPOSED = "title || chr(10) || chr(10) || array_to_string(keywords, ' ') || chr(10) || chr(10) || abstract"
_TEXT_VECTORS = f"""{KEYWORDS_SQL}, t AS (SELECT w.id, w.abstract, w.program, w.uploader, w.status, w.year, {_TITLED.replace('title', 'w.title').replace(' id ', ' w.id ')} AS title, k.keywords
      FROM works w JOIN keyworded k ON k.id = w.id), {_STORED},
    bare AS (SELECT id, {_COMPOSED} AS text FROM t WHERE id NOT IN (SELECT vec_id FROM embeddings)), {_encoded_sql("made", "bare", "text")},
    vectors AS (SELECT id, k, x FROM stored UNION ALL SELECT id, k, x FROM made),
    {_SPELT}, {_encoded_sql("q", "spelt", "text")},
    products AS (SELECT v.id, q.id AS spelling, sum(v.x * q.x) AS s FROM vectors v JOIN q ON q.k = v.k GROUP BY ALL),
    scored AS (SELECT t.id, s.query_id, round(greatest(-1, least(1, max(coalesce(p.s, 0)))), 4) AS score
      FROM t CROSS JOIN spelt s LEFT JOIN products p ON p.id = t.id AND p.spelling = s.id GROUP BY t.id, s.query_id)"""


def _scored(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``rows`` with keywords and stored (a vector or null), for each query: query_id and score."""
    text = composed("title", "keywords", "abstract")
    found = with_vectors(rows, text, F.col("stored")).drop("stored")
    # the queries asked for are a stated set of a few texts
    both = found.crossJoin(F.broadcast(query_vectors(queries)))
    return both.withColumn("score", F.round(best_score("vector", "variants"), 4)).drop("vector", "variants", "origin")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(spark, sf_dir).select("id", F.col("vector").alias("stored"))


@query(
    "text_search",
    f"""WITH {WORKS_SQL}, {_TEXT_VECTORS}, kept AS (SELECT s.query_id, s.id, s.score FROM scored s JOIN t ON t.id = s.id WHERE t.status = 'approved' AND s.score >= {FLOOR}
      AND s.query_id IN (1, 2, 3, 4, 5, 8)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM kept)
    SELECT query_id, id, score, place FROM placed WHERE place <= 10""",
)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten approved works nearest to each query text of three characters or more, by meaning alone: a floor and no rescue."""
    asked = spark.createDataFrame(ASKED, "query_id int, query string").filter(F.length(F.trim("query")) >= 3)
    rows = titled(spark, sf_dir).filter("status = 'approved'").select("id", "title", "keywords", "abstract")
    scored = _scored(rows.join(_stored(spark, sf_dir), "id", "left"), asked).filter(F.col("score") >= FLOOR)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    placed = scored.select("query_id", "id", "score", F.row_number().over(order).cast("long").alias("place"))
    return placed.filter("place <= 10")


_NORM = r"trim(regexp_replace(regexp_replace(replace(lower({c}), 'ß', 'ss'), '[-‐‑‒–—―−]', ' ', 'g'), '\s+', ' ', 'g'))"
_TERM = r"""regexp_matches({c}, '(?i)(^|[^\p{{L}}\p{{N}}_])({form})s?($|[^\p{{L}}\p{{N}}_])')"""
_ABOUT = {1: r"iot|internet[\s\-]+of[\s\-]+things", 2: r"iot|internet[\s\-]+of[\s\-]+things", 6: r"ui|user[\s\-]+interface"}
_NAMED = " OR ".join(f"(a.query_id = {k} AND {_TERM.format(c='t.title', form=v)})" for k, v in _ABOUT.items())
_MEANT = " OR ".join(f"(a.query_id = {k} AND {_TERM.format(c='t.abstract', form=v)})" for k, v in _ABOUT.items())


@query(
    "list_text_search",
    rf"""WITH {WORKS_SQL}, {_TEXT_VECTORS}, a(query_id, norm, single) AS (VALUES (1, 'iot', false), (2, 'internet of things', false), (3, 'src7 en', false),
      (4, 'ocr based tion', false), (5, 'tion.', false), (6, 'ui', false), (7, 'is', false), (8, 'iot based', false)),
    seen AS (SELECT *, {_NORM.format(c='title')} AS norm, {_NORM.format(c=r"regexp_replace(title, '(:|\s-\s).*', '')")} AS name FROM t WHERE status = 'approved' OR uploader = '{READER}'),
    flagged AS (SELECT a.query_id, t.id, t.norm = a.norm OR t.name = a.norm OR {_NAMED}
        OR (a.query_id IN (3, 4, 5, 8) AND regexp_matches(t.norm, '(^|[^\p{{L}}\p{{N}}_])' || replace(a.norm, '.', '\.') || '($|[^\p{{L}}\p{{N}}_])')) AS title_match,
        {_MEANT} AS meant, a.query_id = 3 AND t.uploader = 'src7' AND t.program = 'en' AS author_match, s.score
      FROM seen t CROSS JOIN a JOIN scored s ON s.id = t.id AND s.query_id = a.query_id WHERE t.year >= 2016),
    listed AS (SELECT query_id, id, score, title_match, NOT title_match AND meant AS term_match, author_match,
      score < {FLOOR} AS rescued FROM flagged WHERE score >= {FLOOR} OR title_match OR meant OR author_match),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place, count(*) OVER (PARTITION BY query_id) AS total FROM listed)
    SELECT query_id, id, score, title_match, term_match, author_match, rescued, place, total FROM placed WHERE place <= {PAGE}""",
)
def list_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a ranked listing for each query text, as one reader sees it, from the year 2016.

    Works above the floor are listed, and below it those whose title matches, that are
    about the term that the query is, or whose author the query names; they keep their
    score. Whether a word is rare is told from all titles that the reader may see,
    before the filter on years. Blank queries list nothing.
    """
    asked = spark.createDataFrame(ASKED, "query_id int, query string")
    seen = titled(spark, sf_dir).filter((F.col("status") == "approved") | (F.col("uploader") == READER))
    corpus = seen.select("id", "title")
    rows = seen.filter("year >= 2016")
    hits = title_hits(asked, rows.select("id", "title"), corpus, TERMS).withColumn("hit", F.lit(True))
    # keywords and abstract are the head of a work, so that one mention there is enough
    terms = asked.withColumn("term", whole_term("query", TERMS)).filter("term is not null").select("query_id", "term")
    head = rows.select("id", F.concat_ws("\n", F.array_join("keywords", " ; "), "abstract").alias("text"))
    meant = term_mentions(head, TERMS, terms).join(F.broadcast(terms), "term").select("query_id", "id", F.lit(True).alias("meant"))
    scored = _scored(rows.select("id", "title", "keywords", "abstract", "uploader", "program").join(_stored(spark, sf_dir), "id", "left"), asked)
    words = F.regexp_extract_all(normal_title("query"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    author = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "uploader", "program")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    flagged = scored.join(F.broadcast(asked.select("query_id", words.alias("asked"))), "query_id")
    flagged = flagged.withColumn("author_match", (F.length(F.array_join("asked", "")) >= 3) & (F.size(F.array_except("asked", author)) == 0))
    flagged = flagged.select("query_id", "id", "score", "author_match").join(hits, ["query_id", "id"], "left").join(meant, ["query_id", "id"], "left")
    title, exempt = F.coalesce("hit", F.lit(False)), F.expr("hit is not null or meant is not null or author_match")
    listed = flagged.filter((F.col("score") >= FLOOR) | exempt).select(
        "query_id", "id", "score", title.alias("title_match"), (~title & F.coalesce("meant", F.lit(False))).alias("term_match"), "author_match",
        (F.col("score") < FLOOR).alias("rescued"),
    )
    totals = listed.groupBy("query_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    placed = listed.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= PAGE)
    return placed.join(F.broadcast(totals), "query_id")


@query(
    "term_mentions_by_work",
    rf"""WITH {WORKS_SQL}, t AS (SELECT {_TITLED} AS title, abstract FROM works),
    f(term, form) AS (VALUES ('IoT', 'iot|internet[\s\-]+of[\s\-]+things'), ('OCR', 'ocr|optical[\s\-]+character[\s\-]+recognition'), ('UI', 'ui|user[\s\-]+interface'))
    SELECT f.term, count(*) AS works FROM t, f WHERE regexp_matches(t.title || chr(10) || t.abstract, '(?i)(^|[^\p{{L}}\p{{N}}_])(' || f.form || ')s?($|[^\p{{L}}\p{{N}}_])') GROUP BY f.term""",
)
def term_mentions_by_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many works name the terms of the Internet of Things, text recognition and user interfaces, in either form."""
    texts = titled(spark, sf_dir).select("id", F.concat_ws("\n", "title", "abstract").alias("text"))
    wanted = [k for k, (short, _, _) in enumerate(TERMS) if short in ("IoT", "OCR", "UI")]
    numbers = spark.createDataFrame([(k, TERMS[k][0]) for k in wanted], "term int, name string")
    found = term_mentions(texts, TERMS, numbers).join(F.broadcast(numbers), "term")
    return found.groupBy(F.col("name").alias("term")).agg(F.count("*").alias("works"))
