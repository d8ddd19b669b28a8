"""Title checks, ranked list search with a page, titles in reference lists, and terms of one or two words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlens.functions.glossary import references_of, titles_listed
from scholarlens.functions.text import TITLE_STOPS, mentions, plain_words, spaced, whole_word
from scholarlens.operators.vectors import dot
from scholarlens.plans.repository import page_of
from scholarlens.plans.search import _SPACED, _TFIDF, tfidf
from scholarlens.registry import query
from scholarlens.sources.folders import stored
from scholarlens.sources.views import WORKS_SQL, read, subjects, works

#: A word that stands in more titles than this names none of them.
NAMED = 3
FLOOR, SHOWN = 0.35, 10

_DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(
    "title_check",
    f"""WITH {WORKS_SQL}, good AS (SELECT id, title, list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) AS t FROM works WHERE status = 'approved'),
    worded AS (SELECT id, unnest(t) AS word FROM good),
    spread AS (SELECT word, count(*) AS n FROM worded WHERE length(word) >= 3 GROUP BY word),
    asked AS (SELECT 'rare' AS asked, min(word) AS word FROM spread WHERE n <= {NAMED} UNION ALL
      (SELECT 'common' AS asked, word FROM spread ORDER BY n DESC, word DESC LIMIT 1)),
    scored AS (SELECT g.id, round({_DOT}, 4) AS score FROM good g JOIN embeddings e ON e.vec_id = g.id, embeddings q WHERE q.vec_id = 0),
    named AS (SELECT a.asked, w.id, 0 AS kind FROM asked a JOIN spread s ON s.word = a.word AND s.n <= {NAMED} JOIN worded w ON w.word = a.word),
    found AS (SELECT * FROM named UNION ALL SELECT a.asked, s.id, 1 AS kind FROM scored s, asked a WHERE s.score >= {FLOOR}),
    once AS (SELECT asked, id, min(kind) AS kind FROM found GROUP BY asked, id),
    placed AS (SELECT o.asked, o.id, o.kind = 0 AS by_title, s.score, row_number() OVER (PARTITION BY o.asked ORDER BY o.kind, s.score DESC NULLS LAST, o.id) AS place
      FROM once o LEFT JOIN scored s ON s.id = o.id)
    SELECT *, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'moderate' WHEN by_title THEN 'name' ELSE 'low' END AS advice
    FROM placed WHERE place <= {SHOWN}""",
)
def title_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a proposed title meets: works whose titles have its word, if few have it, then works that are near enough.

    Two words are asked for, one that stands in few titles and the most common one,
    each with the vector of the first row. A work is listed once; its score may be null.
    """
    good = works(spark, sf_dir).filter("status = 'approved'").select("id", "title")
    worded = good.select("id", F.explode(F.array_distinct(plain_words("title"))).alias("word"))
    spread = worded.filter(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))
    words = spread.agg(F.min(F.when(F.col("n") <= NAMED, F.struct("word", "n"))).alias("rare"), F.max(F.struct("n", "word")).alias("common"))
    each = F.array(
        F.struct(F.lit("rare").alias("asked"), F.col("rare.word").alias("word"), F.col("rare.n").alias("n")),
        F.struct(F.lit("common").alias("asked"), F.col("common.word").alias("word"), F.col("common.n").alias("n")),
    )
    # one row of two words
    asked = words.select(F.inline(each)).filter("word is not null")
    one = subjects(spark, sf_dir).filter("id = 0").select(F.col("vector").alias("q")).orderBy("q").limit(1)
    scored = good.select("id").join(subjects(spark, sf_dir).select("id", "vector"), "id").join(F.broadcast(one))
    scored = scored.select("id", F.round(dot("vector", "q"), 4).alias("score"))
    named = worded.join(F.broadcast(asked.filter(F.col("n") <= NAMED)), "word").select("asked", "id", F.lit(0).alias("kind"))
    near = scored.filter(F.col("score") >= FLOOR).orderBy(F.desc("score"), "id").limit(SHOWN + NAMED)
    near = near.crossJoin(F.broadcast(asked.select("asked"))).select("asked", "id", F.lit(1).alias("kind"))
    once = named.unionByName(near).groupBy("asked", "id").agg(F.min("kind").alias("kind")).join(scored, "id", "left")
    order = Window.partitionBy("asked").orderBy("kind", F.desc_nulls_last("score"), "id")
    placed = once.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= SHOWN)
    by_title = F.col("kind") == 0
    advice = F.when(F.col("score") >= 0.85, "high").when(F.col("score") >= 0.6, "moderate").when(by_title, "name").otherwise("low")
    return placed.select("asked", "id", by_title.alias("by_title"), "score", "place", advice.alias("advice"))


_TOKENS = _SPACED.format


@query(
    "list_search",
    f"""WITH {WORKS_SQL}, seen AS (SELECT w.id, w.year, round({_DOT}, 4) AS score, contains({_TOKENS(c='w.title')}, ' tion ') AS title_match,
      w.uploader = 'src7' AS author_match, contains({_TOKENS(c='w.abstract')}, ' thand ') AS named
      FROM works w JOIN embeddings e ON e.vec_id = w.id, embeddings q
      WHERE q.vec_id = 0 AND (w.status = 'approved' OR w.uploader = 'src3') AND w.year >= 2016),
    kept AS (SELECT id, year, score, title_match, author_match, NOT title_match AND named AS term_match FROM seen),
    listed AS (SELECT *, (title_match OR term_match OR author_match) AND score < 0.1 AS rescued FROM kept WHERE score >= 0.1 OR title_match OR term_match OR author_match)
    SELECT *, (SELECT count(*) FROM listed) AS total FROM listed ORDER BY score DESC, id LIMIT 20 OFFSET 20""",
)
def list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a ranked listing for one reader: rescued works are kept below the floor and sort by their raw score."""
    rows = works(spark, sf_dir).filter("(status = 'approved' or uploader = 'src3') and year >= 2016").select("id", "year", "title", "abstract", "uploader")
    one = subjects(spark, sf_dir).filter("id = 0").select(F.col("vector").alias("q")).orderBy("q").limit(1)
    scored = rows.join(subjects(spark, sf_dir).select("id", "vector"), "id").join(F.broadcast(one))
    title = whole_word("title", "tion")
    found = scored.select(
        "id", "year", F.round(dot("vector", "q"), 4).alias("score"), title.alias("title_match"), (F.col("uploader") == "src7").alias("author_match"),
        (~title & (mentions(spaced(plain_words("abstract")), "thand") > 0)).alias("term_match"),
    )
    exempt = F.expr("title_match or term_match or author_match")
    listed = found.filter((F.col("score") >= 0.1) | exempt).withColumn("rescued", exempt & (F.col("score") < 0.1))
    return page_of(listed, [F.desc("score"), F.col("id")], 2, 20)


#: An entry's full stops, quotes and lines as bars, other ends as commas: a title stands between bars, or before a comma.
_MARKED = r"""regexp_replace(regexp_replace(chr(10) || refs || chr(10), '\s*[.\n"''“”][\s.,"''“”]*', '|', 'g'), '\s*[?!,\[]\s*', ',', 'g')"""
_LISTED = " OR ".join(f"contains(m, '|' || array_to_string(w[1:{n}], ' ') || '{end}')" for n in (8, 9, 10) for end in "|,")


@query(
    "listed_titles",
    rf"""WITH items AS (SELECT item_id, (regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))[1:10] AS t FROM benchmark),
    made AS (SELECT d.doc_id, d.text || chr(10) || 'References:' || chr(10) || CASE d.doc_id % 5
        WHEN 0 THEN 'Author, A. ' || array_to_string(t, ' ') || '. Press' WHEN 1 THEN 'see ' || array_to_string(t, ' ') || '.'
        WHEN 2 THEN array_to_string(t, ' ') || ' and more' WHEN 3 THEN '"' || array_to_string(t, ' ') || '", 2020'
        ELSE array_to_string(t[1:8], ' ') END AS text FROM documents d JOIN items i ON i.item_id = d.doc_id % 40),
    lists AS (SELECT doc_id, lower(string_split(text, chr(10) || 'References:' || chr(10))[-1]) AS refs FROM made),
    titles AS (SELECT item_id, list_transform(t, lambda x: lower(x)) AS w FROM items WHERE len(t) >= 10)
    SELECT DISTINCT doc_id AS citing, item_id AS cited FROM (SELECT doc_id, {_MARKED} AS m FROM lists), titles WHERE {_LISTED}""",
)
def listed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that stand in the reference list of a document; lists are made of the benchmark, in five forms of which two cite nothing."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 1, 10)
    items = read(spark, sf_dir, "benchmark").select("item_id", words.alias("t"))
    whole, form = F.array_join("t", " "), F.col("doc_id") % 5
    entry = (
        F.when(form == 0, F.concat(F.lit("Author, A. "), whole, F.lit(". Press")))
        .when(form == 1, F.concat(F.lit("see "), whole, F.lit(".")))
        .when(form == 2, F.concat(whole, F.lit(" and more")))
        .when(form == 3, F.concat(F.lit('"'), whole, F.lit('", 2020')))
        .otherwise(F.array_join(F.slice("t", 1, 8), " "))
    )
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    made = docs.join(items, "item_id").select("doc_id", F.concat("text", F.lit("\nReferences:\n"), entry).alias("text"))
    lists = made.select(F.col("doc_id").alias("citing"), references_of("text").alias("text"))
    return titles_listed(lists, items.filter(F.size("t") >= 10).select(F.col("item_id").alias("cited"), whole.alias("title")))


#: Terms compared, before plurals meet, and terms shown.
COMPARED, KEPT = 18, 6
_STOPS = ", ".join(f"'{w}'" for w in TITLE_STOPS)
_PHRASES = (
    f"""base AS (SELECT d.doc_id AS id, e.label AS topic, list_filter(regexp_extract_all(lower(d.text), '[a-z][a-z\\-]{{2,}}'), lambda w: w NOT IN ({_STOPS})) AS w
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
toks AS (SELECT id, topic, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM base),
counts AS"""
    + _TFIDF.split("counts AS", 1)[1]
)


@query(
    "subject_phrases",
    f"""WITH {_PHRASES}, sizes AS (SELECT topic, count(DISTINCT id) AS size FROM weights GROUP BY topic),
    means AS (SELECT w.topic, w.term, sum(w.w) / max(s.size) AS m FROM weights w JOIN sizes s ON s.topic = w.topic GROUP BY w.topic, w.term),
    ranked AS (SELECT topic, term, round(m, 4) AS weight, row_number() OVER (PARTITION BY topic ORDER BY round(m, 9) DESC, term) AS r FROM means),
    single AS (SELECT *, row_number() OVER (PARTITION BY topic, regexp_replace(term, 's$', '') ORDER BY r) AS k FROM ranked WHERE r <= {COMPARED}),
    again AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY r) AS rank FROM single WHERE k = 1)
    SELECT CAST(topic AS BIGINT) AS topic, term, weight, rank FROM again WHERE rank <= {KEPT}""",
)
def subject_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six heaviest terms of one or two words of each subject, stop words left out first; of a word and its plural the heavier one."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    docs = docs.join(subjects(spark, sf_dir).select("id", F.col("subject").alias("topic")), "id")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0)), lambda w: ~w.isin(TITLE_STOPS))
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda v, i: F.concat(F.get("w", i), F.lit(" "), v))
    # read for the sizes and for the means
    weights = stored(tfidf(docs.withColumn("w", words), min_df=None, terms=F.concat("w", pairs)), "term-weights")
    sizes = weights.groupBy("topic").agg(F.count_distinct("id").alias("size"))
    means = weights.groupBy("topic", "term").agg(F.sum("w").alias("w")).join(sizes, "topic")
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("m", 9)), "term")
    top = means.select("topic", "term", (F.col("w") / F.col("size")).alias("m")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= COMPARED)
    stem = Window.partitionBy("topic", F.regexp_replace("term", "s$", "")).orderBy("r")
    single = top.withColumn("k", F.row_number().over(stem)).filter("k = 1")
    again = single.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("r")).cast("long"))
    return again.filter(F.col("rank") <= KEPT).select("topic", "term", F.round("m", 4).alias("weight"), "rank")
