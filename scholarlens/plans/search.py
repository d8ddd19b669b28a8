"""Text queries: mentions, tags, title terms, TF-IDF, rescue search and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlens.functions.text import TITLE_STOPS, is_about, mentions, plain_words, spaced, title_terms, whole_word
from scholarlens.operators.vectors import dot
from scholarlens.registry import query
from scholarlens.sources.folders import stored
from scholarlens.sources.views import WORKS_SQL, read, subjects, works

#: Stand-ins for a glossary, (short form, long form): the texts' words are invented.
GLOSSARY = [("onin", "the on"), ("ation", "in the"), ("ment", "de la"), ("ung", "in der")]
TAGS = ["tion", "thand", "enen", "erin", "queen", "inch"]

_SPACED = r"' ' || array_to_string(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), '  ') || ' '"


def _count(column: str, phrase: str) -> str:
    needle = " " + "  ".join(phrase.split()) + " "
    return f"(len(string_split({column}, '{needle}')) - 1)"


@query(
    "glossary_mentions",
    f"WITH t AS (SELECT doc_id AS id, {_SPACED.format(c='text')} AS s FROM documents), m AS ("
    + " UNION ALL ".join(f"SELECT id, '{a}' AS term, {_count('s', a)} AS short_form, {_count('s', b)} AS long_form FROM t" for a, b in GLOSSARY)
    + ") SELECT term, CAST(sum(short_form) AS BIGINT) AS short_forms, CAST(sum(long_form) AS BIGINT) AS long_forms, count(*) FILTER (short_form + long_form > 0) AS works FROM m GROUP BY term",
)
def glossary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each glossary term in its short and long form, and the works that have any."""
    text = read(spark, sf_dir, "documents").select(spaced(plain_words("text")).alias("s"))
    counts = [
        F.struct(F.lit(a).alias("term"), mentions("s", a).alias("short"), mentions("s", b).alias("long")) for a, b in GLOSSARY
    ]
    rows = text.select(F.explode(F.array(*counts)).alias("m")).select("m.*")
    return rows.groupBy("term").agg(
        F.sum("short").alias("short_forms"),
        F.sum("long").alias("long_forms"),
        F.count_if(F.col("short") + F.col("long") > 0).alias("works"),
    )


@query(
    "works_about_term",
    f"""WITH {WORKS_SQL}, t AS (SELECT id, {_SPACED.format(c='title')} AS head, {_SPACED.format(c='abstract')} AS s, length(abstract) AS n FROM works)
    SELECT id, CAST({_count('s', 'tion')} AS BIGINT) AS mentions FROM t
    WHERE {_count('head', 'tion')} > 0 OR ({_count('s', 'tion')} >= 3 AND {_count('s', 'tion')} * 10000.0 / n >= 1.0)""",
)
def works_about_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works about a term: named in the title, or often enough in the text."""
    rows = works(spark, sf_dir).select(
        "id", spaced(plain_words("title")).alias("head"), spaced(plain_words("abstract")).alias("s"), F.length("abstract").alias("n")
    )
    about = is_about(F.col("head"), F.col("s"), F.col("n"), "tion")
    return rows.filter(about).select("id", mentions("s", "tion").cast("long").alias("mentions"))


@query(
    "technology_tags",
    f"""WITH {WORKS_SQL}, t AS (SELECT id, program, {_SPACED.format(c='abstract')} AS s FROM works),
    tagged AS (SELECT id, program, list_filter([{", ".join(f"CASE WHEN {_count('s', t)} > 0 THEN '{t}' END" for t in TAGS)}], lambda x: x IS NOT NULL) AS tags FROM t),
    flat AS (SELECT program, unnest(tags) AS tag FROM tagged)
    SELECT program, tag, count(*) AS n FROM flat GROUP BY program, tag""",
)
def technology_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the tags found in works, by program; a work has its tags in their declared order."""
    rows = works(spark, sf_dir).select("program", spaced(plain_words("abstract")).alias("s"))
    found = F.array_compact(F.array(*[F.when(mentions("s", t) > 0, F.lit(t)) for t in TAGS]))
    return rows.select("program", F.explode(found).alias("tag")).groupBy("program", "tag").agg(F.count("*").alias("n"))


_TERMS = (
    "list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower({c}), '[^a-z\\s]', ' ', 'g')), '\\s+'), "
    "lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in TITLE_STOPS) + ")))"
)


@query(
    "token_overlap",
    f"""WITH {WORKS_SQL}, t AS (SELECT id, {_TERMS.format(c='title')} AS w FROM works)
    SELECT a.id, array_to_string(list_sort(list_intersect(a.w, b.w)), ' ') AS common,
      array_to_string(list_sort(list_filter(a.w, lambda x: NOT list_contains(b.w, x))), ' ') AS distinctive
    FROM t a JOIN t b ON b.id = a.id + 1 WHERE len(list_intersect(a.w, b.w)) > 0""",
)
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common and distinctive title terms of each work against the next one, where there are common ones."""
    rows = works(spark, sf_dir).select("id", title_terms("title").alias("w"))
    following = rows.select((F.col("id") - 1).alias("id"), F.col("w").alias("v"))
    both = rows.join(following, "id").withColumn("common", F.array_intersect("w", "v")).filter(F.size("common") > 0)
    return both.select(
        "id",
        F.array_join(F.array_sort("common"), " ").alias("common"),
        F.array_join(F.array_sort(F.array_except("w", "v")), " ").alias("distinctive"),
    )


_TFIDF = r"""toks AS (SELECT d.doc_id AS id, e.label AS topic, unnest(regexp_extract_all(lower(d.text), '[a-z][a-z\-]{2,}')) AS term
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
counts AS (SELECT id, topic, term, count(*) AS c FROM toks GROUP BY id, topic, term),
n AS (SELECT count(DISTINCT id) AS n FROM counts),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
kept AS (SELECT c.id, c.topic, c.term, (1 + ln(c.c)) * (ln((1.0 + n.n) / (1 + df.df)) + 1) AS w
  FROM counts c JOIN df ON df.term = c.term, n WHERE df.df >= 2 AND df.df <= 0.95 * n.n),
norms AS (SELECT id, sqrt(sum(w * w)) AS l FROM kept GROUP BY id),
weights AS (SELECT k.id, k.topic, k.term, k.w / norms.l AS w FROM kept k JOIN norms ON norms.id = k.id)"""


def tfidf(docs: DataFrame, min_df: int | None = 2, max_share: float = 0.95, terms: Column | None = None) -> DataFrame:
    """(id, topic, term, w): term weights of documents (id, topic, text), of length 1 for each document.

    Sublinear counts, smoothed inverse document frequency; terms in fewer than
    ``min_df`` documents (None: 1 of fewer than five documents, else 2) or more than
    ``max_share`` of them are left out. ``terms`` is an array of a document's terms, its words if not given.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0))
    terms = docs.select("id", "topic", F.explode(words if terms is None else terms).alias("term"))
    # read for the spread and for the weights; texts become terms once
    counts = stored(terms.groupBy("id", "topic", "term").agg(F.count("*").alias("c")), "term-counts")
    total = counts.agg(F.count_distinct("id").alias("n"))
    spread = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(total)
    least = F.when(F.col("n") < 5, 1).otherwise(2) if min_df is None else F.lit(min_df)
    spread = spread.filter((F.col("df") >= least) & (F.col("df") <= F.col("n") * max_share))
    idf = spread.select("term", (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    kept = counts.join(idf, "term").select("id", "topic", "term", ((1 + F.log("c")) * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return kept.filter("id is not null").select("id", "topic", "term", (F.col("w") / length).alias("w"))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(subjects(spark, sf_dir).select("id", F.col("subject").alias("topic")), "id")


def _first(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


@query(
    "tfidf_terms",
    f"""WITH {_TFIDF}, ranked AS (SELECT id, term, round(w, 4) AS weight, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, term) AS r FROM weights)
    SELECT id, term, weight, r AS rank FROM ranked WHERE r <= 3""",
)
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest terms of each embedded work; ties by term."""
    best = _first(tfidf(_embedded(spark, sf_dir)), "id", [F.desc(F.round("w", 9)), F.col("term")], 3)
    return best.select("id", "term", F.round("w", 4).alias("weight"), F.col("rank").cast("long").alias("rank"))


@query(
    "cluster_top_terms",
    f"""WITH {_TFIDF}, sizes AS (SELECT topic, count(DISTINCT id) AS size FROM weights GROUP BY topic),
    means AS (SELECT w.topic, w.term, sum(w.w) / max(s.size) AS m FROM weights w JOIN sizes s ON s.topic = w.topic GROUP BY w.topic, w.term),
    ranked AS (SELECT topic, term, round(m, 4) AS weight, row_number() OVER (PARTITION BY topic ORDER BY round(m, 9) DESC, term) AS r FROM means)
    SELECT CAST(topic AS BIGINT) AS topic, term, weight, r AS rank FROM ranked WHERE r <= 6""",
)
def cluster_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six terms with the highest mean weight in each group of works."""
    weights = tfidf(_embedded(spark, sf_dir))
    sizes = weights.groupBy("topic").agg(F.count_distinct("id").alias("size"))
    means = weights.groupBy("topic", "term").agg(F.sum("w").alias("w")).join(sizes, "topic")
    means = means.select("topic", "term", (F.col("w") / F.col("size")).alias("m"))
    best = _first(means, "topic", [F.desc(F.round("m", 9)), F.col("term")], 6)
    return best.select("topic", "term", F.round("m", 4).alias("weight"), F.col("rank").cast("long").alias("rank"))


@query(
    "search_with_rescue",
    f"""WITH {WORKS_SQL}, q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
    seen AS (SELECT w.id, w.title, w.abstract, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS score
      FROM works w JOIN embeddings e ON e.vec_id = w.id, q WHERE w.status = 'approved'),
    matched AS (SELECT *, contains({_SPACED.format(c='title')}, ' tion ') AS title_match FROM seen),
    termed AS (SELECT *, NOT title_match AND contains({_SPACED.format(c='abstract')}, ' thand ') AS term_match FROM matched)
    SELECT id, round(score, 4) AS score, title_match, term_match FROM termed
    WHERE score >= 0.1 OR title_match OR term_match ORDER BY round(score, 4) DESC, id LIMIT 50""",
)
def search_with_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic search with a floor, from which works that name the query are exempt; they keep their low score."""
    one = subjects(spark, sf_dir).filter("id = 0").select(F.col("vector").alias("q")).orderBy("q").limit(1)
    rows = works(spark, sf_dir).filter("status = 'approved'").select("id", "title", "abstract")
    scored = rows.join(subjects(spark, sf_dir).select("id", "vector"), "id").join(F.broadcast(one)).withColumn("s", dot("vector", "q"))
    title = whole_word("title", "tion")
    term = ~title & (mentions(spaced(plain_words("abstract")), "thand") > 0)
    flagged = scored.select("id", "s", title.alias("title_match"), term.alias("term_match"))
    kept = flagged.filter((F.col("s") >= 0.1) | F.col("title_match") | F.col("term_match"))
    shown = kept.select("id", F.round("s", 4).alias("score"), "title_match", "term_match")
    return shown.orderBy(F.desc("score"), "id").limit(50)


_CITED = r"""targets AS (SELECT item_id, array_to_string((regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))[1:8], ' ') AS title FROM benchmark),
texts AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents),
edges AS (SELECT DISTINCT doc_id AS citing, item_id AS cited FROM texts, targets WHERE contains(t, ' ' || title || ' '))"""


def citation_edges(docs: DataFrame, targets: DataFrame, words: int = 8) -> DataFrame:
    """(citing, cited): documents (doc_id, text) in which the first words of a target (item_id, text) stand in order.

    Targets of fewer than ``words`` words are found by all they have. The runs of a
    document, of each length that a target's key has, are joined with the keys by
    64-bit hashes, so that no text is held against titles that it shares nothing with
    and no run leaves its task as text; hits alone are compared word by word.
    """
    tokens = plain_words("text")
    titles = targets.filter("text is not null").select("item_id", F.slice(tokens, 1, words).alias("k"))
    lengths = sorted(r.n for r in titles.select(F.size("k").alias("n")).distinct().collect())
    titles = titles.select("item_id", "k", F.size("k").alias("n"), F.xxhash64("k").alias("h"))

    def runs_of(n: int) -> Column:
        last = F.size("w") - n + 1
        found = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.xxhash64(F.slice("w", i, n)).alias("h")))
        # a target without words stands in texts without words alone
        fits = last > 0 if n else last == 1
        return F.when(fits, found).otherwise(F.array().cast("array<struct<at:int,n:int,h:bigint>>"))

    rows = docs.filter("text is not null")
    runs = rows.select("doc_id", tokens.alias("w"))
    runs = runs.select("doc_id", F.explode(F.concat(F.array().cast("array<struct<at:int,n:int,h:bigint>>"), *map(runs_of, lengths))).alias("r")).select("doc_id", "r.*")
    hits = runs.join(titles, ["n", "h"]).select("doc_id", "at", "n", "k", "item_id").distinct()
    same = hits.join(rows.select("doc_id", "text"), hits["doc_id"].eqNullSafe(rows["doc_id"])).select(hits["doc_id"], "at", "n", "k", "item_id", tokens.alias("w"))
    same = same.filter(F.slice("w", F.col("at"), F.col("n")) == F.col("k"))
    return same.select(F.col("doc_id").alias("citing"), F.col("item_id").alias("cited")).distinct()


@query("citations", f"WITH {_CITED} SELECT citing, cited FROM edges")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a title that it names."""
    return citation_edges(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(
    "cited_by_counts",
    f"""WITH {_CITED} SELECT t.item_id, count(e.citing) AS cited_by, count(e.citing) FILTER (l.quality = 1) AS cited_by_approved
    FROM targets t LEFT JOIN edges e ON e.cited = t.item_id LEFT JOIN labels l ON l.doc_id = e.citing GROUP BY t.item_id""",
)
def cited_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents, and how many approved ones, name each target; none counts as 0."""
    targets = read(spark, sf_dir, "benchmark")
    edges = citation_edges(read(spark, sf_dir, "documents"), targets)
    good = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("citing"), "quality")
    counted = edges.join(good, "citing", "left").groupBy(F.col("cited").alias("item_id")).agg(
        F.count("*").alias("cited_by"), F.count_if(F.col("quality") == 1).alias("cited_by_approved")
    )
    return targets.select("item_id").join(counted, "item_id", "left").na.fill(0)
