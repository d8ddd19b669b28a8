"""Groups of works: sizes, names by rule, name collisions, and a scalable clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.plans.search import _embedded, _first
from scholarlens.registry import query
from scholarlens.sources.views import KEYWORDS_SQL, WORKS_SQL, read, subjects, works

#: Stand-ins for naming rules, in order of precedence: label and the beginning of a keyword.
RULES = [("Sea", "the"), ("Land", "and"), ("Work", "ein"), ("Trade", "que"), ("Craft", "men"), ("Song", "ent"), ("Ship", "ciónal")]
KEYWORDS_OF_A_GROUP = 6


def group_count(n: int) -> int:
    """How many groups n works make: each its own below five, else a sixth, from five to eight."""
    return max(1, n) if n < 5 else min(8, max(5, n // 6))


_RANKED = f"""flat AS (SELECT program, unnest(keywords) AS k FROM keyworded),
counted AS (SELECT program, k, count(*) AS n FROM flat GROUP BY program, k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY n DESC, k) AS r FROM counted),
top AS (SELECT * FROM ranked WHERE r <= {KEYWORDS_OF_A_GROUP})"""


def _top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = works(spark, sf_dir).select("program", F.explode("keywords").alias("k")).groupBy("program", "k").agg(F.count("*").alias("n"))
    return _first(counted, "program", [F.desc("n"), F.col("k")], KEYWORDS_OF_A_GROUP)


@query(
    "group_rule_labels",
    f"""WITH {WORKS_SQL}, {KEYWORDS_SQL}, {_RANKED}, rules AS (
      SELECT * FROM (VALUES {", ".join(f"({k}, '{label}', '{start}')" for k, (label, start) in enumerate(RULES))}) AS t(rule, label, start)),
    scored AS (SELECT program, rule, label, sum({KEYWORDS_OF_A_GROUP} + 1 - r) AS score FROM top JOIN rules ON starts_with(k, start) GROUP BY program, rule, label),
    best AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY score DESC, rule) AS b FROM scored)
    SELECT p.program, coalesce(best.label, 'Other / Mixed Topics') AS label, CAST(coalesce(best.score, 0) AS BIGINT) AS score
    FROM (SELECT DISTINCT program FROM top) p LEFT JOIN best ON best.program = p.program AND b = 1""",
)
def group_rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each group by the rule that its best keywords weigh most for; the earlier rule wins a tie."""
    rules = spark.createDataFrame([(k, label, start) for k, (label, start) in enumerate(RULES)], "rule int, label string, start string")
    top = _top_keywords(spark, sf_dir)
    # the rules are a fixed short table
    hits = top.join(F.broadcast(rules), F.col("k").startswith(F.col("start")))
    scored = hits.groupBy("program", "rule", "label").agg(F.sum(F.lit(KEYWORDS_OF_A_GROUP + 1) - F.col("rank")).alias("score"))
    best = scored.groupBy("program").agg(F.max(F.struct("score", (-F.col("rule")).alias("first"), "label")).alias("b"))
    named = top.select("program").distinct().join(best, "program", "left")
    return named.select("program", F.coalesce("b.label", F.lit("Other / Mixed Topics")).alias("label"), F.coalesce("b.score", F.lit(0)).cast("bigint").alias("score"))


@query(
    "group_name_collisions",
    """WITH g AS (SELECT label, 'Group ' || CAST(label % 3 AS VARCHAR) AS name, count(*) AS n FROM embeddings GROUP BY label)
    SELECT CAST(label AS BIGINT) AS group_id, n, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (Cluster ' || CAST(label + 1 AS VARCHAR) || ')' ELSE name END AS name FROM g""",
)
def group_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their names, made distinct by a number where two have the same."""
    groups = subjects(spark, sf_dir).groupBy(F.col("subject").alias("group_id")).agg(F.count("*").alias("n"))
    named = groups.withColumn("name", F.concat(F.lit("Group "), (F.col("group_id") % 3).cast("string")))
    same = named.groupBy("name").agg(F.count("*").alias("same"))
    number = F.concat("name", F.lit(" (Cluster "), (F.col("group_id") + 1).cast("string"), F.lit(")"))
    return named.join(same, "name").select("group_id", "n", F.when(F.col("same") > 1, number).otherwise(F.col("name")).alias("name"))


@query("topic_groups")
def topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works grouped by their vectors: bisecting k-means by cosine, which needs one pass of all rows for each split.

    Returns each work's group, numbered by falling size, and the size.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = subjects(spark, sf_dir).join(_embedded(spark, sf_dir).select("id"), "id", "left_semi").select("id", array_to_vector("vector").alias("features"))
    model = BisectingKMeans(k=group_count(rows.count()), seed=1, distanceMeasure="cosine").fit(rows)
    placed = model.transform(rows).select("id", "prediction")
    sizes = placed.groupBy("prediction").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    # at most eight groups
    ranked = sizes.orderBy(F.desc("size"), "first").limit(8).agg(F.collect_list("prediction").alias("order"))
    return placed.join(sizes, "prediction").crossJoin(F.broadcast(ranked)).select("id", (F.array_position("order", F.col("prediction")) - 1).alias("group_id"), "size")


@query(
    "assignment_integrity",
    """SELECT d.doc_id AS id, count(e.vec_id) AS assignments FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
    GROUP BY d.doc_id HAVING count(e.vec_id) <> 1""",
)
def assignment_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that are in no group or in several."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    placed = subjects(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))
    return docs.join(placed, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("assignments")).filter("assignments <> 1")
