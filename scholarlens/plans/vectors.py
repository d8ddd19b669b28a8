"""Queries over stored vectors: ranking, bands, redundancy, subjects and topic trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.operators.vectors import band, best_matches, centroids, dot, fault, unit_vector
from scholarlens.registry import query
from scholarlens.sources.views import read, subjects

DIM = 64

_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(
    "semantic_rank_topk",
    f"""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id IN (0, 1))
    SELECT vec_id AS id, round(greatest(-1, least(1, max({_DOT.format(a="e.embedding", b="q.v")}))), 4) AS score
    FROM embeddings e, q WHERE vec_id > 1 GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 20""",
)
def semantic_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty rows nearest to either variant of a query, by their clipped best dot product; ties by id."""
    rows = subjects(spark, sf_dir).select("id", "vector")
    # the query is two rows
    wanted = rows.filter("id in (0, 1)").groupBy("id").agg(F.min("vector").alias("q")).select("q")
    scored = rows.filter("id > 1").join(F.broadcast(wanted)).groupBy("id").agg(F.max(dot("vector", "q")).alias("s"))
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s"))), 4)
    return scored.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(
    "similarity_bands",
    f"""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 3),
    scored AS (SELECT round({_DOT.format(a="e.embedding", b="q.v")}, 4) AS s FROM embeddings e, q WHERE vec_id <> 3)
    SELECT CASE WHEN s >= 0.85 THEN 'HIGH' WHEN s >= 0.6 THEN 'MODERATE' ELSE 'LOW' END AS band,
      count(*) AS n, count(*) FILTER (s >= 0.35) AS relevant, max(s) AS best FROM scored GROUP BY 1""",
)
def similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows fall into each band of similarity to one, how many pass the floor, and the best of each band."""
    rows = subjects(spark, sf_dir).select("id", "vector")
    one = rows.filter("id = 3").select(F.col("vector").alias("q")).orderBy("q").limit(1)
    scored = rows.filter("id <> 3").join(F.broadcast(one)).select(F.round(dot("vector", "q"), 4).alias("s"))
    return scored.groupBy(band("s").alias("band")).agg(
        F.count("*").alias("n"), F.count_if(F.col("s") >= 0.35).alias("relevant"), F.max("s").alias("best")
    )


@query(
    "redundancy_best_match",
    f"""WITH scored AS (SELECT p.vec_id AS probe, c.vec_id AS id, {_DOT.format(a="p.embedding", b="c.embedding")} AS s
      FROM embeddings p JOIN embeddings c ON c.vec_id <> p.vec_id WHERE p.vec_id % 100 = 0),
    top AS (SELECT probe, max(s) AS m FROM scored GROUP BY probe),
    chosen AS (SELECT probe, min_by(id, id) AS id, min_by(s, id) AS s FROM scored JOIN top USING (probe) WHERE s >= m - 1e-6 GROUP BY probe)
    SELECT probe, id AS match_id, round(s, 4) AS score,
      CASE WHEN s >= 0.85 THEN 'High Overlap' WHEN s >= 0.6 THEN 'Moderate' ELSE 'Clean' END AS label FROM chosen""",
)
def redundancy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest other row of every hundredth row, searched among all rows in blocks, with an overlap label."""
    rows = subjects(spark, sf_dir).select("id", "vector").filter(fault("vector", DIM).isNull())
    found = best_matches(rows, rows.filter("id % 100 = 0"))
    label = F.when(F.col("score") >= 0.85, "High Overlap").when(F.col("score") >= 0.6, "Moderate").otherwise("Clean")
    return found.select("probe", F.col("id").alias("match_id"), F.round("score", 4).alias("score"), label.alias("label"))


@query(
    "vector_validity",
    """WITH made AS (SELECT vec_id AS id, CASE vec_id % 6 WHEN 1 THEN NULL WHEN 2 THEN embedding[1:10]
        WHEN 3 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) WHEN 4 THEN CAST([] AS FLOAT[]) ELSE embedding END AS v FROM embeddings),
    judged AS (SELECT CASE WHEN v IS NULL OR len(v) = 0 THEN 'missing_title_embedding' WHEN len(v) <> 64 THEN 'dimension_mismatch'
      WHEN sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) < 1e-6 THEN 'missing_title_embedding' ELSE 'usable' END AS reason,
      v IS NOT NULL AND len(v) = 64 AND sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) > 1e-6 AS has_unit FROM made)
    SELECT reason, count(*) AS n, count(*) FILTER (has_unit) AS with_unit_vector FROM judged GROUP BY reason""",
)
def vector_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both validity rules over stored vectors of which two thirds are spoilt in four ways."""
    v, k = F.col("vector"), F.col("id") % 6
    spoilt = (
        F.when(k == 1, F.lit(None))
        .when(k == 2, F.slice(v, 1, 10))
        .when(k == 3, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .when(k == 4, F.slice(v, 1, 0))
        .otherwise(v)
    )
    rows = subjects(spark, sf_dir).select(spoilt.alias("vector"))
    judged = rows.select(F.coalesce(fault("vector", DIM), F.lit("usable")).alias("reason"), unit_vector("vector", DIM).alias("u"))
    return judged.groupBy("reason").agg(F.count("*").alias("n"), F.count("u").alias("with_unit_vector"))


_CENTROIDS = """flat AS (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
summed AS (SELECT label, k, sum(x) AS x FROM flat GROUP BY label, k),
lengths AS (SELECT label, sqrt(sum(x * x)) AS n FROM summed GROUP BY label),
centroids AS (SELECT s.label, s.k, s.x / l.n AS x FROM summed s JOIN lengths l ON l.label = s.label)"""


@query(
    "subject_centroids",
    f"""WITH {_CENTROIDS} SELECT CAST(label AS BIGINT) AS subject, count(*) AS dims, round(sum(x * k), 4) AS weighted_sum,
      round(max(x), 4) AS largest FROM centroids GROUP BY label""",
)
def subject_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit centroid of each subject, summed up by dimension before the shuffle."""
    found = centroids(subjects(spark, sf_dir), "subject")
    weighted = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return found.select(
        "subject",
        F.size("centroid").cast("long").alias("dims"),
        F.round(weighted, 4).alias("weighted_sum"),
        F.round(F.array_max("centroid"), 4).alias("largest"),
    )


@query(
    "subject_suggestions",
    f"""WITH {_CENTROIDS}, scored AS (SELECT f.vec_id AS id, c.label AS subject, round(sum(f.x * c.x), 4) AS score
      FROM flat f JOIN centroids c ON c.k = f.k GROUP BY f.vec_id, c.label),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, subject) AS r FROM scored)
    SELECT id, CAST(subject AS BIGINT) AS subject, score, r AS rank FROM ranked WHERE r <= 2""",
)
def subject_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two subjects whose centroids are nearest to each row; ties by code.

    Subjects are a small vocabulary: their centroids are gathered into one array, so
    that a row is ranked in its own task without a join that multiplies rows.
    """
    rows = subjects(spark, sf_dir)
    table = centroids(rows, "subject").agg(F.collect_list(F.struct("subject", "centroid")).alias("all"))
    scored = rows.select("id", "vector").crossJoin(F.broadcast(table)).select(
        "id",
        F.transform("all", lambda c: F.struct((-F.round(dot(F.col("vector"), c["centroid"]), 4)).alias("s"), c["subject"].alias("subject"))).alias("c"),
    )
    best = scored.select("id", F.posexplode(F.slice(F.array_sort("c"), 1, 2)).alias("r", "c"))
    return best.select("id", "c.subject", (-F.col("c.s")).alias("score"), (F.col("r") + 1).cast("long").alias("rank"))


@query(
    "trend_classification",
    """WITH sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    stats AS (SELECT avg(n) AS mean, sum(n) AS total FROM sizes)
    SELECT CAST(label AS BIGINT) AS topic, n, CASE WHEN total < 15 AND n >= 5 THEN 'SATURATED' WHEN total < 15 AND n >= 2 THEN 'EMERGING'
      WHEN total < 15 THEN 'UNDEREXPLORED' WHEN n >= 1.5 * mean THEN 'SATURATED' WHEN n <= 0.5 * mean THEN 'UNDEREXPLORED' ELSE 'EMERGING' END AS trend,
      CAST(ceil(mean * 1.5) AS BIGINT) AS saturated_from, CAST(floor(mean * 0.5) AS BIGINT) AS underexplored_to FROM sizes, stats""",
)
def trend_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of each topic by its size against the mean, fixed steps for a small corpus, and the cut-offs."""
    sizes = subjects(spark, sf_dir).groupBy(F.col("subject").alias("topic")).agg(F.count("*").alias("n"))
    stats = sizes.agg(F.avg("n").alias("mean"), F.sum("n").alias("total"))
    n, mean, small = F.col("n"), F.col("mean"), F.col("total") < 15
    trend = (
        F.when(small & (n >= 5), "SATURATED")
        .when(small & (n >= 2), "EMERGING")
        .when(small, "UNDEREXPLORED")
        .when(n >= 1.5 * mean, "SATURATED")
        .when(n <= 0.5 * mean, "UNDEREXPLORED")
        .otherwise("EMERGING")
    )
    return sizes.crossJoin(stats).select(
        "topic", "n", trend.alias("trend"), F.ceil(mean * 1.5).alias("saturated_from"), F.floor(mean * 0.5).alias("underexplored_to")
    )


@query(
    "title_topic_check",
    f"""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7),
    related AS (SELECT vec_id, round({_DOT.format(a="e.embedding", b="q.v")}, 4) AS s FROM embeddings e, q WHERE vec_id <> 7),
    kept AS (SELECT * FROM related WHERE s >= 0.35), means AS (SELECT avg(n) AS mean FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))
    SELECT vec_id AS id, s AS score, (SELECT count(*) FROM kept) AS related,
      CASE WHEN (SELECT count(*) FROM kept) >= 1.5 * mean THEN 'SATURATED' WHEN (SELECT count(*) FROM kept) <= 0.5 * mean THEN 'UNDEREXPLORED' ELSE 'EMERGING' END AS trend
    FROM kept, means ORDER BY s DESC, vec_id LIMIT 5""",
)
def title_topic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five works nearest to a title above the floor, and the trend that the number of all such works means."""
    rows = subjects(spark, sf_dir)
    one = rows.filter("id = 7").select(F.col("vector").alias("q")).orderBy("q").limit(1)
    related = rows.filter("id <> 7").join(F.broadcast(one)).select("id", F.round(dot("vector", "q"), 4).alias("score"))
    kept = related.filter("score >= 0.35")
    count = kept.agg(F.count("*").alias("related"))
    mean = rows.groupBy("subject").count().agg(F.avg("count").alias("mean"))
    trend = F.when(F.col("related") >= 1.5 * F.col("mean"), "SATURATED").when(F.col("related") <= 0.5 * F.col("mean"), "UNDEREXPLORED").otherwise("EMERGING")
    top = kept.orderBy(F.desc("score"), "id").limit(5)
    return top.crossJoin(count).crossJoin(mean).select("id", "score", "related", trend.alias("trend"))


@query(
    "subject_label_vote",
    """WITH votes AS (SELECT d.source, e.label, count(*) AS n FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source, e.label),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, label) AS r, sum(n) OVER (PARTITION BY source) AS total FROM votes),
    wide AS (SELECT source, max(total) AS total, max(label) FILTER (r = 1) AS a, max(n) FILTER (r = 1) AS na, max(label) FILTER (r = 2) AS b, coalesce(max(n) FILTER (r = 2), 0) AS nb FROM ranked GROUP BY source)
    SELECT source AS topic, CASE WHEN 2 * na >= total AND na > nb OR b IS NULL THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || ' · ' || CAST(b AS VARCHAR) END AS label FROM wide""",
)
def subject_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each group of works: its main subject if that has half of the votes, else the top two."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"))
    votes = docs.join(subjects(spark, sf_dir).select("id", "subject"), "id").groupBy("topic", "subject").agg(F.count("*").alias("n"))
    # subjects are a small vocabulary, so a group's votes are few
    ranked = votes.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "subject"))).alias("v"), F.sum("n").alias("total")
    )
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    clear = (-2 * first["m"] >= F.col("total")) & (first["m"] < F.coalesce(second["m"], F.lit(0)))
    name = F.when(clear | second.isNull(), first["subject"].cast("string")).otherwise(F.concat_ws(" · ", first["subject"].cast("string"), second["subject"].cast("string")))
    return ranked.select("topic", name.alias("label"))
