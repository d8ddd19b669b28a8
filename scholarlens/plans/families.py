"""Families of rotating tokens, and what a grouping is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlens.operators.agreement import adjusted_rand, cosine_silhouettes, stability
from scholarlens.operators.chains import families
from scholarlens.operators.vectors import dot, unit_vector
from scholarlens.plans.groups import topic_groups
from scholarlens.plans.vectors import DIM
from scholarlens.registry import query
from scholarlens.sources.folders import stored
from scholarlens.sources.views import read, subjects

#: Events that issue a token; a sign-up with a number that this divides begins a family.
ISSUING, FIRST = ("signup", "view", "purchase"), 37


def token_links(events: DataFrame) -> DataFrame:
    """(id, parent, user_id, at): each issued token and the one that it replaced, the user's last before it."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    issued = events.filter(F.col("event_type").isin(*ISSUING))
    fresh = (F.col("event_type") == "signup") & (F.col("event_id") % FIRST == 0)
    parent = F.when(~fresh, F.lag("event_id").over(order))
    return issued.select(F.col("event_id").alias("id"), parent.alias("parent"), "user_id", F.struct("ts", "event_id").alias("at"))


@query(
    "token_families",
    f"""WITH RECURSIVE t AS (SELECT event_id AS id, user_id, ts, CASE WHEN event_type = 'signup' AND event_id % {FIRST} = 0 THEN NULL
        ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS parent FROM events WHERE event_type IN {ISSUING}),
    chain AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.id, c.root, c.depth + 1 FROM chain c JOIN t ON t.parent = c.id),
    seen AS (SELECT event_id, ts, event_type, last_value(CASE WHEN event_type IN {ISSUING} THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM events),
    reuse AS (SELECT c.root, min((s.ts, s.event_id)) AS at_reuse FROM seen s JOIN chain c ON c.id = s.held WHERE s.event_type = 'error' AND c.depth > 0 GROUP BY c.root)
    SELECT c.id AS token, c.root AS family, c.depth, CASE WHEN (t.ts, t.id) > r.at_reuse THEN 'refused' WHEN k.id IS NOT NULL AND (r.at_reuse IS NULL OR (k.ts, k.id) < r.at_reuse) THEN 'rotated'
      WHEN r.at_reuse IS NOT NULL THEN 'revoked' ELSE 'active' END AS state
    FROM chain c JOIN t ON t.id = c.id LEFT JOIN t k ON k.parent = c.id LEFT JOIN reuse r ON r.root = c.root""",
)
def token_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token's family, its place in the chain, and what became of it.

    An error presents the token before the one that its user holds. That one was
    rotated, so its whole family is revoked from then on: the token that was valid is,
    and later ones are refused. Other families of the user go on.
    """
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    links = stored(token_links(events), "token-links")
    chains = families(links.select("id", "parent"))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col("event_type").isin(*ISSUING), F.col("event_id")), ignorenulls=True).over(before)
    shown = events.withColumn("id", held).filter("event_type = 'error' and id is not null").select("id", F.struct("ts", "event_id").alias("shown"))
    reuse = shown.join(chains.filter("depth > 0"), "id").groupBy("root").agg(F.min("shown").alias("reuse"))
    child = links.filter("parent is not null").select(F.col("parent").alias("id"), F.col("at").alias("replaced"))
    rows = chains.join(links.select("id", "at"), "id").join(child, "id", "left").join(reuse, "root", "left")
    state = (
        F.when(F.col("at") > F.col("reuse"), "refused")
        .when(F.col("replaced").isNotNull() & (F.col("reuse").isNull() | (F.col("replaced") < F.col("reuse"))), "rotated")
        .when(F.col("reuse").isNotNull(), "revoked")
        .otherwise("active")
    )
    return rows.select(F.col("id").alias("token"), F.col("root").alias("family"), "depth", state.alias("state"))


def _ari_sql(name: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS pair, max(t.n) AS n, (max(t.x) - max(l.x) * max(r.x) / (max(t.n) * (max(t.n) - 1) / 2)) / ((max(l.x) + max(r.x)) / 2 - max(l.x) * max(r.x) / (max(t.n) * (max(t.n) - 1) / 2)) AS ari FROM
      (SELECT sum(c) AS n, sum(c * (c - 1) / 2.0) AS x FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM g GROUP BY {a}, {b})) t,
      (SELECT sum(c * (c - 1) / 2.0) AS x FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM g GROUP BY {a})) l,
      (SELECT sum(c * (c - 1) / 2.0) AS x FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM g GROUP BY {b})) r"""


@query(
    "grouping_agreement",
    f"""WITH g AS (SELECT e.vec_id, e.label, e.label // 2 AS coarse, CASE WHEN e.vec_id % 4 = 0 THEN -1 ELSE e.label END AS spoilt, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
    made AS ({_ari_sql("coarse", "label", "coarse")} UNION ALL {_ari_sql("spoilt", "label", "spoilt")} UNION ALL {_ari_sql("source", "label", "source")} UNION ALL {_ari_sql("itself", "label", "label")})
    SELECT pair, CAST(n AS BIGINT) AS n, round(ari, 6) AS ari FROM made""",
)
def grouping_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well other groupings agree with the stored subjects: subjects by twos, with a fourth of works in one group, by source, and themselves."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    rows = subjects(spark, sf_dir).select("id", F.col("subject").alias("a")).join(docs, "id")
    other = {
        "coarse": F.floor(F.col("a") / 2).cast("string"),
        "spoilt": F.when(F.col("id") % 4 == 0, "-1").otherwise(F.col("a").cast("string")),
        "source": F.col("source"),
        "itself": F.col("a").cast("string"),
    }
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("pair"), c.alias("b")) for n, c in other.items()]))
    made = adjusted_rand(rows.select("a", named.alias("o")).select("a", "o.pair", "o.b"), ["pair"])
    return made.select("pair", "n", F.round("ari", 6).alias("ari"))


@query(
    "grouping_silhouettes",
    """WITH v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings),
    means AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE 1 - list_dot_product(a.u, b.u) END) AS d, count(*) AS n FROM v a, v b GROUP BY ALL),
    sides AS (SELECT vec_id, label, max(CASE WHEN label = other AND n > 1 THEN d / (n - 1) END) AS near, min(CASE WHEN label <> other THEN d / n END) AS far FROM means GROUP BY vec_id, label)
    SELECT CAST(label AS BIGINT) AS subject, count(*) AS works, round(avg(coalesce((far - near) / greatest(far, near), 0)), 6) AS silhouette FROM sides GROUP BY label""",
)
def grouping_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How close the works of each stored subject are to each other against the nearest other subject."""
    rows = subjects(spark, sf_dir).select("id", F.col("subject").alias("group"), unit_vector("vector", DIM).alias("vector")).filter("vector is not null")
    told = cosine_silhouettes(rows).groupBy(F.col("group").alias("subject"))
    return told.agg(F.count("*").alias("works"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query("grouping_stability")
def grouping_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement over seeds and closeness of k-means groupings for 5 to 8 groups, and the number of groups to take."""
    rows = subjects(spark, sf_dir).select("id", unit_vector("vector", DIM).alias("vector")).filter("vector is not null")
    return stability(rows, range(5, 9), range(1, 4))


@query("topic_group_agreement")
def topic_group_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the clustering of works against their stored subjects."""
    placed = topic_groups(spark, sf_dir).select("id", F.col("group_id").alias("b"))
    rows = subjects(spark, sf_dir).select("id", F.col("subject").alias("a")).join(placed, "id")
    return adjusted_rand(rows.withColumn("pair", F.lit("topic_groups")), ["pair"]).select("pair", "n", F.round("ari", 6).alias("ari"))


@query(
    "suggestion_accuracy",
    """WITH v AS (SELECT vec_id AS id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings),
    flat AS (SELECT id, label, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM v),
    rest AS (SELECT v.id, f.label, f.k, sum(f.x) AS x, count(*) AS n FROM v JOIN flat f ON f.id <> v.id GROUP BY v.id, f.label, f.k),
    scored AS (SELECT r.id, r.label, round(sum(r.x * f.x) / sqrt(sum(r.x * r.x)), 9) AS s FROM rest r JOIN flat f ON f.id = r.id AND f.k = r.k GROUP BY r.id, r.label),
    ranked AS (SELECT s.id, s.label, row_number() OVER (PARTITION BY s.id ORDER BY s.s DESC, s.label) AS r FROM scored s)
    SELECT count(*) AS works, round(avg(CASE WHEN r.r = 1 THEN 1.0 ELSE 0 END), 6) AS first, round(avg(CASE WHEN r.r <= 2 THEN 1.0 ELSE 0 END), 6) AS first_two,
      round((SELECT max(n) FROM (SELECT count(*) AS n FROM v GROUP BY label)) / CAST(count(*) AS DOUBLE), 6) AS most_common FROM v LEFT JOIN ranked r ON r.id = v.id AND r.label = v.label""",
)
def suggestion_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a work's own subject is the first or among the first two suggested, when the work itself is left out of its subject's centroid.

    The product of a work with the centroid of the others comes from sums by subject:
    what the work adds to its own is taken off, so that no pair of works is formed.
    """
    rows = subjects(spark, sf_dir).select("id", "subject", unit_vector("vector", DIM).alias("vector")).filter("vector is not null")
    flat = rows.select("subject", F.posexplode("vector").alias("k", "x")).groupBy("subject", "k").agg(F.sum("x").alias("x"))
    sums = flat.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("total"))
    sums = sums.join(rows.groupBy("subject").agg(F.count("*").alias("n")), "subject").withColumn("square", dot("total", "total"))
    sums = sums.withColumnRenamed("subject", "other")
    own, product = F.col("subject") == F.col("other"), F.col("product")
    met = rows.crossJoin(sums).withColumn("product", dot("vector", "total")).filter(~own | (F.col("n") > 1))
    score = F.when(own, (product - 1) / F.sqrt(F.col("square") - 2 * product + 1)).otherwise(product / F.sqrt("square"))
    scored = met.select("id", "subject", "other", F.round(score, 9).alias("s"))
    mine = F.max(F.when(F.col("subject") == F.col("other"), F.struct("s", (-F.col("other")).alias("o"))))
    better = scored.groupBy("id").agg(mine.alias("mine")).join(scored, "id").filter(F.struct("s", (-F.col("other")).alias("o")) > F.col("mine"))
    ahead = better.groupBy("id").agg(F.count("*").alias("ahead"))
    placed = scored.filter("subject = other").select("id").join(ahead, "id", "left").select(F.coalesce("ahead", F.lit(0)).alias("ahead"))
    told = placed.agg(F.sum(F.when(F.col("ahead") == 0, 1.0).otherwise(0.0)).alias("one"), F.sum(F.when(F.col("ahead") < 2, 1.0).otherwise(0.0)).alias("two"))
    size = rows.groupBy("subject").agg(F.count("*").alias("n")).agg(F.sum("n").alias("works"), F.max("n").alias("most"))
    return told.crossJoin(size).select(
        "works", F.round(F.col("one") / F.col("works"), 6).alias("first"), F.round(F.col("two") / F.col("works"), 6).alias("first_two"), F.round(F.col("most") / F.col("works"), 6).alias("most_common")
    )
