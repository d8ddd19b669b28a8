"""Queries over the event log: audit filters, budgets, limiters, jobs, transitions and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlens.operators.limits import failure_limit, ordered_fold, window_limit
from scholarlens.registry import query
from scholarlens.sources.views import read

DAY = 86_400


@query(
    "audit_filter",
    """SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
    WHERE event_type = 'error' AND user_id < 40 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'""",
)
def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type, some actors and a span of time, with a number from their properties."""
    rows = read(spark, sf_dir, "events").filter(
        (F.col("event_type") == "error")
        & (F.col("user_id") < 40)
        & F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    )
    return rows.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(
    "audit_by_type",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS actors, round(sum(value), 2) AS value,
      count(*) FILTER (ts >= TIMESTAMP '2024-01-25') AS recent FROM events GROUP BY event_type""",
)
def audit_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, actors, value and recent events of each type."""
    recent = F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.count_distinct("user_id").alias("actors"),
        F.round(F.sum("value"), 2).alias("value"),
        F.count_if(recent).alias("recent"),
    )


@query(
    "rolling_budget",
    """SELECT event_id, user_id, n - 1 AS before, n > 3 AS refused FROM (
      SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW) AS n
      FROM events WHERE event_type = 'signup')""",
)
def rolling_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each request, how many its sender made in the 24 hours before, and does that use up the budget?"""
    rows = read(spark, sf_dir, "events").filter("event_type = 'signup'")
    counted = rows.selectExpr(
        "event_id",
        "user_id",
        "count(*) over (partition by user_id order by ts range between interval '23:59:59.999999' hour to second preceding and current row) as n",
    )
    return counted.select("event_id", "user_id", (F.col("n") - 1).alias("before"), (F.col("n") > 3).alias("refused"))


_SECONDS = "unix_micros(cast(ts as timestamp)) / 1000000.0d"


@query(
    "fixed_window_limiter",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s FROM events),
    w AS (SELECT user_id, min(s) AS opened FROM e GROUP BY user_id
      UNION ALL SELECT w.user_id, min(e.s) FROM w JOIN e ON e.user_id = w.user_id AND e.s >= w.opened + {DAY} GROUP BY w.user_id),
    spans AS (SELECT user_id, opened, lead(opened) OVER (PARTITION BY user_id ORDER BY opened) AS following FROM w),
    counted AS (SELECT e.user_id, e.event_id, w.opened, row_number() OVER (PARTITION BY e.user_id, w.opened ORDER BY e.s, e.event_id) AS n
      FROM e JOIN spans w ON w.user_id = e.user_id AND e.s >= w.opened AND (w.following IS NULL OR e.s < w.following))
    SELECT user_id, event_id, opened, n AS hits, n > 3 AS refused FROM counted""",
)
def fixed_window_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a user against a daily budget whose window opens with the first hit."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_SECONDS).alias("second"))
    start, step = window_limit(DAY, 3)
    return ordered_fold(events, "user_id", ["second", "event_id"], start, step, "user_id long, event_id long, opened double, hits long, refused boolean")


@query(
    "failure_limiter",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s, event_type = 'error' AS failed, event_type = 'signup' AS resets,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS opened, CAST(0 AS BIGINT) AS n, '' AS outcome FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, rn, event_id, CASE WHEN had > 2 THEN since WHEN failed THEN coalesce(since, s) WHEN resets THEN NULL ELSE since END,
        CASE WHEN had > 2 THEN had WHEN failed THEN had + 1 WHEN resets THEN 0 ELSE had END,
        CASE WHEN had > 2 OR (failed AND had + 1 > 2) THEN 'refused' WHEN failed THEN 'failed' ELSE 'passed' END
      FROM (SELECT e.*, CASE WHEN e.s >= w.opened + {15 * DAY} THEN NULL ELSE w.opened END AS since, CASE WHEN e.s >= w.opened + {15 * DAY} THEN 0 ELSE w.n END AS had
        FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1))
    SELECT user_id, event_id, n AS failures, outcome FROM w WHERE rn > 0""",
)
def failure_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a user against a limit on failures alone: errors fail, signups reset, the rest pass."""
    events = read(spark, sf_dir, "events").select(
        "user_id", "event_id", F.expr(_SECONDS).alias("second"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "signup").alias("resets")
    )
    start, step = failure_limit(15 * DAY, 2)
    return ordered_fold(events, "user_id", ["second", "event_id"], start, step, "user_id long, event_id long, failures long, outcome string")


@query(
    "state_transitions",
    """WITH s AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT before, event_type AS after, count(*) AS n, min(event_id) AS first_event FROM s WHERE before IS NOT NULL AND before <> event_type GROUP BY ALL""",
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real changes of state of each user, counted by the states before and after."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("after"), before.alias("before"))
    return rows.filter("before <> after").groupBy("before", "after").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "token_reuse",
    """WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS family FROM events),
    rotated AS (SELECT user_id, family, min((ts, event_id)) AS at FROM s WHERE event_type = 'purchase' GROUP BY user_id, family),
    used AS (SELECT s.user_id, s.family, min((s.ts, s.event_id)) AS reuse FROM s JOIN rotated r ON r.user_id = s.user_id AND r.family = s.family
      WHERE s.event_type = 'error' AND (s.ts, s.event_id) > r.at GROUP BY s.user_id, s.family)
    SELECT user_id, CAST(family AS BIGINT) AS family, reuse[2] AS reuse_event FROM used""",
)
def token_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token families of a user that are revoked: the first use of an old token after a rotation.

    A signup issues a family, a purchase rotates its token, an error presents an old one.
    """
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    family = F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(by)
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), family.alias("family"))
    rotated = rows.filter("event_type = 'purchase'").groupBy("user_id", "family").agg(F.min("at").alias("rotated"))
    old = rows.filter("event_type = 'error'").join(rotated, ["user_id", "family"]).filter(F.col("at") > F.col("rotated"))
    return old.groupBy("user_id", "family").agg(F.min("at").alias("m")).select("user_id", "family", F.col("m.event_id").alias("reuse_event"))


@query(
    "token_consumption",
    """WITH p AS (SELECT e.event_id, e.ts, e.user_id, c.c_custkey FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_acctbal > 0
      WHERE e.event_type = 'click'),
    judged AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM p)
    SELECT event_id, user_id, CASE WHEN c_custkey IS NULL THEN 'not_found'
      WHEN r > 1 AND (SELECT min(j.ts) FROM judged j WHERE j.user_id = judged.user_id) < TIMESTAMP '2024-01-02' THEN 'already_used'
      WHEN ts >= TIMESTAMP '2024-01-02' THEN 'expired' ELSE 'ok' END AS outcome FROM judged""",
)
def token_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each presentation of a one-time token: unknown, used before, too late, or fine.

    Only the first presentation in time uses a token up; a late one leaves it expired.
    """
    shown = read(spark, sf_dir, "events").filter("event_type = 'click'").select("event_id", "ts", "user_id")
    tokens = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    first = shown.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    end = F.lit("2024-01-02").cast("timestamp_ntz")
    outcome = (
        F.when(F.col("known").isNull(), "not_found")
        .when((F.struct("ts", "event_id") != F.col("first")) & (F.col("first.ts") < end), "already_used")
        .when(F.col("ts") >= end, "expired")
        .otherwise("ok")
    )
    return shown.join(tokens, "user_id", "left").join(first, "user_id").select("event_id", "user_id", outcome.alias("outcome"))


@query(
    "job_claims",
    """WITH jobs AS (SELECT o_orderkey AS job, o_orderdate AS created, o_orderkey % 5 AS attempts,
      CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS state, o_orderdate + INTERVAL 2 DAY AS lease FROM orders),
    tiers AS (SELECT *, CASE WHEN state = 'queued' AND attempts < 3 THEN 1 WHEN state = 'running' AND lease < TIMESTAMP '1996-01-01' AND attempts < 3 THEN 2
      WHEN state = 'running' AND lease < TIMESTAMP '1996-01-01' THEN 3 END AS tier FROM jobs)
    SELECT job, tier, CASE WHEN tier = 3 THEN 'failed' ELSE 'claim' END AS action FROM tiers WHERE tier IS NOT NULL ORDER BY tier, created, job LIMIT 100""",
)
def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred steps of a job queue: queued jobs, then expired leases, then leases without attempts left."""
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    jobs = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("created"), (F.col("o_orderkey") % 5).alias("attempts"), state.alias("state")
    )
    expired = (F.col("state") == "running") & (F.col("created") + F.expr("interval 2 days") < F.lit("1996-01-01").cast("timestamp_ntz"))
    tier = F.when((F.col("state") == "queued") & (F.col("attempts") < 3), 1).when(expired & (F.col("attempts") < 3), 2).when(expired, 3)
    ranked = jobs.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "created", "job").limit(100)
    return ranked.select("job", "tier", F.when(F.col("tier") == 3, "failed").otherwise("claim").alias("action"))


@query(
    "retention_purge",
    """SELECT o_orderstatus AS state, count(*) AS purged, max(o_orderkey) AS last_job FROM orders
    WHERE o_orderstatus IN ('F', 'P') AND o_orderdate + INTERVAL 2 DAY < TIMESTAMP '1995-06-01' GROUP BY o_orderstatus""",
)
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended jobs whose time to be kept is over, by state."""
    over = F.col("o_orderdate") + F.expr("interval 2 days") < F.lit("1995-06-01").cast("timestamp_ntz")
    rows = read(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P") & over)
    return rows.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("purged"), F.max("o_orderkey").alias("last_job"))


@query(
    "rate_limit_keys",
    """SELECT event_type, count(*) AS hits, count(DISTINCT k) AS keys, min(k) AS least_key FROM (
      SELECT event_type, 'rl:' || event_type || ':' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS k FROM events) GROUP BY event_type""",
)
def rate_limit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter keys of the limiter, from a digest of the actor, by type of event."""
    key = F.concat(F.lit("rl:"), "event_type", F.lit(":"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16))
    rows = read(spark, sf_dir, "events").select("event_type", key.alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("hits"), F.count_distinct("k").alias("keys"), F.min("k").alias("least_key"))
