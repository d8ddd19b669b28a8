"""Streaming queries, run over all given events at once so that they can be held against a batch oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.plans.events import DAY
from scholarlens.registry import oracle_of, query
from scholarlens.sources.folders import shared_folder
from scholarlens.sources.views import read
from scholarlens.streaming.audit import AGENT, audit_sink, client_address, read_log
from scholarlens.streaming.timed import Leases, Requests, Windows, folded

HOUR = 3_600_000_000


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream."""
    path = f"{sf_dir}/events.parquet"
    # a file stream takes a folder or a pattern, but no single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque?")


def keyed(events: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """(key, event_id, at, kind) of events by user; ``kinds`` renames the types, others are none."""
    kind = F.col("event_type")
    if kinds is not None:
        kind = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in kinds.items()])
    return events.select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind"))


@query("stream_window_limiter", oracle_of("fixed_window_limiter"))
def stream_window_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window limiter as a stream with state; what it appends is read back."""
    out = folded(keyed(event_stream(spark, sf_dir)), Windows(DAY * 1_000_000, 3), shared_folder(spark))
    return out.select(
        F.col("key").alias("user_id"), "event_id", (F.col("at") / F.lit(1e6)).alias("opened"), F.col("number").alias("hits"), (F.col("outcome") == "refused").alias("refused")
    )


#: The log of a user as that of a job: who claims it, keeps it, ends it. Other events are none of its own.
LEASED = {"signup": "claim", "view": "beat", "purchase": "done", "error": "error"}
LEASE, TRIES = 12 * HOUR, 3


def _log_sql(kinds: dict[str, str]) -> str:
    names = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in kinds.items())
    return f"""e AS (SELECT user_id, event_id, "at", kind, row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS rn FROM
      (SELECT user_id, event_id, epoch_us(ts) AS "at", CASE event_type {names} END AS kind FROM events) WHERE kind IS NOT NULL)"""


@query(
    "job_leases",
    f"""WITH RECURSIVE {_log_sql(LEASED)},
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS "at", CAST(NULL AS BIGINT) AS until, CAST(0 AS BIGINT) AS attempts,
        '' AS outcome, CAST(0 AS BIGINT) AS number, CAST(NULL AS BIGINT) AS gone_at, CAST(NULL AS BIGINT) AS gone FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, rn, event_id, "at",
        CASE WHEN kind = 'claim' AND u IS NULL THEN "at" + {LEASE} WHEN kind = 'claim' THEN u WHEN u IS NOT NULL AND kind = 'beat' THEN "at" + {LEASE} END,
        CASE WHEN kind = 'claim' AND u IS NULL THEN a + 1 WHEN kind = 'claim' OR u IS NULL OR kind = 'beat' THEN a WHEN kind = 'done' OR a >= {TRIES} THEN 0 ELSE a END,
        CASE WHEN kind = 'claim' AND u IS NULL THEN 'claimed' WHEN kind = 'claim' THEN 'busy' WHEN u IS NULL THEN 'stale' WHEN kind = 'beat' THEN 'extended'
          WHEN kind = 'done' THEN 'done' WHEN a >= {TRIES} THEN 'failed' ELSE 'queued' END,
        CASE WHEN kind = 'claim' AND u IS NULL THEN a + 1 ELSE a END, gone_at, gone
      FROM (SELECT e.*, CASE WHEN s.until > e."at" THEN s.until END AS u, CASE WHEN s.until <= e."at" AND s.attempts >= {TRIES} THEN 0 ELSE s.attempts END AS a,
          CASE WHEN s.until <= e."at" THEN s.until END AS gone_at, CASE WHEN s.until <= e."at" THEN s.attempts END AS gone
        FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)),
    last AS (SELECT user_id, max(rn) AS rn FROM s GROUP BY user_id),
    ends AS (SELECT user_id, gone_at, gone FROM s WHERE gone_at IS NOT NULL UNION ALL
      SELECT s.user_id, s.until, s.attempts FROM s JOIN last ON last.user_id = s.user_id AND last.rn = s.rn WHERE s.until IS NOT NULL)
    SELECT user_id AS job, event_id, "at", outcome, number AS attempt FROM s WHERE rn > 0
    UNION ALL SELECT user_id, NULL, gone_at, CASE WHEN gone >= {TRIES} THEN 'failed' ELSE 'lapsed' END, gone FROM ends""",
)
def job_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of jobs under leases of twelve hours that heartbeats extend; a lease that ends is told by a timer."""
    out = folded(keyed(event_stream(spark, sf_dir), LEASED), Leases(LEASE, TRIES), shared_folder(spark))
    return out.select(F.col("key").alias("job"), "event_id", "at", "outcome", F.col("number").alias("attempt"))


#: The log of a user as that of an applicant.
ASKING = {"signup": "submit", "view": "verify", "purchase": "approve", "error": "deny", "click": "poll"}
CLAIM = 24 * HOUR


@query(
    "request_outcomes",
    f"""WITH RECURSIVE {_log_sql(ASKING)},
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS "at", CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS claim,
        false AS reviewed, CAST(0 AS BIGINT) AS number, '' AS outcome, CAST(NULL AS BIGINT) AS gone_at, CAST(NULL AS VARCHAR) AS gone, CAST(0 AS BIGINT) AS gone_number FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, rn, event_id, "at",
        CASE WHEN fresh THEN CASE WHEN user_id % 2 = 1 THEN 'unverified' ELSE 'pending' END WHEN kind = 'verify' AND st = 'unverified' THEN 'approved'
          WHEN kind = 'approve' AND st = 'pending' THEN 'approved' WHEN kind = 'deny' AND st = 'pending' THEN 'denied'
          WHEN kind = 'poll' AND st = 'approved' AND NOT reviewed AND cl IS NOT NULL THEN 'active' ELSE st END,
        CASE WHEN fresh THEN "at" + {CLAIM} ELSE cl END,
        CASE WHEN fresh OR (kind = 'verify' AND st = 'unverified') THEN false WHEN kind IN ('approve', 'deny') AND st = 'pending' THEN true ELSE reviewed END,
        CASE WHEN fresh THEN number + 1 ELSE number END,
        CASE WHEN fresh THEN 'submitted' WHEN kind = 'submit' AND st IN ('approved', 'active') THEN 'already_active' WHEN kind = 'submit' THEN 'duplicate'
          WHEN kind = 'verify' THEN CASE WHEN st = 'unverified' THEN 'approved_by_system' ELSE 'nothing_to_verify' END
          WHEN kind IN ('approve', 'deny') THEN CASE WHEN coalesce(st, '') <> 'pending' THEN 'not_pending' WHEN kind = 'approve' THEN 'approved' ELSE 'denied' END
          WHEN st IS NULL THEN 'not_found' WHEN st = 'pending' THEN 'pending_manual_review' WHEN st = 'unverified' THEN 'pending_verification'
          WHEN reviewed AND st = 'denied' THEN 'rejected' WHEN reviewed THEN 'approved_sign_in' WHEN st = 'approved' AND cl IS NOT NULL THEN 'verified'
          WHEN st = 'active' THEN 'already_active' ELSE 'expired' END,
        gone_at, gone, number
      FROM (SELECT *, kind = 'submit' AND (st IS NULL OR st IN ('denied', 'expired')) AS fresh FROM
        (SELECT e.*, CASE WHEN s.claim <= e."at" AND s.status = 'unverified' THEN 'expired' ELSE s.status END AS st, CASE WHEN s.claim > e."at" THEN s.claim END AS cl, s.reviewed, s.number,
          CASE WHEN s.claim <= e."at" THEN s.claim END AS gone_at, CASE WHEN s.claim <= e."at" THEN CASE WHEN s.status = 'unverified' THEN 'request_expired' ELSE 'claim_expired' END END AS gone
        FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1))),
    last AS (SELECT user_id, max(rn) AS rn FROM s GROUP BY user_id)
    SELECT user_id AS applicant, event_id, "at", outcome, number AS submission FROM s WHERE rn > 0
    UNION ALL SELECT user_id, NULL, gone_at, gone, gone_number FROM s WHERE gone_at IS NOT NULL
    UNION ALL SELECT s.user_id, NULL, s.claim, CASE WHEN s.status = 'unverified' THEN 'request_expired' ELSE 'claim_expired' END, s.number
      FROM s JOIN last ON last.user_id = s.user_id AND last.rn = s.rn WHERE s.claim IS NOT NULL""",
)
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of applicants' requests for access: submissions, decisions, polls under a claim of a day, and what expires by itself."""
    out = folded(keyed(event_stream(spark, sf_dir), ASKING), Requests(CLAIM), shared_folder(spark))
    return out.select(F.col("key").alias("applicant"), "event_id", "at", "outcome", F.col("number").alias("submission"))


@query(
    "audit_log",
    f"""WITH rows AS (SELECT event_id, CASE WHEN event_id % 89 = 0 THEN '' ELSE event_type END AS event_type, user_id AS actor, event_id % 200 AS target,
      CASE WHEN event_id % 97 <> 0 THEN event_type <> 'error' END AS success, CASE event_id % 13 WHEN 0 THEN '[1]' WHEN 1 THEN NULL WHEN 2 THEN '{{"k": ' ELSE props END AS metadata,
      CASE event_id % 3 WHEN 0 THEN '10.0.0.' || event_id % 7 ELSE '192.168.0.1' END AS ip, substr(repeat('agent ', 20 + event_id % 50), 1, {AGENT}) AS agent, ts FROM events),
    judged AS (SELECT *, CASE WHEN trim(event_type) = '' THEN 'no event type' WHEN success IS NULL THEN 'no outcome' WHEN event_id % 13 = 2 THEN 'metadata are not JSON'
      WHEN event_id % 13 = 0 THEN 'metadata are no object' END AS fault FROM rows)
    SELECT event_id, event_type, CASE WHEN fault IS NOT NULL OR actor IN (SELECT c_custkey FROM customer) THEN actor END AS actor,
      CASE WHEN fault IS NOT NULL OR target IN (SELECT c_custkey FROM customer) THEN target END AS target, success,
      CASE WHEN fault IS NULL THEN coalesce(metadata, '{{}}') ELSE metadata END AS metadata, ip,
      length(CASE WHEN fault IS NULL THEN agent ELSE repeat('agent ', CAST(20 + event_id % 50 AS INT)) END) AS agent_length, fault FROM judged""",
)
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an audit log: what a stream appended, and what it set aside with the reason.

    Types, outcomes and metadata of some events are spoilt by rules on their number;
    customers are the users that actors and targets must be among.
    """
    k = F.col("event_id")
    metadata = F.when(k % 13 == 0, "[1]").when(k % 13 == 2, '{"k": ').when(k % 13 == 1, F.lit(None)).otherwise(F.col("props"))
    forwarded = F.when(k % 3 == 0, F.concat(F.lit("10.0.0."), (k % 7).cast("string"), F.lit(", 10.1.1.1")))
    rows = event_stream(spark, sf_dir).withColumns({"forwarded": forwarded, "remote": F.lit("192.168.0.1")}).select(
        "event_id", F.when(k % 89 == 0, "").otherwise(F.col("event_type")).alias("event_type"), F.col("user_id").alias("actor"), (k % 200).alias("target"),
        F.when(k % 97 != 0, F.col("event_type") != "error").alias("success"), metadata.alias("metadata"), client_address("forwarded", "remote").alias("ip"),
        F.repeat(F.lit("agent "), (k % 50 + 20).cast("int")).alias("agent"), "ts",
    )
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    audit_sink(rows, folder, f"{folder}/state", users)
    both = read_log(spark, folder).withColumn("fault", F.lit(None).cast("string")).unionByName(read_log(spark, folder, faults=True))
    return both.select("event_id", "event_type", "actor", "target", "success", "metadata", "ip", F.length("agent").cast("long").alias("agent_length"), "fault")
