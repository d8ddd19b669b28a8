"""Registered queries of the training-data operators, and their SQL oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.llm.centroids import CLUSTERS, DIM, ROUNDS, SEED, clustered
from scholarlens.llm.common import table
from scholarlens.llm.decontam import leaks
from scholarlens.llm.html_text import extracted
from scholarlens.llm.media import media_columns
from scholarlens.llm.near_dup import near_duplicates
from scholarlens.llm.packing import packed
from scholarlens.llm.quality import quality
from scholarlens.llm.ranked_search import ranked
from scholarlens.llm.secrets import secret_digests
from scholarlens.llm.suffix_lm import lm_scores
from scholarlens.llm.toxicity import toxicity
from scholarlens.llm.url_lists import derived_events, listed_captures
from scholarlens.llm.warc import archived


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the dated list entries that held on the day of its fetching.

    The tables have no list and no day, so both are derived from the pages: the day
    from the page's number, the list from the hosts (see derived_events).
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", (F.col("page_id") * 7 % 366).cast("long"))
    return listed_captures(captures, derived_events(pages))


OP2_SQL = r"""
WITH captures AS (
  SELECT page_id, url, CAST(page_id * 7 % 366 AS BIGINT) AS fetched_at,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), digits AS (
  SELECT host, instr('0123456789abcdef', substr(md5(host), 1, 1)) - 1 AS a,
    (instr('0123456789abcdef', substr(md5(host), 2, 1)) - 1) * 20 AS day,
    instr('0123456789abcdef', substr(md5(host), 3, 1)) - 1 AS c
  FROM (SELECT DISTINCT host FROM captures WHERE host <> '')
), intervals AS (
  SELECT host AS entry, 'spam' AS category, day AS valid_from,
    CASE WHEN c < 8 THEN day + 90 END AS valid_to FROM digits WHERE a < 4
  UNION ALL SELECT host, 'spam', day + 150, NULL FROM digits WHERE a < 4 AND c < 8
  UNION ALL SELECT host || '/en/', 'adult', day, NULL FROM digits WHERE a BETWEEN 4 AND 7
), parts AS (
  SELECT page_id, url, fetched_at, host, string_split(host, '.') AS labels,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM captures
), wanted AS (
  SELECT DISTINCT page_id, unnest(list_concat(
    list_transform(range(1, greatest(2, len(labels))), lambda i: array_to_string(labels[i:], '.')),
    list_transform(range(1, len(segments) + 1), lambda i: host || '/' || array_to_string(segments[1:i], '/') || '/'))) AS entry
  FROM parts WHERE host <> ''
), found AS (
  SELECT w.page_id, list_sort(list(DISTINCT i.category || ':' || i.entry)) AS names
  FROM wanted w JOIN captures p ON p.page_id = w.page_id
  JOIN intervals i ON i.entry = w.entry AND p.fetched_at >= i.valid_from
    AND (i.valid_to IS NULL OR p.fetched_at < i.valid_to)
  GROUP BY w.page_id
)
SELECT c.page_id, c.url, c.fetched_at, CAST(coalesce(len(names), 0) AS BIGINT) AS n_entries,
  coalesce(array_to_string(names, ','), '') AS entries, names IS NOT NULL AS blocked
FROM captures c LEFT JOIN found f ON f.page_id = c.page_id
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and linked secrets of every document."""
    return secret_digests(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a packed sequence."""
    return packed(table(spark, sf_dir, "documents"))


def op7_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that leaks into it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media columns of every document, stored as images in tar shards."""
    return media_columns(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH counts AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), wanted AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, corpus GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding after five rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    nearest = """SELECT v.vec_id, v.q, min((list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), c.cluster)) AS best
      FROM vectors v, {c} c GROUP BY v.vec_id, v.q"""
    steps = [
        f"""vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
      WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIM})""",
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS cluster, q FROM
      (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, q FROM vectors ORDER BY h LIMIT {CLUSTERS}))""",
    ]
    for k in range(ROUNDS):
        steps += [
            f"a{k} AS ({nearest.format(c=f'c{k}')})",
            f"""m{k} AS (SELECT cluster, list(x ORDER BY i) AS q FROM (SELECT cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM
          (SELECT best[2] AS cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster)""",
            f"c{k + 1} AS (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m ON m.cluster = c.cluster)",
        ]
    steps.append(f"placed AS (SELECT vec_id, best[2] AS cluster, CAST(best[1] AS BIGINT) AS distance FROM ({nearest.format(c=f'c{ROUNDS}')}))")
    return f"""WITH {", ".join(steps)}
    SELECT p.vec_id, p.cluster, p.distance, CAST(sum(p.distance) OVER (PARTITION BY p.cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(p.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM placed p JOIN c{ROUNDS} c ON c.cluster = p.cluster"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to WARC archives and read back."""
    read = archived(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
seen AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
    min(page_id) OVER (PARTITION BY sha256(html)) AS first FROM payloads
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM seen
"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filters": op2_url_filters,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality": op4_quality,
    "op5_minhash_near_dup": op5_minhash_near_dup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_lm": op7_suffix_lm,
    "op8_decontamination": op8_decontamination,
    "op9_media_columns": op9_media_columns,
    "op10_html_extraction": op10_html_extraction,
    "op11_ranked_search": op11_ranked_search,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_warc": op13_warc,
}

ORACLES: dict[str, str] = {
    "op2_url_filters": OP2_SQL, "op11_ranked_search": OP11_SQL, "op12_centroid_clusters": _op12_sql(), "op13_warc": OP13_SQL,
}
