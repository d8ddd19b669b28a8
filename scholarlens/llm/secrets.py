"""Secret scans: strict patterns, and weak parts reported only where complementary parts meet.

One pass over the texts finds the strict spans (assign, access, hex) and the
weak parts of a credential: identifiers, secrets and endpoints that mean nothing
alone. The linking is an interval join within a text: the scope of a part is its
span widened by ``SCOPE`` code points, and a weak part is reported when parts of
the roles it lacks meet its scope. Whether such a part exists is read from the
nearest end before and the nearest start after it, so a text with many parts
never produces pairs of parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.llm.common import TEXT_ROWS, byte_texts, free_name, mapped, stored

SCOPE = 300
#: Kinds in the order in which equal starts are listed; the strict ones come first.
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
STRICT = KINDS[:3]
#: What each kind is in a credential.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "key": "secret", "endpoint": "endpoint"}

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
IDENTIFIER = re.compile(
    r"""(?ai:\b(?:client|access|account|application|app|tenant)[_ -]?(?:key[_ -]?)?id|\buser(?:name)?|\blogin)["']?\x20*[:=]\x20*["']?([A-Za-z0-9][A-Za-z0-9@._+-]{3,})"""
)
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?ai:\b(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+)""")
_WORDS = re.compile(rb"password|passwd|secret|token|api_?key")
_IDS = re.compile(rb"id|user|login")


def _marks(members: str) -> bytes:
    return bytes(49 if chr(c) in members else 48 for c in range(256))


_HEX = _marks("0123456789abcdef")
_LONG = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _strong(text: str) -> bool:
    """Does a long run look random: letters of both cases and digits?"""
    return any(c.isdigit() for c in text) and any(c.islower() for c in text) and any(c.isupper() for c in text)


def spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Strict spans and weak parts of a UTF-8 text as (kind, start, end) in code points, end exclusive.

    The byte tests only save the patterns a text in which they can match nothing.
    """
    lower, found, text = raw.lower(), [], None
    has_words = _WORDS.search(lower) is not None
    has_hex = raw.translate(_HEX).find(b"1" * 32) >= 0
    has_access = b"AKIA" in raw
    has_long = raw.translate(_LONG).find(b"1" * 20) >= 0
    has_url = b"://" in raw
    # a weak part counts only beside a secret or an identifier, so texts without any strict or long run have none
    if not (has_words or has_hex or has_access or has_long):
        return found
    text = raw.decode()
    if has_words:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if has_access:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if has_hex:
        found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    strict = sorted(x[1:] for x in found)
    starts = [a for a, _ in strict]
    reach = list(accumulate((b for _, b in strict), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before == 0 or reach[before - 1] <= start

    if _IDS.search(lower):
        found += [("identifier", *m.span()) for m in IDENTIFIER.finditer(text) if free(*m.span())]
    if has_long:
        found += [("key", *m.span()) for m in KEY.finditer(text) if _strong(m[0]) and free(*m.span())]
    if has_url:
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text) if free(*m.span())]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batch):
    rows = [spans(text) for text in byte_texts(batch, "text")]
    return {
        "doc_id": batch.column("doc_id"),
        "text_key": batch.column("text_key"),
        "parts": [[{"start": a, "rank": KINDS.index(k), "kind": k, "end": b} for k, a, b in row] for row in rows],
    }


PARTS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p.kind, p.start.cast("string"), p.end.cast("string"))), ",")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts of (row, p) that complementary parts of their row meet within ``scope``."""
    role = F.create_map(*[F.lit(x) for kind in ROLES.items() for x in kind])[F.col("p.kind")]
    parts = parts.withColumn("role", role)
    by = Window.partitionBy("row").orderBy("p.start", "p.rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for name in ("identifier", "secret", "endpoint"):
        mine = F.col("role") == name
        last = F.max(F.when(mine, F.col("p.end"))).over(before)
        following = F.min(F.when(mine, F.col("p.start"))).over(after)
        near[name] = F.coalesce(F.col("p.start") - last <= scope, F.lit(False)) | F.coalesce(
            following - F.col("p.end") <= scope, F.lit(False)
        )
    parts = parts.select("row", "p", "role", *[v.alias(k) for k, v in near.items()])
    met = (
        F.when(F.col("role") == "identifier", F.col("secret"))
        .when(F.col("role") == "secret", F.col("identifier") | F.col("endpoint"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return parts.filter(~F.col("p.kind").isin(*STRICT)).filter(met).select("row", "p")


def secret_spans(docs: DataFrame, scope: int = SCOPE, keep_key: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, base and reported, arrays of spans in order of start.

    ``base`` has the strict spans alone, ``reported`` the weak parts that were linked
    as well; ``keep_key`` adds text_key, xxhash64 of the text. Null texts count as empty and have no span; repeated rows are scanned
    one by one; null ids are kept; other columns are ignored.
    """
    docs = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key")
    )
    scanned = mapped(docs, _scan, f"doc_id long, text_key long, parts {PARTS}")
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "spans", TEXT_ROWS)
    weak = F.exists("parts", lambda p: p["rank"] >= len(STRICT)) & (F.size("parts") > 1)
    linked = _linked(scanned.filter(weak).select("row", F.explode("parts").alias("p")), scope)
    extra = linked.groupBy("row").agg(F.collect_list("p").alias("extra"))
    base = F.filter("parts", lambda p: p["rank"] < len(STRICT))
    joined = scanned.join(extra, "row", "left")
    reported = F.when(F.col("extra").isNull(), base).otherwise(F.array_sort(F.concat(base, F.col("extra"))))
    columns = ["doc_id", "text_key"] if keep_key else ["doc_id"]
    return joined.select(*columns, base.alias("base"), reported.alias("reported"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts, a digest of the strict spans and all spans as text, one row for each row of ``docs``."""
    found = secret_spans(docs)
    kinds = F.transform("base", lambda p: p["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in STRICT]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("reported")).alias("spans"),
        F.exists("reported", lambda p: p["rank"] >= len(STRICT)).alias("has_linked"),
    )


def masked(text: str, cuts: list[tuple[int, int]], mark: str) -> str:
    """``text`` with each run of overlapping cuts replaced by one ``mark``."""
    out, at, open_to = [], 0, -1
    for start, end in sorted(cuts):
        if start >= open_to:
            out += [text[at:start], mark]
        open_to = at = max(open_to, end)
    return "".join([*out, text[at:]])


def _mask(mark: str, name: str):
    def run(batch):
        texts = batch.column("text").to_pylist()
        for k, cuts in enumerate(batch.column(name).to_pylist()):
            if cuts and texts[k] is not None:
                texts[k] = masked(texts[k], [(c["start"], c["end"]) for c in cuts], mark)
        return {c: texts if c == "text" else batch.column(c) for c in batch.schema.names if c != name}

    return run


def redacted(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; all rows and columns stay, n_chars follows the text.

    Spans come back by doc_id and a digest of the text, so rows that share an id but
    not a text keep their own, and a null id is an id like others; null texts stay as they are.
    """
    columns = docs.columns
    own_key, own_id, name = (free_name(n, columns) for n in ("text_key", "found_id", "cuts"))
    found = secret_spans(docs.select("doc_id", "text"), keep_key=True).filter(F.size("reported") > 0)
    cuts = F.transform("reported", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    found = found.select(F.col("doc_id").alias(own_id), F.col("text_key").alias("spans_key"), cuts.alias(name))
    found = found.dropDuplicates([own_id, "spans_key"])
    keyed = docs.withColumn(own_key, F.xxhash64("text"))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found[own_id]) & (keyed[own_key] == found["spans_key"]), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = mapped(joined.select(*[keyed[c] for c in columns], found[name]), _mask(mark, name), schema, TEXT_ROWS)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out
