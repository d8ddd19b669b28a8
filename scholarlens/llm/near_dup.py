"""Near-duplicate documents: one-permutation hashing, banded buckets and star-shaped candidates.

Plan
----
1. One pass over the texts gives each document's set size, a digest of the set
   and bucket keys from a one-permutation sketch with optimal
   densification. Equal sets collapse to their least document by the digest.
2. Buckets with two or more sets get a star: the most central document (the one
   with the most company over all its buckets) is tied to every other member,
   so a bucket of m sets gives m - 1 candidate edges. Each document is first held
   against its best centre alone, on the full sets; the links are contracted to
   components, and only buckets that stay split get their whole star confirmed.
3. What a star can miss, a link between two members that are in different
   components, is found past the centre: such members share an element that it lacks,
   or lack one that it has, so an equality join on those elements finds all of them.

The threshold is a parameter, ``PERCENT`` unless given. Links of that similarity share
a bucket but for a chance of ``MISSED`` at most (32 bands of 6 bins at 85 %, 38 of 5 at
80 %), so the components are those of all links.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.llm.common import (
    TEXT_ROWS,
    WordMemo,
    byte_texts,
    hash_word,
    mapped,
    mixed,
    stored,
    window_hashes,
)
from scholarlens.llm.components import components

BINS, WIDTH, PERCENT = 192, 5, 85
MISSED, DRAWS = 3e-7, 64

_EDGES = np.array([-(-i * 2**64 // BINS) for i in range(BINS)], dtype=np.uint64)


def donors(draws: int) -> np.ndarray:
    """For each bin the bins from which it may borrow, in order: a fixed random function of bin and attempt."""
    at = np.arange(draws * BINS, dtype=np.uint64).reshape(draws, BINS).T
    return (mixed(at + np.uint64(0x51ED27)) % np.uint64(BINS)).astype(np.int64)


_DONORS = donors(DRAWS)


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word runs; of the whole sequence if it is shorter; none without words."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a non-empty sorted set: the least hash of each bin, empty bins densified.

    An empty bin draws bins by a random function of its own number until it hits
    one that is not empty, independently of its neighbours, and takes its value.
    """
    starts = np.searchsorted(shingles, _EDGES)
    ends = np.append(starts[1:], len(shingles))
    full = starts < ends
    values = np.zeros(BINS, np.uint64)
    values[full] = shingles[starts[full]]
    empty = np.flatnonzero(~full)
    if len(empty):
        table, draws = _DONORS, DRAWS
        hits = full[table[empty]]
        while not hits.any(axis=1).all():
            draws *= 4
            table = donors(draws)
            hits = full[table[empty]]
        values[empty] = values[table[empty, hits.argmax(axis=1)]]
    return values


def rows_of(percent: int) -> int:
    """Bins of a band: the most with which links of ``percent`` share no bucket with a chance of MISSED at most."""
    fit = [r for r in range(1, BINS + 1) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED]
    return max(fit, default=1)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """Bucket keys (documents x bands) of a stack of sketches, ``rows`` bins a band; the band's number is part of the key."""
    bands = BINS // rows
    parts = mixed(sketches[:, : bands * rows]).reshape(len(sketches), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
    for r in range(rows):
        key = mixed(key ^ parts[:, :, r])
    return key


class _Words:
    """Word hashes of a text, lower-cased in A-Z and split at ASCII white space."""

    def __init__(self):
        self.memo = None

    def __call__(self, text: bytes) -> np.ndarray:
        if self.memo is None:
            self.memo = WordMemo(hash_word)
        return self.memo.values_of(text.lower().split(), np.uint64)


class _Features:
    def __init__(self, percent: int):
        self.words, self.rows = _Words(), rows_of(percent)

    def __call__(self, batch):
        sizes, digests, keys = [], [], []
        for text in byte_texts(batch, "text"):
            shingles = shingle_set(self.words(text))
            sizes.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            keys.append(sketch(shingles) if len(shingles) else None)
        filled = [k for k in keys if k is not None]
        rows = iter(band_keys(np.stack(filled), self.rows).view(np.int64) if filled else ())
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": sizes,
            "set_key": digests,
            "bands": [None if k is None else next(rows) for k in keys],
        }


class _Sets:
    def __init__(self):
        self.words = _Words()

    def __call__(self, batch):
        return {
            "doc": batch.column("doc"),
            "shingles": [shingle_set(self.words(text)).tobytes() for text in byte_texts(batch, "text")],
        }


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


class _Measure:
    """Overlap and link of the pairs; for each the elements that two linked members of c's star must share one of.

    A partner y of x has at least ``percent`` / 100 of x, of which c has ``both`` at most,
    so the rest lies in what c lacks; all but (rest - 1) of those elements, in any order
    that x and y have in common, must hold one that y has too.

    A partner that shares nothing with x that c lacks shares with it what both lack of c.
    Where a and b elements of c are missing in x and y, which have p and q others, the
    common part is c - a - b + i, and a link needs (100 + percent) * i of at least
    100 * (a + b) + percent * (p + q) - (100 - percent) * c. This is above 0 for all y
    if x is not linked to c, and all but (i - 1) of what is missing in x must hold one
    that is missing in y too.

    A set of which c has less than ``percent`` / 100 shares an added element with every
    partner, so it needs no missing ones. ``added_keys`` and ``missing_keys`` say how many
    elements that leaves; the elements are left out where no ``keys`` are wanted.
    """

    def __init__(self, percent: int, keys: bool = True):
        self.percent, self.keys = percent, keys

    def __call__(self, batch):
        out = {k: [] for k in ("n_c", "n_x", "both", "linked", "added_size", "added_keys", "missing_keys", "added", "missing")}
        for c, x in zip(batch.column("set_c"), batch.column("set_x")):
            c, x = (np.frombuffer(s.as_buffer(), np.uint64) for s in (c, x))
            at = np.minimum(np.searchsorted(c, x), len(c) - 1)
            hit = c[at] == x
            added = x[~hit]
            lacks = np.ones(len(c), bool)
            lacks[at[hit]] = False
            missing = c[lacks]
            both = len(x) - len(added)
            rest = -(-self.percent * len(x) // 100) - both
            shared = max(1, -(-(100 * len(missing) + self.percent * len(added) - (100 - self.percent) * len(c)) // (100 + self.percent)))
            row = (
                len(c),
                len(x),
                both,
                100 * both >= self.percent * (len(c) + len(added)),
                len(added),
                max(0, len(added) - max(1, rest) + 1),
                max(0, len(missing) - shared + 1) if rest < 1 else 0,
                added.view(np.int64) if self.keys else None,
                missing.view(np.int64) if self.keys else None,
            )
            for column, value in zip(out.values(), row):
                column.append(value)
        return {"c": batch.column("c"), "x": batch.column("x"), **out}


MEASURED = "c long, x long, n_c long, n_x long, both long, linked boolean, added_size long, added_keys long, missing_keys long, added array<long>, missing array<long>"


def _sizes_allow(a: str, b: str, percent: int) -> str:
    """Similarity is at most the ratio of the sizes."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _enough(both: str, a: str, b: str, percent: int) -> str:
    """An overlap of ``both`` links sets of sizes ``a`` and ``b``."""
    return f"{100 + percent} * ({both}) >= {percent} * ({a} + {b})"


def measured(pairs: DataFrame, sets: DataFrame, percent: int, keys: bool = True) -> DataFrame:
    """The pairs (c, x) held against each other on their full sets; see MEASURED."""
    found = (
        pairs.join(sets.select(F.col("doc").alias("c"), F.col("shingles").alias("set_c")), "c")
        .join(sets.select(F.col("doc").alias("x"), F.col("shingles").alias("set_x")), "x")
        .select("c", "x", "set_c", "set_x")
    )
    return mapped(found, _Measure(percent, keys), MEASURED)


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (c, x) that are linked, as edges (a, b)."""
    return measured(pairs, sets, percent, keys=False).filter("linked").select(F.col("c").alias("a"), F.col("x").alias("b"))


def _placed(rows: DataFrame, components_of: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of column ``node`` (itself if it has no link) as column ``name``."""
    known = components_of.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def _between(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs (c, x) of the members of a star in different components that may still be linked.

    At least one of a pair is outside the centre's component, so the two share an added
    or a missing element; see _Measure. Elements are taken in order of how many members
    of the star have them, the rarest first, and those that one component alone has, which
    no pair can share, before all others. Missing elements are needed for pairs that share
    no added one, whose overlap therefore lies in the centre.
    """
    fields, key = ["x", "n_x", "both", "added_size", "component"], ["c", "more", "e"]
    sides = [
        F.struct(F.lit(True).alias("more"), F.col("added_keys").alias("take"), F.col("added").alias("es")),
        F.struct(F.lit(False).alias("more"), F.col("missing_keys").alias("take"), F.col("missing").alias("es")),
    ]
    halves = stars.select("c", *fields, "centre_component", F.explode(F.array(*sides)).alias("s")).filter("s.take > 0")
    every = halves.select("c", *fields, "centre_component", "s.more", "s.take", F.explode("s.es").alias("e"))
    shared = every.groupBy(*key).agg(F.count("*").alias("holders"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    shared = shared.filter("lo < hi").select(*key, "holders")
    order = Window.partitionBy("c", "x", "more").orderBy(F.coalesce("holders", F.lit(0)), "e")
    keyed = every.join(shared, key, "left").withColumn("place", F.row_number().over(order))
    keyed = keyed.filter("place <= take and holders is not null").select("c", *fields, "centre_component", "more", "e")
    left = keyed.filter("component <> centre_component").select(*key, *[F.col(f).alias(f"{f}_1") for f in fields])
    right = keyed.select(*key, *[F.col(f).alias(f"{f}_2") for f in fields])
    apart = F.expr("component_1 <> component_2") & F.expr(_sizes_allow("n_x_1", "n_x_2", percent))
    share = "least(both_1, both_2) + if(more, least(added_size_1, added_size_2), 0)"
    both = left.join(right, key).filter(apart & F.expr(_enough(share, "n_x_1", "n_x_2", percent)))
    return both.select(F.least("x_1", "x_2").alias("c"), F.greatest("x_1", "x_2").alias("x")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked when their sets of 5-word shingles (words lower-cased in
    A-Z, split at ASCII white space) have similarity of at least ``percent`` %;
    ``component_id`` is the least doc_id reachable over links.

    Null or blank texts have an empty set and stand alone. A null doc_id gets a
    null component and is kept. Rows that repeat a doc_id share a component; where
    their texts differ, the least set by its bytes confirms links. Other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    features = stored(
        mapped(docs, _Features(percent), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketches", TEXT_ROWS
    )
    named = features.filter("doc_id is not null and n_shingles > 0")
    one = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x"))
    one = one.select(F.col("x.doc_id").alias("doc"), F.explode("x.bands").alias("bucket"))
    sized = one.groupBy("bucket").agg(F.count("*").alias("company")).filter("company > 1")
    members = stored(one.join(sized, "bucket"), "buckets")
    central = members.groupBy("doc").agg(F.sum("company").alias("rank"))
    texts = docs.withColumnRenamed("doc_id", "doc").join(central.select("doc"), "doc", "left_semi")
    sets = mapped(texts, _Sets(), "doc long, shingles binary").groupBy("doc").agg(F.min("shingles").alias("shingles"))
    sets = stored(sets, "sets", TEXT_ROWS)

    # each member against the best centre of its buckets
    centre = members.join(central, "doc").groupBy("bucket").agg(F.max(F.struct("rank", -F.col("doc"))).alias("best"))
    stars = stored(members.select("bucket", "doc").join(centre, "bucket"), "stars")
    best = stars.groupBy("doc").agg(F.max("best").alias("best"))
    pairs = best.select((-F.col("best.col2")).alias("c"), F.col("doc").alias("x")).filter("c <> x")
    links = stored(links_of(pairs, sets, percent), "links", TEXT_ROWS)
    placed = stored(components(links), "components")

    # buckets that are still split, each member against the bucket's own centre
    open_stars = _placed(stars, placed, "doc", "component")
    split = open_stars.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_stars = open_stars.join(split.filter("lo < hi").select("bucket"), "bucket")
    pairs = open_stars.select((-F.col("best.col2")).alias("c"), F.col("doc").alias("x")).filter("c <> x").distinct()
    held = stored(measured(pairs, sets, percent), "measured", TEXT_ROWS)
    links = links.unionByName(held.filter("linked").select(F.col("c").alias("a"), F.col("x").alias("b")))
    placed = stored(components(links), "components")

    # members of one star that could still be linked past their centre
    held = _placed(_placed(held, placed, "x", "component"), placed, "c", "centre_component")
    rest = stored(_between(held, percent), "rest")
    known = placed.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = stored(components(known.unionByName(links_of(rest, sets, percent))), "components")

    groups = named.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    # a table of its own, so that a key with very many copies may be split in the join
    groups = stored(_placed(groups, final, "node", "component").select("set_key", "component"), "groups")
    rows = features.select("doc_id", "n_shingles", "set_key")
    joined = rows.filter("set_key is not null").join(groups, "set_key", "left").drop("set_key")
    alone = rows.filter("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.unionByName(alone).select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
