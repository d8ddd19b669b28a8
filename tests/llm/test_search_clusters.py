import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from scholarlens.llm import centroids as cen
from scholarlens.llm import ranked_search as rs
from scholarlens.llm.queries import ORACLES, op11_ranked_search, op12_centroid_clusters
from tests.oracles import oracle_rows, rows_of

LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=50):
    """(item, rank, doc, score) by dictionaries."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in terms if c[w]
            )
            if score:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def search(spark, docs, items, k=50):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in rs.ranked(d, i, k).collect()), key=repr)


def test_search_equals_sql(spark, sf_dir):
    assert rows_of(op11_ranked_search(spark, sf_dir)) == oracle_rows(ORACLES["op11_ranked_search"], sf_dir)


def test_search_in_many_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(rs, "ITEMS", 3)
    monkeypatch.setattr(rs, "PAIRS", 20)
    monkeypatch.setattr(rs, "DOCS", 7)
    monkeypatch.setattr(rs, "WIDTH", 4)
    monkeypatch.setattr(rs, "TOGETHER", 2)
    rng = np.random.default_rng(5)
    word = [f"w{k}" for k in range(30)] + ["é" * 3, "ÀB", "9x"]
    docs = [(int(i), " ".join(rng.choice(word, rng.integers(0, 12)))) for i in rng.permutation(90)]
    # a third of all documents is one text: ties go by id
    docs += [(1000 + k, "w1 w2 w2") for k in range(45)]
    items = [(k, " ".join(rng.choice(word, rng.integers(0, 9)))) for k in range(11)] + [(50, "w1")]
    assert search(spark, docs, items, 6) == brute_search(docs, items, 6)


def test_search_edge_cases(spark):
    docs = [(1, None), (2, ""), (None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (4, "!!! ---"), (5, "x " * 300_000 + "alpha"), (6, "ALPHA\x00Beta_gamma")]
    items = [(1, None), (2, "..."), (3, "Alpha, alpha beta"), (None, "gamma"), (4, "absent"), (5, "alpha"), (5, "gamma")]
    assert search(spark, docs, items) == brute_search(docs, items)
    assert search(spark, [], items) == [] and search(spark, docs, []) == [] and search(spark, docs[:2], items) == []
    clash = spark.createDataFrame([Row(rank="x", score="y", doc_id=k, text=t, n=3, terms="t", item=1) for k, t in enumerate(("a b", "b", "c", "c d"))])
    asked = spark.createDataFrame([Row(item_id=9, text="A", rank=1, doc_id=4, item=2, terms=1)])
    assert [tuple(r)[:3] for r in rs.ranked(clash, asked).collect()] == [(9, 1, 0)]


def test_tile_products_are_exact():
    """The largest tile that the bounds allow: one more would not be told apart by a float beyond 2 ** 53."""
    assert rs.WIDTH * rs.MOST_WEIGHT * 1_000_000 < 2**53
    tile = np.full((1, rs.WIDTH), 999_999.0) @ np.full((rs.WIDTH, 1), rs.MOST_WEIGHT - 1.0)
    assert int(tile[0, 0]) == rs.WIDTH * 999_999 * (rs.MOST_WEIGHT - 1)
    assert rs.impacts(np.array([10**6]), np.array([1]), 1, 10**9)[0] < 1_000_000


def brute_clusters(rows, k, rounds, dim):
    """(id, cluster, distance, inertia of the cluster, of all, digest) by Python integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if all(abs(x) < 1 << 20 for x in r[1])]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, g in groups.items():
            centres[j] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found), key=repr)


def clusters(spark, rows, kind="float", **more):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted((tuple(r) for r in cen.clustered(frame, **more).collect()), key=repr)


def test_clusters_equal_sql(spark, sf_dir):
    assert rows_of(op12_centroid_clusters(spark, sf_dir)) == oracle_rows(ORACLES["op12_centroid_clusters"], sf_dir)


@pytest.mark.parametrize("dim", [1, 5, 6])
def test_clusters_against_brute_force_over_many_shards(spark, monkeypatch, dim):
    monkeypatch.setattr(cen, "SHARD", 16)
    monkeypatch.setattr(cen, "CHUNK", 5)
    rng = np.random.default_rng(dim)
    rows = [(int(i), rng.normal(0, 0.4, dim).round(2).tolist()) for i in rng.permutation(120)]
    # a third is one vector, some are far out, some tie between centroids
    rows += [(200 + i, [0.5] * dim) for i in range(60)] + [(300, [4095.9] * dim), (301, [-4095.9] * dim)]
    got = clusters(spark, rows, "double", k=7, rounds=3, dim=dim)
    assert got == brute_clusters(rows, 7, 3, dim)


def test_cluster_edge_cases(spark):
    rows = [(1, None), (2, []), (3, [0.1, None]), (4, [0.1, float("nan")]), (5, [float("inf"), 0.0]), (6, [1e30, 0.0]), (7, [1.0, 2.0, 3.0])]
    assert clusters(spark, rows, k=3, dim=2) == [] and clusters(spark, [], k=3) == []
    rows += [(8, [0.25, -0.25]), (8, [0.25, -0.25]), (None, [0.5, 0.5]), (9, [0.0, -0.001])]
    got = clusters(spark, rows, k=3, dim=2)
    assert got == brute_clusters([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 3, 5, 2)
    assert clusters(spark, rows, k=50, dim=2) == brute_clusters([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 50, 5, 2)
    clash = spark.createDataFrame([Row(vec_id=1, embedding=[0.5, 0.5], cluster="x", distance="y", q=1, ids=2, n=3)])
    assert cen.clustered(clash, k=1, dim=2).select("cluster", "distance").collect() == [Row(cluster=0, distance=0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda d: st.lists(st.lists(st.integers(-(1 << 20) + 1, (1 << 20) - 1), min_size=d, max_size=d), min_size=1, max_size=12)))
def test_codes_lose_nothing(rows):
    vectors = np.array(rows)
    words, codes = cen.encode(vectors)
    assert (cen.decode(words, codes) == vectors).all()
    assert all(len(np.unique(w, axis=0)) == len(w) for w in words)
    near, least = cen.assigned(words, codes, vectors[:3].astype(np.int64))
    full = ((vectors[:, None] - vectors[None, :3]) ** 2).sum(axis=2)
    assert (near == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
