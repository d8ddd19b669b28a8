import re
from itertools import combinations

import numpy as np
from pyspark.sql import Row

from scholarlens.llm.components import components
from scholarlens.llm.near_dup import near_duplicates, overlap, sketch


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, set()).add(i)
    pairs = {p for ids in index.values() for p in combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def check(spark, rows):
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expect = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expect
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_against_brute_force_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows)


def family(seed, n, words=120, edits=4):
    """A base and copies with 0 to ``edits`` words replaced, in shuffled order."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    out = []
    for k in range(n):
        copy = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            copy[at] = f"x{rng.integers(0, 40)}"
        out.append(" ".join(copy))
    return out


def test_families_with_links_past_the_centre(spark):
    texts = [t for seed in range(4) for t in family(seed, 60)]
    order = np.random.default_rng(9).permutation(len(texts))
    check(spark, [(int(k), texts[k]) for k in order])


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A b"), (6, "a b c"), (7, "ü b c d e f"), (8, "Ü b c d e f"),
        (9, "w " * 50_000), (10, "w " * 60_000), (11, "one two three four five"), (12, "one two  three four FIVE"),
    ]
    check(spark, rows)


def test_null_ids_repeated_rows_and_other_columns(spark):
    data = [Row(text="a b c d e f", doc_id=None, n=1), Row(text="a b c d e f", doc_id=3, n=2), Row(text="a b c d e f", doc_id=3, n=2),
            Row(text="a b c d e f", doc_id=7, n=2)]
    frame = spark.createDataFrame(data, "text string, doc_id long, component_id long")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(frame).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("7", 3, False), ("None", None, True)]
    assert near_duplicates(frame.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 12, dtype=np.uint64)
    a, b = np.unique(pool[:11]), np.unique(pool[1:])
    trials = []
    for k in range(200):
        key = np.uint64(rng.integers(1, 2**62) | 1)
        trials.append((sketch(np.unique(a * key)) == sketch(np.unique(b * key))).mean())
    assert abs(np.mean(trials) - overlap(a, b) / 12) < 0.05


def test_pipeline_stage_against_brute_force_at_80(spark):
    import corpus_pipeline

    texts = [t for seed in range(4) for t in family(seed, 40, edits=6)]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    between = 0
    for a, b in combinations(range(len(texts)), 2):
        share = 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        between += 80 <= share < 85
        if share >= 80:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    alone = {i for i, (_, component) in brute(list(enumerate(texts))).items() if i == component}
    assert between and kept == {root(i) for i in range(len(texts))} and kept < alone


def test_bands_miss_few_links():
    from scholarlens.llm.near_dup import BINS, rows_of

    assert rows_of(85) == 6 and rows_of(80) == 5
    assert all((1 - (p / 100) ** rows_of(p)) ** (BINS // rows_of(p)) <= 3e-7 for p in (75, 80, 85, 90))


def test_linked_members_of_a_star_share_a_key():
    """Of two linked sets of which one is not linked to the centre, the keys past the centre have one in common."""
    import pyarrow as pa

    from scholarlens.llm.near_dup import _Measure

    rng = np.random.default_rng(8)
    met = 0
    for _ in range(4000):
        c = rng.choice(200, rng.integers(1, 60), replace=False)
        x = np.concatenate([c[rng.random(len(c)) < rng.uniform(0.5, 1)], 200 + rng.choice(60, rng.integers(0, 9), replace=False)])
        y = x.copy()
        y = np.unique(np.concatenate([y[rng.random(len(y)) < 0.97], rng.choice(c, rng.integers(0, 3))]))
        c, x, y = (np.sort(s).astype(np.uint64) for s in (c, x, y))
        if not len(x) or not len(y):
            continue
        batch = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([1, 2]), pa.array([c.tobytes()] * 2, pa.binary()), pa.array([x.tobytes(), y.tobytes()], pa.binary())],
                                           names=["c", "x", "set_c", "set_x"])
        out = _Measure(85)(batch)
        linked = 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
        if linked and not out["linked"][0]:
            met += 1
            keys = {n: [set(out[n][k].tolist()[: out[f"{n}_keys"][k]]) for k in (0, 1)] for n in ("added", "missing")}
            assert any(a & b for a, b in keys.values())
    assert met > 300
