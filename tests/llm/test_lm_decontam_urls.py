import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from scholarlens.llm.common import hash_word
from scholarlens.llm.decontam import leaks
from scholarlens.llm.queries import op2_url_filters
from scholarlens.llm import suffix_lm
from scholarlens.llm.suffix_lm import Places, Words, lm_scores
from scholarlens.llm.url_lists import listed_captures, validity
from tests.oracles import oracle_rows, rows_of


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(texts):
    training = Counter(t for i, x in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(training.values()), len(training)
    rows = []
    for i, x in texts:
        own = tokens(x)
        held = None if i is None else zlib.crc32(str(i).encode()) % 7 == 2
        rows.append((i, held, len(own), sum(t in training for t in own), n, sum(math.log10((training[t] + 1) / (n + v + 1)) for t in own)))
    return rows


def check_scores(got, texts):
    expect = sorted(brute(texts), key=str)
    got = sorted(got, key=lambda r: str((r.doc_id, r.held_out, r.n_tokens)))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [g[:5] for g in got] == [e[:5] for e in expect]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in expect], rel=1e-9)


def test_counts_and_base_scores_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm_scores(docs).collect()
    check_scores(got, texts)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_tree(texts, least=suffix_lm.LEAST, depth=suffix_lm.DEPTH, gain=suffix_lm.GAIN, discount=suffix_lm.DISCOUNT):
    """Scores of texts by the same tree, with counts in dictionaries and without hashes, heads or buckets."""
    training = [tokens(x) for i, x in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(t for words in training for t in words)
    n = sum(count.values())
    fresh = (sum(c == 1 for c in count.values()) + 1) / (n + 2)
    share = (1 - fresh) / max(1, n)
    often = [hash_word(w.encode()) for w, c in count.items() if w is not None and c >= least] + [hash_word(b" ")] * (count[None] >= least)
    log = max(16, math.ceil(math.log2(64 * max(1, len(often)))))
    bits = {h >> (64 - log) for h in often}

    def class_of(w):
        return "end" if w is None else w if hash_word(w.encode()) >> (64 - log) in bits else 0

    root = Counter()
    for w, c in count.items():
        root[class_of(w)] += c * share
    root[0] += fresh
    after = {}

    def contexts(classes, at):
        """Contexts before a place by length, newest word first."""
        out, run = [], ()
        for back in range(1, depth + 1):
            if at - back < 0 or classes[at - back] in (0, "end"):
                break
            run = (*run, classes[at - back])
            out.append(run)
        return out

    for words in training:
        classes = [class_of(w) for w in words]
        for at, s in enumerate(classes):
            for run in contexts(classes, at):
                after.setdefault(run, Counter())[s] += 1
    known = {}

    def judged(run):
        """(total, entries, mass left) of a context that stays, else None."""
        if run not in known:
            total, entries = sum(after.get(run, {}).values()), {s: c for s, c in after.get(run, {}).items() if c >= suffix_lm.ENTRY}
            known[run] = None
            if total >= least and entries:
                q = {s: chance(run[:-1], s) for s in entries}
                rest = total - sum(entries.values())
                nats = sum(c * math.log(c / (total * q[s])) for s, c in entries.items())
                nats += rest * math.log(rest / (total * max(1 - sum(q.values()), 1e-12))) if rest else 0
                if nats >= gain * len(entries):
                    known[run] = total, entries, (rest + discount * len(entries)) / total
        return known[run]

    def chance(run, s):
        if not run:
            # an unknown word that the bit table takes for a symbol has no class to share: only the masses left count
            return root[s] or 1.0
        below, kept = chance(run[:-1], s), judged(run)
        if kept is None:
            return below
        total, entries, left = kept
        return (entries[s] - discount if s in entries else 0) / total + left * below

    scores = {}
    for i, x in texts:
        words = tokens(x)
        classes = [class_of(w) for w in words]
        score = 0.0
        for at, (w, s) in enumerate(zip(words, classes)):
            run = contexts(classes, at)
            own = count[w] * share if w in count else fresh
            score += math.log10(own / (root[s] or 1.0) * chance(run[-1] if run else (), s))
        scores.setdefault(i, []).append(score)
    return scores, chance, root, sum(x is not None for x in known.values())


def test_scores_equal_those_of_a_plain_tree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    expect, chance, root, kept = plain_tree(texts)
    got = {r.doc_id: r.score for r in lm_scores(docs).collect()}
    assert kept > 50
    assert all(got[i] == pytest.approx(expect[i][0], rel=1e-6, abs=1e-5) for i, _ in texts)
    assert sum(chance((), s) for s in root) == pytest.approx(1)


@pytest.mark.parametrize("head", [(50, 400_000, 2_500_000), (150_000, 20, 100), (7, 0, 0)])
def test_scores_do_not_depend_on_what_travels_to_the_tasks(spark, sf_dir, monkeypatch, head):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expect = {r.doc_id: (r.score, r.base_score) for r in lm_scores(docs).collect()}
    for name, value in zip(("HEAD", "HEAD_CONTEXTS", "HEAD_ENTRIES"), head):
        monkeypatch.setattr(suffix_lm, name, value)
    rows = lm_scores(docs).collect()
    check_scores(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert all((r.score, r.base_score) == pytest.approx(expect[r.doc_id], rel=1e-9) for r in rows)


def test_hot_contexts_are_dealt_and_give_equal_scores(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [(k, " ".join(words[(k * j * j + j) % 5] for j in range(40))) for k in range(60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    expect, *_ = plain_tree(texts)
    for hot in (1000, 10**9):
        monkeypatch.setattr(suffix_lm, "HOT", hot)
        got = {r.doc_id: r.score for r in lm_scores(frame).collect()}
        assert all(got[i] == pytest.approx(expect[i][0], rel=1e-6) for i, _ in texts)


@pytest.mark.parametrize("classes", [3, 1000])
def test_buckets_that_are_too_full_are_dealt_and_give_equal_scores(spark, monkeypatch, classes):
    rng = np.random.default_rng(5)
    texts = [(k, " ".join(f"w{min(int(x), 30)}" for x in rng.geometric(0.15, 60))) for k in range(60)]
    texts += [(100 + k, " ".join(markov(1)[0].split()[: 20 + k])) for k in range(20)]
    expect, _, _, kept = plain_tree(texts)
    monkeypatch.setattr(suffix_lm, "BUCKET", 40)
    monkeypatch.setattr(suffix_lm, "HEAD_CLASSES", classes)
    got = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert kept > 5
    assert all(got[i] == pytest.approx(expect[i][0], rel=1e-6) for i, _ in texts)


def test_words_of_texts_and_their_ends():
    import pyarrow as pa

    texts = ["", " a  B\x0bb ", "É\u00a0x\x1cy z\n", "  "]
    words = Words(pa.array(texts))
    want = [w for t in texts for w in [*t.encode().lower().split(), b" "]]
    assert [words.hashes[k] for k in words.at] == [hash_word(w) for w in want]
    assert words.ends.tolist() == [k for k, w in enumerate(want) if w == b" "]


def test_places_of_hashes():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**64, 1000, np.uint64))
    wanted = np.concatenate([keys[::3], rng.integers(0, 2**64, 500, np.uint64)])
    table = {int(k): n for n, k in enumerate(keys)}
    assert Places(keys).of(wanted).tolist() == [table.get(int(w), -1) for w in wanted]
    assert Places(keys[:0]).of(wanted).tolist() == [-1] * len(wanted)


def test_lm_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "A b A b"), (3, "A b A b"), (None, "a"), (14, "w " * 30_000), (21, "ü Ü a")]
    frame = spark.createDataFrame([Row(score="s", text=t, doc_id=i) for i, t in texts], "score string, text string, doc_id long")
    check_scores(lm_scores(frame).collect(), texts)
    assert lm_scores(frame.limit(0)).collect() == []
    only = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    check_scores(lm_scores(spark.createDataFrame(only, "doc_id long, text string")).collect(), only)


ITEM = "If Anna has 12 apples and gives 5 kg to Boris, how many apples does Anna keep for the winter feast?"
OTHER = "A completely different question about rivers and the names of towns that lie along their banks."


def found(spark, *texts):
    docs = spark.createDataFrame([Row(item_id="x", text=t, doc_id=k) for k, t in enumerate(texts)], "item_id string, text string, doc_id long")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "two words")], "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in leaks(docs, bench).collect())


def test_template_leaks(spark):
    changed = ITEM.replace("Anna", "Clara").replace("Boris", "Dora").replace("12", "80").replace("5 kg", "7 lb")
    mixed = changed.replace("Clara", "Emil", 1)
    assert found(
        spark,
        f"Intro text here. {ITEM} And so on.",
        f"so that {changed} more words",
        OTHER.upper(),
        "nothing of the kind " * 50,
        ITEM[:40],
        None,
        "",
        "just two words here",
        "filler " * 60_000 + OTHER,
    ) == [(0, 1), (1, 1), (2, 2), (7, 5), (8, 2)]
    assert found(spark, mixed) in ([], [(0, 1)])


def test_inconsistent_slots_are_no_leak(spark):
    item = "Then Anna met Anna and Anna saw Anna while Anna told Anna that Anna knew Anna well enough"
    names = iter(["Bob", "Carl", "Dan", "Eve", "Fay", "Gus", "Hal", "Ian"])
    other = re.sub("Anna", lambda _: next(names), item)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("Anna", "Zoe")), (2, other)], "doc_id long, text string")
    assert [r.doc_id for r in leaks(docs, bench).collect()] == [1]


def test_leaks_of_all_documents_against_brute_force(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in bench.collect()}
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in " ".join(re.findall(r"\w+", r.text.lower()))}
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert whole and whole <= got and len(got - whole) <= 3
    assert leaks(docs, bench.limit(0)).collect() == [] and leaks(docs.limit(0), bench).collect() == []


def test_url_query_equals_oracle(spark, sf_dir):
    from scholarlens.llm.queries import ORACLES

    folder = sf_dir.replace("0.001", "0.01")
    assert rows_of(op2_url_filters(spark, folder)) == oracle_rows(ORACLES["op2_url_filters"], folder)


def brute_list(url, at, events):
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
    if not m or at is None:
        return set()
    host = m[1].lower()
    path = re.match(r"^[^:]+://[^/?#]*([^?#]*)", url)[1]
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    keys = {".".join(labels[k:]) for k in range(max(1, len(labels) - 1))} | {host + "/" + "/".join(parts[: k + 1]) + "/" for k in range(len(parts))}
    out = set()
    for entry, category in {(e[0], e[1]) for e in events if None not in (e[0], e[2], e[3])}:
        known = [(e[2], not e[3]) for e in events if e[:2] == (entry, category) and None not in e[2:] and e[2] <= at]
        if known and not max(known)[1] and entry.lower() in keys:
            out.add(f"{category or ''}:{entry.lower()}")
    return out


def test_captures_against_brute_force(spark):
    rng = np.random.default_rng(2)
    hosts = ["a.example.org", "example.org", "b.a.example.org", "Other.NET", "x"]
    urls = [f"http://u@{h}:80/{p}?q#f" for h in hosts for p in ("", "en/1", "en/", "de/x/y")] + [None, "no url", "http://", "mailto:a@b.c"]
    keys = ["example.org", "a.example.org", "other.net", "example.org/en/", "b.a.example.org/de/x/", "x"]
    events = [(keys[rng.integers(6)], ["spam", "adult", None][rng.integers(3)], int(rng.integers(0, 50)), bool(rng.integers(2))) for _ in range(80)]
    events += [(None, "spam", 1, True), ("x", "spam", None, True), ("x", "spam", 3, None), events[0]]
    captures = [(u, int(rng.integers(0, 60))) for u in urls for _ in range(6)] + [(urls[0], None), (urls[1], 5), (urls[1], 5)]
    frame = spark.createDataFrame([Row(entry=k, url=u, fetched_at=t) for k, (u, t) in enumerate(captures)], "entry long, url string, fetched_at long")
    listed = spark.createDataFrame(events, "entry string, category string, at long, listed boolean")
    got = listed_captures(frame.withColumnRenamed("entry", "category"), listed).collect()
    assert len(got) == len(captures)
    for r in got:
        want = brute_list(r.url, r.fetched_at, events)
        assert set(filter(None, r.entries.split(","))) == want and r.n_entries == len(want) and r.blocked == bool(want)
    assert listed_captures(frame.withColumnRenamed("entry", "k"), listed.limit(0)).filter("blocked").collect() == []
    spans = validity(listed).collect()
    assert all(s.valid_to is None or s.valid_from < s.valid_to for s in spans)


def markov(n, seed=4, oldest=3):
    """Texts in which what follows is told by the three words before, or by two of them if ``oldest`` is 0."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        words = [int(x) for x in rng.integers(0, 4, 3)]
        while len(words) < 60:
            words.append((words[-3] * oldest + words[-2] + (rng.random() < 0.1)) % 4)
        texts.append(" ".join(f"m{w}" for w in words))
    return texts


def test_contexts_grow_with_the_corpus_and_reach_past_two_words(spark):
    from scholarlens.llm.suffix_lm import grown, word_counts

    # the phrase is 20 of more than 450,000 tokens, far below a share of 5e-5
    rare = ["alpha beta gamma delta"] * 20
    filler = [" ".join(f"f{(k * 7 + j * j) % 900}" for j in range(450)) for k in range(1000)]
    texts = spark.createDataFrame([(t,) for t in markov(60) + rare + filler], "text string")
    words = word_counts(texts)
    tokens = sum(r.n for r in words.collect())
    tree = grown(texts, words, tokens, 1 / tokens)
    alpha = suffix_lm.value_of(tree.symbols(np.array([hash_word(b"alpha")], np.uint64)))
    assert [r.total for r in tree.contexts.filter(f"ctx = {alpha.view(np.int64)[0]}").collect()] == [20]


def test_scores_do_not_depend_on_the_head_of_contexts(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(markov(150))), "doc_id long, text string")
    whole = {r.doc_id: r.score for r in lm_scores(frame).collect()}
    for contexts, entries in ((3, 8), (0, 0), (12, 1000)):
        monkeypatch.setattr("scholarlens.llm.suffix_lm.HEAD_CONTEXTS", contexts)
        monkeypatch.setattr("scholarlens.llm.suffix_lm.HEAD_ENTRIES", entries)
        assert {r.doc_id: r.score for r in lm_scores(frame).collect()} == pytest.approx(whole, rel=1e-9)


def test_words_look_for_few_entries_at_a_time_and_scores_stay(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(markov(150))), "doc_id long, text string")
    tokens, seen, past = 150 * 61, [], suffix_lm.past_head

    def counted(scored, rest, buckets):
        seen.append(scored.selectExpr("sum(length(pending) / 8)").first()[0])
        return past(scored, rest, buckets)

    whole = {r.doc_id: r.score for r in lm_scores(frame).collect()}
    monkeypatch.setattr(suffix_lm, "past_head", counted)
    monkeypatch.setattr(suffix_lm, "HEAD_ENTRIES", 5)
    assert {r.doc_id: r.score for r in lm_scores(frame).collect()} == pytest.approx(whole, rel=1e-9)
    # a slice looks for a share of the words, however many there are in all
    assert len(seen) > 2 and sum(seen) > tokens / 2 and max(seen) < tokens / 2


def test_the_entries_that_occur_most_travel(spark, monkeypatch):
    from scholarlens.llm.suffix_lm import Head, grown, word_counts

    texts = spark.createDataFrame([(t,) for t in markov(150)], "text string")
    words = word_counts(texts)
    tree = grown(texts, words, 150 * 61, 1e-4)
    n = [(x.n, x.entries) for x in tree.mapped(suffix_lm._Times, "n long, entries long").collect()]
    monkeypatch.setattr(suffix_lm, "HEAD_ENTRIES", 12)
    head = Head(tree)
    inside = sum(e for k, e in n if k >= head.often)
    assert 0 < inside <= 12 and len(head.codes.keys) == inside
    assert head.looked == sum(k * e for k, e in n if k < head.often) and not head.whole


def test_scores_of_a_third_order_source_equal_those_of_a_plain_tree(spark):
    texts = list(enumerate(markov(80)))
    expect, _, _, kept = plain_tree(texts)
    rows = lm_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert kept > 20 and all(r.score == pytest.approx(expect[r.doc_id][0], rel=1e-6) for r in rows)


def pairs(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in leaks(docs, bench).collect())


def test_whole_items_leak_whatever_stands_before_them_and_in_any_case(spark):
    items = ["What is the capital of France?", "Which planet has the most moons today?", "Is water wet?",
             "Then Paul and Mary walked with Peter to the house of Anna in Berlin before the sun set", "die Straße nach Köln ist heute gesperrt"]
    texts = ["Question 4\nWhat is the capital of France?", "a quiz asked, Which planet has the most moons today?", "they asked, Is water wet? and left",
             items[3].lower(), items[3].upper(), items[4].upper(), "What is the price of bread?"]
    assert pairs(spark, items, texts) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 4)]


def test_templates_past_line_breaks_and_first_names(spark):
    items = ["Anna has 12 apples and gives five of them to Boris who eats two at home"]
    other = items[0].replace("Anna", "Clara").replace("Boris", "Dora").replace("12", "80")
    assert pairs(spark, items, [f"so that {other}", f"a heading\n{other}", other.replace("to Dora", "to\nDora")]) == [(0, 0), (1, 0), (2, 0)]


def test_entries_in_any_case_are_one(spark):
    events = spark.createDataFrame([("Example.org", "spam", 1, True), ("example.ORG", "spam", 5, False)], "entry string, category string, at long, listed boolean")
    assert [tuple(r) for r in validity(events).collect()] == [("example.org", "spam", 1, 5)]


def test_captures_with_clashing_columns(spark):
    frame = spark.createDataFrame([Row(url="http://a.b/x", fetched_at=5, Entries="old", blocked=7, found_url="u", found_at="t", found_names="n", w=1)])
    listed = spark.createDataFrame([Row(entry="a.b", category="spam", at=1, listed=True)])
    got = listed_captures(frame, listed)
    assert got.columns == ["url", "fetched_at", "found_url", "found_at", "found_names", "w", "n_entries", "entries", "blocked"]
    assert [tuple(r) for r in got.collect()] == [("http://a.b/x", 5, "u", "t", "n", 1, 1, "spam:a.b", True)]


def test_leaks_with_null_and_repeated_ids(spark):
    text = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    docs = spark.createDataFrame([Row(doc_id=d, text=t, item_id=9) for d, t in ((None, text), (1, f"so {text} again"), (1, text), (2, "nothing of it"), (3, None))], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([Row(item_id=i, text=t) for i, t in ((None, text), (5, text), (5, text), (6, None))], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in leaks(docs, items).collect()), key=repr)
    assert got == sorted([(d, i) for d in (None, 1, 1) for i in (None, 5, 5)], key=repr)
    assert leaks(docs, items.limit(0)).collect() == [] and leaks(docs.limit(0), items).collect() == []
