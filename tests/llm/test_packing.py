import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Reader

from scholarlens.llm.common import stored
from scholarlens.llm.packing import ROWS, MetAgain, Tokenizer, _Search, best_fit, pack, packed

READER = Reader.from_file(public_tokenizers.path("word_bpe_49k.json"))
OURS = Tokenizer()


def ids_of(text):
    return READER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t ́'sß<|>")), max_size=60))
def test_word_by_word_ids_equal_whole_text_ids(text):
    assert np.frombuffer(OURS(text.encode()), "<u4").tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["a<|endoftext|>b c", "<|startoftext|> x <|startoftext|>", "don't I'll 12 Σας ΟΔΟΣ", "x y <| z"])
def test_special_strings(text):
    assert np.frombuffer(Tokenizer()(text.encode()), "<u4").tolist() == ids_of(text)


def test_every_character_that_is_split_here():
    for at in range(0x260):
        text = f"a{chr(at)}b {chr(at)} x'{chr(at)}s {chr(at)}\u0307 9{chr(at)}--'t"
        assert np.frombuffer(OURS(text.encode()), "<u4").tolist() == ids_of(text), hex(at)


def test_many_blocks_come_near_the_lower_bound(spark):
    """Whatever the lengths, blocks of 40 pieces need at most 3 % more sequences, and 2, than any packing."""
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 60, 1500), rng.integers(20, 50, 1500), rng.choice([35, 33, 34, 51], 1500)):
        texts = [(k, "a " * (n - 1)) for k, n in enumerate(lengths.tolist())]
        rows = packed(spark.createDataFrame(texts, "doc_id long, text string"), capacity=100, block=40).collect()
        bound = max(-(-int(lengths.sum()) // 100), int((lengths > 50).sum()))
        whole = len(pack(lengths, 100))
        assert len({r.sequence_id for r in rows}) <= max(1.03 * bound, 1.03 * whole) + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_packs_are_whole_and_no_worse_than_best_fit(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    bins = pack(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 100 for b in bins)
    assert len(bins) <= len(best_fit(lengths, 100))


def test_search_empties_a_bin_by_a_swap():
    lengths = np.array([50, 30, 20, 40, 40, 20])
    search = _Search([[0, 1], [3, 4], [2, 5]], lengths, 100)
    squares = sum(f * f for f in search.fill.values())
    bins = search.run()
    assert len(bins) == 2 and squares < sum(int(lengths[b].sum()) ** 2 for b in bins)


def test_search_stops_where_nothing_can_be_saved():
    assert len(pack(np.full(9, 51), 100)) == 9
    assert pack(np.empty(0, np.int64), 100) == []


def check(rows, texts, capacity):
    expect = {}
    for doc_id, text in texts:
        ids = np.array([*ids_of(text), 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expect.setdefault((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())), []).append(1)
    got = {}
    sequences = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == expect
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packed(docs, block=60).collect()
    count = check(rows, texts, 4096)
    assert count <= -(-sum(r.length for r in rows) // 4096) + 2


def test_edge_cases(spark):
    texts = [(1, None), (1, None), (None, "a"), (2, ""), (3, "word " * 40), (3, "word " * 40), (4, "x")]
    frame = spark.createDataFrame([Row(text=t, offset=9, doc_id=i) for i, t in texts], "text string, offset int, doc_id long")
    check(packed(frame, capacity=16, block=3).collect(), texts, 16)
    assert packed(frame.limit(0)).collect() == []


def test_words_that_occur_once_are_not_held(monkeypatch):
    monkeypatch.setattr(MetAgain, "MARKS", 1 << 12)
    tokens = Tokenizer()
    words = [f"{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}q" for k in range(5000)]
    for word in words:
        assert np.frombuffer(tokens(f"{word} the".encode()), "<u4").tolist() == ids_of(f"{word} the")
    assert b"the" in tokens.words
    assert len(tokens.words) + len(tokens.runs) < len(words) // 2


def test_few_texts_go_to_python_at_once(spark):
    """The batch is bounded while pieces are made, and the session's own bound holds again after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert max(r.n for r in stored(sizes, "sizes", batch=ROWS).collect()) <= ROWS
    assert spark.conf.get(key) == before
    assert packed(rows).count() == 3000
