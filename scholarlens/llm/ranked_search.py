"""Ranked lexical search: dense tiles of item weights times dense tiles of document impacts.

The score of a document for an item is a sum over the item's terms of an integer
weight of the term times an integer impact of the term in the document. Written as
matrices that is (documents x terms) @ (terms x items), which BLAS multiplies.

* Items are taken in blocks of ITEMS items; a block's vocabulary, and no other
  word, is numbered from 0. One pass over the texts leaves, for each document, its
  length and the counts of the block's terms (a table in the shared folder).
* The table gives the corpus's statistics: every task adds up its own document
  frequencies, Spark sums what the tasks have.
* A second pass multiplies tiles of DOCS documents by WIDTH terms with tiles of
  WIDTH terms by the block's items in float64. All factors are integers and a tile's
  sums stay below 2 ** 53, so each product is exact in any order of summation;
  sums over more tiles are 64-bit integers.
* A tile's leaders of an item are all documents that reach its k-th best score, then
  the k first of these by score and id; so ties never depend on the order of rows.
  A task hands on k rows an item, which meet in two rounds of ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.llm.common import byte_texts, dropped, mapped, stored

#: Items of a block, and pairs of an item and a term that a block has on average at most.
ITEMS, PAIRS = 1024, 1 << 18
#: Documents and terms of a tile.
DOCS, WIDTH = 512, 4096
#: Impacts are below 1,000,000; a weight below this keeps a tile's sum exact: 4096 * 2e6 * 1e6 < 2 ** 53.
MOST_WEIGHT = 2_000_000
#: Tasks whose leaders are ranked together first.
TOGETHER = 64

#: All bytes of terms (digits, letters, all of other characters) as they are but for A-Z; other bytes part terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return text.translate(_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    m = 50 + (50 * n * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _ItemTerms:
    def __call__(self, batch: pa.RecordBatch) -> dict:
        found = [list(set(terms_of(t))) for t in byte_texts(batch, "text")]
        return {"item_id": batch.column("item_id"), "terms": [[w.decode() for w in x] for x in found]}


class _Count:
    """Length and counts of known terms of every document."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary

    def __call__(self, batch: pa.RecordBatch) -> dict:
        get, lengths, sizes, terms, counts = self.vocabulary.get, [], [0], [], []
        for text in byte_texts(batch, "text"):
            words = terms_of(text)
            lengths.append(len(words))
            known = np.array([k for k in map(get, words) if k is not None], np.int32)
            term, tf = np.unique(known, return_counts=True)
            terms.append(term)
            counts.append(tf)
            sizes.append(sizes[-1] + len(term))
        offsets = pa.array(sizes, pa.int32())
        return {
            "doc_id": batch.column("doc_id"),
            "n": lengths,
            "terms": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms), pa.int32())),
            "counts": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts), pa.int64())),
        }


def _spread(terms: int):
    """Documents of each term that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(terms, np.int64)
        for batch in batches:
            found += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        (met,) = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(found[met])], names=["term", "df"])

    return run


class _Leaders:
    """The best documents of each item that a task has seen: (score, id, has no id), ids ascending on ties and null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(items)]

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """``scores`` has a row for each document of a tile and a column for each item."""
        least = np.ones(scores.shape[1], np.int64)
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        for j, had in enumerate(self.best):
            bar = max(least[j], had[0][-1] if len(had[0]) == self.k else 1)
            (rows,) = np.nonzero(scores[:, j] >= bar)
            if len(rows):
                new = (scores[rows, j], ids[rows], none[rows])
                s, i, m = (np.concatenate(x) for x in zip(had, new))
                order = np.lexsort((i, m, -s))[: self.k]
                self.best[j] = s[order], i[order], m[order]

    def rows(self, items: np.ndarray) -> pa.RecordBatch:
        s, i, m = (np.concatenate(x) for x in zip(*self.best))
        item = np.repeat(items, [len(x[0]) for x in self.best])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(i, mask=m), pa.array(s)], names=["item", "doc_id", "score"])


def _multiply(item: np.ndarray, term: np.ndarray, weights: np.ndarray, n_docs: int, total: int, k: int):
    """Scores of all documents for the items of a block, given its pairs (item, term) and the weight of each term."""
    items, width = int(item.max()) + 1, min(WIDTH, len(weights))

    def item_tile(first: int) -> np.ndarray:
        tile, here = np.zeros((width, items)), (term >= first) & (term < first + width)
        tile[term[here] - first, item[here]] = weights[term[here]]
        return tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, kept = _Leaders(items, k), item_tile(0)
        for batch in batches:
            n = batch.column("n").to_numpy()
            ids = batch.column("doc_id")
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            doc = np.repeat(np.arange(len(n)), sizes)
            terms = batch.column("terms").flatten().to_numpy()
            impact = impacts(batch.column("counts").flatten().to_numpy(), n[doc], n_docs, total) if len(doc) else np.empty(0)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for at in range(0, len(n), DOCS):
                to = min(at + DOCS, len(n))
                mine = slice(ends[at], ends[to])
                d, t, x = doc[mine] - at, terms[mine], impact[mine]
                scores = np.zeros((to - at, items), np.int64)
                for first in range(0, len(weights), width):
                    here = (t >= first) & (t < first + width)
                    tile = np.zeros((to - at, width))
                    tile[d[here], t[here] - first] = x[here]
                    scores += (tile @ (kept if len(weights) == width else item_tile(first))).astype(np.int64)
                leaders.add(scores, ids[at:to], none[at:to])
        yield leaders.rows(np.arange(items, dtype=np.int32))

    return run


def _first(rows: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("item", *more).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, terms: list[list[str]], k: int) -> DataFrame | None:
    """(item, rank, doc_id, score) of the items of one block, given the terms of each; None if no document has a term."""
    vocabulary: dict[str, int] = {}
    item = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
    term = np.array([vocabulary.setdefault(w, len(vocabulary)) for x in terms for w in x], np.int64)
    counted = mapped(docs, _Count({w.encode(): i for w, i in vocabulary.items()}), "doc_id long, n long, terms array<int>, counts array<long>")
    counted = stored(counted, "search-counts")
    n_docs, total = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    top = None
    if n_docs:
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.select("terms").mapInArrow(_spread(len(df)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        assert weights.max() < MOST_WEIGHT
        led = counted.mapInArrow(_multiply(item, term, weights, n_docs, total, k), "item int, doc_id long, score long")
        near = _first(led.withColumn("part", F.floor(F.spark_partition_id() / TOGETHER)), k, "part")
        top = stored(_first(near.drop("part", "rank"), k).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-top")
    dropped(counted)
    return top


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    A term is a run of ASCII digits, ASCII letters (A-Z lower-cased) and all characters
    beyond ASCII. Documents of score 0 are not ranked; equal scores go by ascending
    doc_id, null last. Null and empty texts have no term: such documents count nowhere
    and such items have no rows, as have all items if no document has a term. Each row
    of ``docs`` is a document of its own, also with an id that repeats; rows of
    ``items`` with one id (null is one, too) are one item that has the terms of all.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = mapped(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), _ItemTerms(), "item_id long, terms array<string>")
    asked = asked.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    asked = stored(asked.filter(F.size("terms") > 0), "search-items")
    count, pairs = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(-(-count // ITEMS), -(-pairs // PAIRS))
    out = None
    for block in range(blocks):
        # the items of a block, by their ids' hash; an item is never split
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        for at in range(0, len(mine), ITEMS):
            part = mine[at : at + ITEMS]
            top = _block(rows, [r.terms for r in part], k)
            if top is not None:
                names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], "item int, item_id long")
                # at most ITEMS rows
                top = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
                out = top if out is None else out.unionByName(top)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
