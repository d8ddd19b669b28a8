"""Packing token sequences: best fit, then a local search that swaps documents until bins empty.

Texts become pieces of at most ``CAPACITY`` tokens in one pass. Pieces are dealt
at random into blocks of about ``BLOCK`` pieces, each packed by its own task.
Of the bins that a block leaves well below capacity the emptiest return their pieces,
half of the block's at most, to a pool, which is dealt and packed again in fewer
blocks, until one block is left; every task sees a bounded number of pieces, only
partly filled bins are ever moved, and the rounds are as many as halvings of the input.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import WordMemo, byte_texts, kept_in_worker, mapped, stored

CAPACITY, BLOCK, POOL_BELOW = 4096, 4000, 0.98
END = 1
#: Words and runs of one generation of the memos: at most twice as many are held, some 200 bytes each.
WORDS_KEPT, RUNS_KEPT = 150_000, 150_000
#: Rows whose texts go to Python at once.
ROWS = 500


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return dict(zip(prints, prints)) | {b: 256 + k for k, b in enumerate(others)}


_LETTERS = byte_letters()
#: Runs of ASCII and of Latin letters up to U+024F in a word, as the vocabulary splits it after lower-casing.
_RUN = re.compile(r"[a-zß-öø-\u024f]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")
#: The common case of one run of letters and punctuation after it.
_SIMPLE = re.compile(r"([a-zß-öø-\u024f]+)([!-/:-@\[-`{-~]*)")


class MetAgain(WordMemo):
    """A memo of the words that were met before, as most of a corpus's words occur once.

    The first meeting leaves a mark in a table of bytes, which is emptied when a quarter is used.
    """

    MARKS = 1 << 22

    def __init__(self, make, limit: int):
        super().__init__(make, limit)
        self.met, self.marks = bytearray(self.MARKS), 0

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            place = hash(word) & (self.MARKS - 1)
            if not self.met[place]:
                if self.marks >= self.MARKS // 4:
                    self.met, self.marks = bytearray(self.MARKS), 0
                self.met[place] = 1
                self.marks += 1
                return value
        self.put(word, value)
        return value


class Tokenizer:
    """Token ids of a text as little-endian unsigned 32-bit bytes, from a public vocabulary file.

    The vocabulary never joins text across white space, nor letters with digits or
    punctuation, so the ids of a text are those of its words and a word's those of its
    runs; words and runs are kept from their second time on. Words with other characters
    than those of _RUN are encoded whole.
    """

    def __init__(self, name: str = "word_bpe_49k.json"):
        self.name, self.runs = name, None

    def _open(self):
        import public_tokenizers
        from tokenizers import Tokenizer as Reader

        self.reader = Reader.from_file(public_tokenizers.path(self.name))
        self.pairs = self.reader.model.tokenize
        self.runs = MetAgain(self._run, RUNS_KEPT)
        self.words = MetAgain(self._word, WORDS_KEPT)

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.reader.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.pairs(run)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode().lower()
        if simple := _SIMPLE.fullmatch(text):
            letters, marks = simple.groups()
            return self.runs[letters] + self.runs[marks] if marks else self.runs[letters]
        runs = _RUN.findall(text)
        # what the runs leave out is of another kind
        return b"".join([self.runs[r] for r in runs]) if sum(map(len, runs)) == len(text) else self._whole(word)

    def __call__(self, text: bytes) -> bytes:
        if self.runs is None:
            self._open()
        if b"<|" in text:
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


class _Pieces:
    def __init__(self, tokenizer: str, capacity: int):
        self.tokenizer, self.capacity = tokenizer, capacity

    def __call__(self, batch):
        tokens = kept_in_worker(("tokens", self.tokenizer), lambda: Tokenizer(self.tokenizer))
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        size, end = self.capacity * 4, END.to_bytes(4, "little")
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch, "text")):
            ids = tokens(text) + end
            for piece, at in enumerate(range(0, len(ids), size)):
                part = ids[at : at + size]
                row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                for column, value in zip(out.values(), row):
                    column.append(value)
        return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document (doc_id, text), the end token included.

    Null texts count as empty and give one piece with the end token alone.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return mapped(docs, _Pieces(tokenizer, capacity), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: the longest item first, each into the fullest bin that takes it."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(item)
        else:
            left, b = capacity, len(bins)
            bins.append([item])
        if left > size:
            insort(room, (left - size, b))
    return bins


class _Search:
    """Moves and swaps between underfull bins, each of which raises the sum of squared fills."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = {k: list(b) for k, b in enumerate(bins)}
        self.fill = {k: int(lengths[b].sum()) for k, b in enumerate(bins)}
        self.alone = int((lengths > capacity / 2).sum())
        self.known: dict[int, tuple] = {}

    def excess(self) -> int:
        """How many bins the total length, and the items that cannot share one, would allow to save."""
        return len(self.bins) - max(math.ceil(sum(self.fill.values()) / self.capacity), self.alone)

    def choices(self, k: int) -> tuple[list[tuple], np.ndarray, int]:
        """What bin ``k`` can give: nothing, single items, pairs, one of each length; and their total lengths."""
        if k not in self.known:
            by_length: dict[int, list[int]] = {}
            for i in self.bins[k]:
                by_length.setdefault(int(self.lengths[i]), []).append(i)
            ones = [x[0] for x in by_length.values()]
            sets = [(), *((i,) for i in ones), *combinations(ones, 2), *((x[0], x[1]) for x in by_length.values() if len(x) > 1)]
            sizes = np.array([sum(int(self.lengths[i]) for i in s) for s in sets], np.int64)
            self.known[k] = sets, sizes, 1 + len(ones)
        return self.known[k]

    def exchange(self, source: int, give: tuple, target: int, take: tuple) -> None:
        for k, gone, come in ((source, give, take), (target, take, give)):
            self.bins[k] = [i for i in self.bins[k] if i not in gone] + list(come)
            self.fill[k] += int(sum(self.lengths[i] for i in come) - sum(self.lengths[i] for i in gone))
            self.known.pop(k, None)

    def step(self, source: int) -> bool:
        """The tightest improving exchange of ``source``: moves and one-for-one, then two-for-one, then one-for-two.

        Targets are bins at least as full as the source, so that what they gain raises the squares.
        """
        least = self.fill[source]
        others = [k for k in self.bins if k != source and least <= self.fill[k] < self.capacity]
        if not others:
            return False
        room = np.array([self.capacity - self.fill[k] for k in others])
        found = [self.choices(k) for k in others]
        few = np.concatenate([s[:n] for _, s, n in found])
        few_room = np.repeat(room, [n for *_, n in found])
        sets, sizes, ones = self.choices(source)
        order = np.argsort(-sizes, kind="stable").tolist()
        single = [k for k in order if 1 <= k < ones]
        if self._try(source, sets, sizes, single, others, found, few, few_room, True):
            return True
        if self._try(source, sets, sizes, [k for k in order if k >= ones], others, found, few, few_room, True):
            return True
        every = np.concatenate([s for _, s, _ in found])
        return self._try(source, sets, sizes, single, others, found, every, np.repeat(room, [len(s) for _, s, _ in found]), False)

    def _try(self, source, sets, sizes, gives, others, found, takes, room, first: bool) -> bool:
        for g in gives:
            gain = sizes[g] - takes
            slack = np.where((gain > 0) & (gain <= room), room - gain, self.capacity)
            k = int(slack.argmin())
            if slack[k] < self.capacity:
                ends = np.cumsum([n if first else len(s) for _, s, n in found])
                b = int(np.searchsorted(ends, k, "right"))
                at = k - (int(ends[b - 1]) if b else 0)
                self.exchange(source, sets[g], others[b], found[b][0][at])
                return True
        return False

    def run(self) -> list[list[int]]:
        """Work on the emptiest bins, as many as could be saved, until they are empty or stuck."""
        stuck: set[int] = set()
        while (excess := self.excess()) > 0:
            emptiest = sorted(self.bins, key=lambda k: (self.fill[k], k))[:excess]
            source = next((k for k in emptiest if k not in stuck), None)
            if source is None:
                break
            if not self.step(source):
                stuck.add(source)
            elif not self.bins[source]:
                del self.bins[source], self.fill[source]
                self.known.pop(source, None)
        return list(self.bins.values())


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers for items of 1 to ``capacity`` tokens: best fit, then the local search."""
    return _Search(best_fit(lengths, capacity), lengths, capacity).run()


def _packer(capacity: int, turn: int):
    def run(pdf):
        lengths = pdf["length"].to_numpy()
        sequence, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for number, members in enumerate(pack(lengths, capacity)):
            ends = np.cumsum(lengths[members])
            sequence[members], offset[members] = number, ends - lengths[members]
            fill[members] = ends[-1]
        # only bins below the bound go on, the emptiest first, with half of the block's pieces at most
        fills, held = np.unique(sequence, return_counts=True)
        fills[sequence] = fill
        order = np.argsort(fills, kind="stable")
        goes = np.zeros(len(fills), bool)
        goes[order] = (np.cumsum(held[order]) <= len(pdf) / 2) & (fills[order] < POOL_BELOW * capacity)
        # the turn, the block and the bin in it make a number of their own
        base = (turn << 58) + (int(pdf["block"].iloc[0]) << 26)
        return pdf.drop(columns=["block"]).assign(sequence_id=base + sequence, offset=offset, goes=goes[sequence])

    return run


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row a
    piece. Documents above the capacity are cut into full pieces and a rest. Null
    texts count as empty; an empty text is its end token. Null ids and repeated rows
    are packed like any other row; other columns are ignored.
    """
    made = pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id())
    made = stored(made, "pieces", batch=ROWS)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [
        made.filter(F.col("length") == capacity)
        .withColumn("sequence_id", -1 - F.col("row"))
        .withColumn("offset", F.lit(0).cast("long"))
        .select(columns)
    ]
    pool, turn = made.filter(F.col("length") < capacity), 0
    while (count := pool.count()) > 0:
        blocks = math.ceil(count / block)
        dealt = pool.withColumn("block", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(blocks)))
        schema = f"{PIECES}, row long, sequence_id long, offset long, goes boolean"
        fitted = stored(dealt.groupBy("block").applyInPandas(_packer(capacity, turn), schema), "packed")
        if blocks == 1:
            done.append(fitted.select(columns))
            break
        done.append(fitted.filter("not goes").select(columns))
        pool, turn = fitted.filter("goes").drop("sequence_id", "offset", "goes"), turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
