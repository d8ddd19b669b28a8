"""Language-model scores from a probabilistic suffix tree over words.

Symbols. A word with ``least`` occurrences in the training texts belongs to the class
of its 32-bit hash, all others to class 0. After a context the classes get
probabilities, and a word has its share of its class, so the sum over all words is 1
whatever shares a class. A word's own share comes from its count; words outside the
training vocabulary are one symbol, as in the base score, with the mass of the words
seen once. Words are told apart by 64-bit hashes.

Growing. A context is a run of 1 to ``depth`` symbol words with ``least`` occurrences,
an absolute count, so the tree grows with the corpus. Its entries are the next classes
seen ``entry`` times or more, all of them by default; each gives up ``DISCOUNT`` of its
count, and what all give up, with the counts of rarer next classes, goes to the
distribution of the suffix. A context stays in the tree when its entries and the rest
diverge from its suffix by ``gain`` nats for each entry; others pass on their suffix's
probabilities. The three bounds are arguments of :func:`lm_scores`.

The tree grows level by level. A run can have ``least`` occurrences only if the run
without its newest word, followed by that word, was counted so often at the level
before, so only such runs are counted; a level's counts go when its entries are written.
Words become classes once, which each level reads. Counts go from tasks to buckets of
bounded size as lists by context, where the entries of their suffixes meet them as lists,
too, so a level is counted, summed and tested in one shuffle. What is too frequent for a
bucket is dealt to several, and is tested when the sums of all parts are there. Counts are
made for all texts.
Bit tables of bounded size say which words and runs may have ``least``. Where they err,
a context falls out by its exact count and a word is a symbol of its own.

Scoring. The score of a text is the sum of its words' own shares and, for each
context of the tree before a word, of one number: how the word's entry changes its
probability against the suffix, or the mass left to words without an entry. So the
longest suffix in the tree decides, and each part of the sum may be found anywhere:
the most frequent words, contexts and entries (``HEAD``, ``HEAD_CONTEXTS``,
``HEAD_ENTRIES`` at most) travel to the tasks, all others come by joins on hashes, with
equal scores. Entries and what looks for them meet as lists by bucket of the hash.
Texts are scored in as many slices as keep these lists small against the texts.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import MULTIPLIER, Bits, chunks_of, dropped, hash_word, mapped, mixed, remainder, stored

LEAST, DEPTH, ENTRY, GAIN, DISCOUNT = 10, 4, 1, 8.0, 0.75
HEAD = 150_000
#: Contexts and entries that travel to the tasks.
HEAD_CONTEXTS, HEAD_ENTRIES = 400_000, 500_000
#: Entries outside the head that a slice of texts looks for: about one for so many of all words.
PER_LOOKUP = 4
#: Classes whose probabilities without a context travel to the tasks.
HEAD_CLASSES = 1_000_000
#: Bytes of text counted and scored at once, next classes held by a task before they are summed up, words of a bucket.
COUNT_BYTES, SCORE_BYTES, WAITING, BUCKET = 8_000_000, 3_000_000, 3_000_000, 1_000_000
#: Words of a stored row of classes, and such rows that go to Python at once.
PIECE, ROWS = 250_000, 8
#: A context is hot if it has more than one in so many of all words, and more than BUCKET.
HOT = 10_000
#: Stands for the end of a text; it can be no word.
END = b" "


END_HASH = np.uint64(hash_word(END))


class Words:
    """Words of some texts, lower-cased in A-Z and split at ASCII white space, each text followed by END.

    ``hashes`` has each word once, END last; ``at`` numbers all words in order; ``ends`` are the places of END.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = lists.flatten().dictionary_encode()
        number = found.indices.to_numpy(zero_copy_only=False)
        words = found.dictionary.cast(pa.binary()).to_pylist()
        # white space at the ends of a text gives empty words
        real = number != words.index(b"") if b"" in words else np.ones(len(number), bool)
        before = np.append(0, np.cumsum(real))
        edges = lists.offsets.to_numpy()
        self.ends = before[edges[1:] - edges[0]] + np.arange(len(texts))
        self.at = np.full(len(texts) + int(before[-1]), len(words), np.int64)
        inner = np.ones(len(self.at), bool)
        inner[self.ends] = False
        self.at[inner] = number[real]
        self.hashes = np.fromiter(map(hash_word, words), np.uint64, len(words))
        self.hashes = np.append(self.hashes, END_HASH)

    @property
    def starts(self) -> np.ndarray:
        return np.append(0, self.ends[:-1] + 1)


def _count_words(batches):
    """Counts of words by their hash, summed up in a run of texts."""
    for batch in batches:
        for texts in chunks_of(batch, COUNT_BYTES):
            words = Words(texts)
            n = np.bincount(words.at, minlength=len(words.hashes))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(words.hashes[used].view(np.int64)), pa.array(n[used])], names=["h", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): counts of whole texts' words, ends of texts included, by 64-bit hash."""
    return texts.select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Places:
    """Sorted 64-bit hashes, found by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.starts = keys, None
        self.log = max(1, len(keys).bit_length())

    def __getstate__(self):
        return {**self.__dict__, "starts": None}

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted hash, -1 where there is none."""
        shift = np.uint64(64 - self.log)
        if self.starts is None:
            leading = np.arange((1 << self.log) + 1, dtype=np.uint64)
            self.starts = np.append(np.searchsorted(self.keys >> shift, leading[:-1]), len(self.keys)).astype(np.int32)
        lead = (wanted >> shift).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        out = np.full(len(wanted), -1)
        open_ = np.flatnonzero(at < end)
        at = at[open_]
        while len(open_):
            same = self.keys[at] == wanted[open_]
            out[open_[same]] = at[same]
            at = at + 1
            more = ~same & (at < end[open_])
            open_, at = open_[more], at[more]
        return out


END_CLASS = max(END_HASH >> np.uint64(32), np.uint64(1))


class Symbols:
    """Classes of words by their hashes: 32 bits of it if the bit table has it, else 0."""

    def __init__(self, known: Bits):
        self.known = known

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        symbol = self.known.has(hashes) | (hashes == END_HASH)
        return np.where(symbol, np.maximum(hashes >> np.uint64(32), np.uint64(1)), np.uint64(0))


def value_of(symbols: np.ndarray) -> np.ndarray:
    """What a class adds to the hash of a context, before the power of its place."""
    return mixed(symbols.astype(np.uint64) + np.uint64(0x5851F42D))


#: What the places of a context's words count, from the newest on.
POWERS = np.array([int(MULTIPLIER) ** k % 2**64 for k in range(16)], np.uint64)


def longer(symbols: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Hash of the run of a context and the class after it, as a context: the newest word has the lowest power."""
    return value_of(symbols) + MULTIPLIER * context


def coded(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of a context and the class after it."""
    return mixed(mixed(context) * MULTIPLIER + symbol.astype(np.uint64))


def contexts_of(symbols: np.ndarray, runs: list[Bits]):
    """For each length from 1 on: (places, hashes of the contexts before them), over texts that end in END.

    ``runs`` has the runs that may be contexts of 2, 3 ... words. A context has no word
    of class 0 and no end of a text in it, and its older and newer words are runs as well.
    """
    inner = (symbols != 0) & (symbols != END_CLASS)
    value = value_of(symbols)
    at = np.flatnonzero(inner[:-1]) + 1
    context = value[at - 1]
    linked = np.zeros(len(symbols), bool)
    linked[at] = True
    yield at, context
    for length, known in enumerate(runs, 2):
        # the run without its newest word ends one place before
        more = (at > length - 1) & linked[at - 1]
        at, context = at[more], context[more]
        context = context + POWERS[length - 1] * value[at - length]
        more = known.has(context)
        at, context = at[more], context[more]
        linked = np.zeros(len(symbols), bool)
        linked[at] = True
        yield at, context


CLASSED = "classes array<int>"
LISTED = "bucket int, ctx array<long>, oldest array<int>, kinds array<int>, symbol array<int>, n array<int>"
LEVEL = (
    "hot boolean, ctx array<long>, kinds array<int>, total array<long>, left array<double>, sums array<double>, "
    "symbol array<int>, n array<long>, q array<float>, run array<long>, run_n array<long>, run_suffix array<long>"
)
PARENTS = "bucket int, ctx array<long>, kinds array<int>, symbol array<int>, p array<float>"


#: What contexts and entries are read from; the rest of a level serves the next one.
CONTEXT_COLUMNS = ("ctx", "kinds", "total", "left")
ENTRY_COLUMNS = (*CONTEXT_COLUMNS, "symbol", "n", "q")


def _lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind, copy=False)))


def _flat(table, name: str) -> np.ndarray:
    """All values of a column of lists."""
    column = table.column(name)
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]) if chunks else np.empty(0, np.int64)


def _boundaries(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(ordered)))


class Dealt:
    """Which bucket an entry goes to.

    Contexts go by their suffix, so that they meet its probabilities, those of one word
    by themselves. What follows a hot suffix is dealt by the whole context, and a hot
    context by its next classes, to one part for each BUCKET of its occurrences.
    """

    def __init__(self, level: int, buckets: int, hot: pa.Table, below: Dealt | None):
        """``hot``: run, n and suffix of the contexts of this level that are hot."""
        context = hot.column(0).to_numpy().view(np.uint64)
        order = np.argsort(context)
        self.level, self.buckets, self.places = level, buckets, Places(context[order])
        self.parts = 1 + hot.column(1).to_numpy()[order].astype(np.uint64) // np.uint64(BUCKET)
        self.suffixes = hot.column(2).to_numpy()[order].view(np.uint64)
        self.below = None if below is None else (below.places, below.parts)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)

    def of_part(self, context: np.ndarray, parts: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Buckets of entries of hot contexts."""
        return self.bucket(mixed(context + (mixed(symbol.astype(np.uint64)) % parts + np.uint64(1)) * MULTIPLIER))

    def __call__(self, context: np.ndarray, suffix: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = mixed(context if self.level == 1 else suffix)
        if self.below is not None:
            places, parts = self.below
            place = places.of(suffix)
            at = np.flatnonzero(place >= 0)
            key[at] = mixed(suffix[at] + mixed(context[at]) % parts[place[at]] * MULTIPLIER)
        out, place = self.bucket(key), self.places.of(context)
        at = np.flatnonzero(place >= 0)
        out[at] = self.of_part(context[at], self.parts[place[at]], symbol[at])
        return out

    def copies(self, context: np.ndarray, symbol: np.ndarray):
        """(places, buckets): where the entries of suffixes are looked for; hot ones in more than one bucket."""
        yield slice(None), self.bucket(mixed(context))
        places, parts = self.below
        place = places.of(context)
        for hot in np.unique(place[place >= 0]):
            at = np.flatnonzero(place == hot)
            for part in range(1, int(parts[hot])):
                yield at, self.bucket(mixed(context[at] + np.uint64(part) * MULTIPLIER))
        for own in np.flatnonzero(np.isin(self.suffixes, context)):
            at = np.flatnonzero(context == self.suffixes[own])
            yield at, self.of_part(np.full(len(at), self.places.keys[own]), self.parts[own], symbol[at])


def _classed(symbols: Symbols):
    """Classes of the words of whole texts, each text followed by END_CLASS, some texts a row."""

    def run(batches):
        for batch in batches:
            for texts in chunks_of(batch, COUNT_BYTES):
                words = Words(texts)
                classes = symbols(words.hashes)[words.at].astype(np.uint32).view(np.int32)
                ends = words.ends + 1
                cuts = np.unique(np.append(ends[np.searchsorted(ends, np.arange(PIECE, len(classes), PIECE))], [0, len(classes)]))
                yield pa.RecordBatch.from_arrays([_lists(classes, cuts, np.int32)], names=["classes"])

    return run


def _texts_of(batch) -> list[np.ndarray]:
    return [row.values.to_numpy().view(np.uint32).astype(np.uint64) for row in batch.column("classes") if len(row.values)]


def _count_level(runs: list[Bits], dealt: Dealt):
    """Counts of next classes after contexts of one word more than the last of ``runs`` has, as lists by context for each bucket."""
    level = len(runs) + 1

    def summed(parts):
        context, oldest, symbol = (np.concatenate(x) for x in zip(*parts))
        code = coded(context, symbol)
        order = np.argsort(code)
        first, n = _boundaries(code[order])
        first = order[first]
        context, oldest, symbol = context[first], oldest[first], symbol[first]
        bucket = dealt(context, context - POWERS[level - 1] * value_of(oldest), symbol)
        order = np.lexsort((context, bucket))
        context, oldest, symbol, n, bucket = (x[order] for x in (context, oldest, symbol, n, bucket))
        new = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])))
        used, _ = _boundaries(bucket)
        outer, inner = np.append(np.searchsorted(new, used), len(new)), np.append(used, len(bucket))
        kinds = np.diff(np.append(new, len(context)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[used]),
                _lists(context[new].view(np.int64), outer, np.int64),
                _lists(oldest[new].view(np.int32), outer, np.int32),
                _lists(kinds, outer, np.int32),
                _lists(symbol.view(np.int32), inner, np.int32),
                _lists(n, inner, np.int32),
            ],
            names=["bucket", "ctx", "oldest", "kinds", "symbol", "n"],
        )

    def run(batches):
        held, waiting = [], 0
        for batch in batches:
            for classes in _texts_of(batch):
                *_, (at, context) = contexts_of(classes, runs)
                if len(at):
                    held.append((context, classes[at - level].astype(np.uint32), classes[at].astype(np.uint32)))
                    waiting += len(at)
                if waiting > WAITING:
                    yield summed(held)
                    held, waiting = [], 0
        if held:
            yield summed(held)

    return run


class Root:
    """Probabilities of classes without a context: of the most frequent, which travel to the tasks, and of those that a bucket brings."""

    def __init__(self, classes: np.ndarray, q: np.ndarray, share: float):
        order = np.argsort(classes)
        self.classes, self.q, self.share = classes[order], q[order], share

    def has(self, symbol: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.classes, symbol), len(self.classes) - 1)
        return self.classes[place] == symbol

    def of(self, brought: pa.Table | None, suffix: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        classes, q = self.classes, self.q
        if brought is not None and brought.num_rows:
            classes = np.append(classes, brought.column("class").to_numpy().astype(np.uint64))
            q = np.append(q, brought.column("n").to_numpy() * self.share)
            order = np.argsort(classes)
            classes, q = classes[order], q[order]
        place = np.minimum(np.searchsorted(classes, symbol), len(classes) - 1)
        return np.where(classes[place] == symbol, q[place], np.nan)


class Suffixes:
    """Probabilities after the suffixes of contexts, which a bucket brings."""

    def of(self, brought: pa.Table, suffix: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not brought.num_rows:
            return np.full(len(symbol), np.nan)
        context = np.repeat(_flat(brought, "ctx").view(np.uint64), _flat(brought, "kinds"))
        code = coded(context, _flat(brought, "symbol").view(np.uint32))
        order = np.argsort(code)
        code, p = code[order], _flat(brought, "p")[order]
        wanted = coded(suffix, symbol)
        place = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        return np.where(code[place] == wanted, p[place], np.nan).astype(np.float64)


def _left(total, kinds, seen, expected, nats, gain: float) -> np.ndarray:
    """Mass that contexts leave to their suffix, nan for those that do not stay; ``nats`` without the totals."""
    rest = total - seen
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(rest > 0, rest * np.log(rest / (total * np.maximum(1 - expected, 1e-12))), 0.0)
        stays = (kinds > 0) & (nats - seen * np.log(total) + gap >= gain * kinds)
        return np.where(stays, (rest + DISCOUNT * kinds) / total, np.nan)


def _merge(level: int, least: int, entry: int, gain: float, hot: Places, parents: Root | Suffixes):
    """Sums a bucket's counts and tests its contexts against their suffixes; see LEVEL.

    What occurs less than ``entry`` times and what follows contexts under ``least`` is
    left out. Of hot contexts a bucket has a part; they are tested when all are there.
    """

    def run(counted: pa.Table, brought: pa.Table | None) -> pa.Table:
        kinds, times = _flat(counted, "kinds"), _flat(counted, "n").astype(np.int64)
        of = np.repeat(np.arange(len(kinds)), kinds)
        context, oldest, symbol = _flat(counted, "ctx").view(np.uint64), _flat(counted, "oldest").view(np.uint32), _flat(counted, "symbol").view(np.uint32)
        own, place, same = np.unique(context, return_index=True, return_inverse=True)
        # contexts without their oldest word
        suffix = own - POWERS[level - 1] * value_of(oldest[place])
        total, dealt = np.bincount(same[of], times, len(own)).astype(np.int64), hot.of(own) >= 0
        code = coded(context[of], symbol)
        order = np.argsort(code)
        starts, _ = _boundaries(code[order])
        n = np.add.reduceat(times[order], starts)
        first = order[starts]
        at, symbol = same[of[first]], symbol[first].astype(np.uint64)
        good = (n >= entry) & (dealt[at] | (total[at] >= least))
        n, at, symbol = n[good], at[good], symbol[good]
        more = np.flatnonzero((n >= least) & (symbol != 0) & (symbol != END_CLASS))
        runs = [longer(symbol[more], own[at[more]]).view(np.int64), n[more], longer(symbol[more], suffix[at[more]]).view(np.int64)]
        q = parents.of(brought, suffix[at], symbol)
        order = np.argsort(at, kind="stable")
        order = order[~np.isnan(q[order])]
        n, at, symbol, q = n[order], at[order], symbol[order], q[order]
        kinds, seen, expected = np.bincount(at, minlength=len(own)), np.bincount(at, n, len(own)), np.bincount(at, q, len(own))
        nats = np.bincount(at, n * np.log(n / q), len(own))
        left = _left(total, kinds, seen, expected, nats, gain)
        rows = []
        for some in (False, True):
            which, inner = np.flatnonzero((dealt == some) & (dealt | (kinds > 0))), dealt[at] == some
            sums = np.column_stack([seen[which], expected[which], nats[which]]).ravel() if some else np.empty(0)
            fields = [own[which].view(np.int64), kinds[which], total[which], left[which], sums, symbol[inner].astype(np.uint32).view(np.int32), n[inner], q[inner]]
            rows.append([some, *fields, *([x[:0] for x in runs] if some else runs)])
        types = [np.int64, np.int32, np.int64, np.float64, np.float64, np.int32, np.int64, np.float32, np.int64, np.int64, np.int64]
        rows = rows if len(rows[1][1]) else rows[:1]
        columns = [pa.array([r[0] for r in rows])]
        for k, kind in enumerate(types, 1):
            columns.append(_lists(np.concatenate([r[k] for r in rows]), np.append(0, np.cumsum([len(r[k]) for r in rows])), kind))
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in LEVEL.split(", ")])

    return run


def _alone(merge):
    return lambda counted: merge(counted, None)


class Tested:
    """Reads rows of LEVEL; has the hot contexts of a level, which were tested with all their parts."""

    def __init__(self, level: DataFrame, least: int, gain: float):
        parts = level.filter("hot").select("ctx", "kinds", "total", "sums").toArrow()
        context, at = np.unique(_flat(parts, "ctx").view(np.uint64), return_inverse=True)
        sums = [_flat(parts, "total"), _flat(parts, "kinds"), *_flat(parts, "sums").reshape(-1, 3).T]
        sums = [np.bincount(at, x, len(context)) for x in sums]
        left = _left(*sums, gain)
        self.hot, self.total, self.kinds = Places(context), sums[0].astype(np.int64), sums[1].astype(np.int64)
        self.left = np.where(self.total >= least, left, np.nan)

    def hot_left(self) -> list[tuple[int, float]]:
        """Hot contexts that stay, and what they leave."""
        stays = ~np.isnan(self.left)
        return list(zip(self.hot.keys[stays].view(np.int64).tolist(), np.log10(self.left[stays]).tolist()))

    def contexts(self, batch):
        """(hash, entries here, all entries, total, left) of contexts."""
        context = _flat(batch, "ctx").view(np.uint64)
        own, total, left = _flat(batch, "kinds"), _flat(batch, "total").copy(), _flat(batch, "left").copy()
        kinds, place = own.astype(np.int64), self.hot.of(context)
        at = np.flatnonzero(place >= 0)
        total[at], kinds[at], left[at] = (x[place[at]] for x in (self.total, self.kinds, self.left))
        return context, own, kinds, total, left

    def entries(self, batch):
        """(context, class, p, q, stays) of entries."""
        context, own, _, total, left = self.contexts(batch)
        context, total, left = (np.repeat(x, own) for x in (context, total, left))
        q, stays = _flat(batch, "q").astype(np.float64), ~np.isnan(left)
        p = np.where(stays, (_flat(batch, "n") - DISCOUNT) / total + left * q, q)
        return context, _flat(batch, "symbol").view(np.uint32), p, q, stays


class _Kept:
    """Contexts of a level that stay: (ctx, total, kinds, left), hot ones more than once."""

    def __init__(self, tested: Tested):
        self.tested = tested

    def __call__(self, batch):
        context, _, kinds, total, left = self.tested.contexts(batch)
        at = np.flatnonzero(~np.isnan(left))
        return {"ctx": context[at].view(np.int64), "total": total[at], "kinds": kinds[at], "left": np.log10(left[at])}


class _Times:
    """How many entries of the contexts of a level that stay occur how often: (n, entries)."""

    def __init__(self, tested: Tested):
        self.tested = tested

    def __call__(self, batch):
        _, own, _, _, left = self.tested.contexts(batch)
        n, entries = np.unique(_flat(batch, "n")[np.repeat(~np.isnan(left), own)], return_counts=True)
        return {"n": n, "entries": entries}


class _Entries:
    """(codes, values) of the entries of the contexts of a level that stay, as one row of lists; those with ``often`` occurrences."""

    def __init__(self, tested: Tested, often: int):
        self.tested, self.often = tested, often

    def of(self, batch, rarer: bool):
        context, symbol, p, q, stays = self.tested.entries(batch)
        stays &= (_flat(batch, "n") < self.often) == rarer
        context, symbol, p, q = (x[stays] for x in (context, symbol, p, q))
        return context, coded(context, symbol), np.log10(p / q).astype(np.float32)

    def __call__(self, batch):
        _, code, value = self.of(batch, False)
        edges = np.array([0, len(code)])
        return {"codes": _lists(code.view(np.int64), edges, np.int64), "values": _lists(value, edges, np.float32)}


#: Sorted hashes of a bucket and what goes with each: a value, or the row that looks for it.
BUCKETED = "bucket int, keys binary, others binary"


def bucketed(keys: np.ndarray, others: np.ndarray, buckets: int) -> dict:
    """Hashes with 64-bit values as rows of BUCKETED."""
    order = np.argsort(keys)
    keys, others = keys[order], others[order]
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    first, n = _boundaries(bucket)
    ends = [(a * 8, (a + k) * 8) for a, k in zip(first.tolist(), n.tolist())]
    keys, others = keys.tobytes(), others.tobytes()
    return {"bucket": bucket[first], "keys": [keys[a:b] for a, b in ends], "others": [others[a:b] for a, b in ends]}


def context_key(context: np.ndarray) -> np.ndarray:
    """Stands for a context among hashes of contexts with a class."""
    return coded(context, np.full(len(context), 0xFFFFFFFFFF, np.uint64))


class _RareEntries(_Entries):
    """Entries that occur less than ``often`` times, with what they change against the rest of their context; see BUCKETED."""

    def __init__(self, tested: Tested, often: int, buckets: int):
        super().__init__(tested, often)
        self.buckets = buckets

    def __call__(self, batch):
        _, own, _, _, left = self.tested.contexts(batch)
        left = np.repeat(left, own)[(_flat(batch, "n") < self.often) & np.repeat(~np.isnan(left), own)]
        _, code, value = self.of(batch, True)
        return bucketed(code, value.astype(np.float64) - np.log10(left), self.buckets)


class _RareContexts:
    """What contexts (ctx, left) outside of ``head`` leave; see BUCKETED."""

    def __init__(self, head: Places, buckets: int):
        self.head, self.buckets = head, buckets

    def __call__(self, batch):
        context, left = batch.column("ctx").to_numpy().view(np.uint64), batch.column("left").to_numpy()
        some = self.head.of(context) < 0
        return bucketed(context_key(context[some]), left[some], self.buckets)


class _Looked:
    """Rows (row, pending) as what looks for hashes; see BUCKETED."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, batch):
        pending = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("pending")]
        rows = np.repeat(batch.column("row").to_numpy(), [len(x) for x in pending])
        return bucketed(np.concatenate(pending), rows, self.buckets)


def _both(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    keys, others = (b"".join(table.column(name).to_pylist()) for name in ("keys", "others"))
    return np.frombuffer(keys, np.uint64), np.frombuffer(others, kind)


def _found(looked: pa.Table, entries: pa.Table) -> pa.Table:
    """(row, more): sums of what a bucket's hashes change."""
    keys, value = _both(entries, np.float64)
    order = np.argsort(keys)
    keys, value = keys[order], value[order]
    wanted, rows = _both(looked, np.int64)
    if len(keys):
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[place] == wanted
        rows, value = rows[hit], value[place[hit]]
    else:
        rows, value = rows[:0], value[:0]
    rows, at = np.unique(rows, return_inverse=True)
    return pa.table([rows, np.bincount(at, value, len(rows)).astype(np.float64)], names=["row", "more"])


class _Parents:
    """Probabilities after all contexts of a level, by the buckets of the next one; see PARENTS."""

    def __init__(self, tested: Tested, dealt: Dealt):
        self.tested, self.dealt = tested, dealt

    def __call__(self, batch):
        context, symbol, p, _, _ = self.tested.entries(batch)
        copies = [(context[at], symbol[at], p[at], bucket) for at, bucket in self.dealt.copies(context, symbol)]
        context, symbol, p, bucket = (np.concatenate(x) for x in zip(*copies))
        order = np.lexsort((context, bucket))
        context, symbol, p, bucket = (x[order] for x in (context, symbol, p, bucket))
        new = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1]))[: len(context)])
        used, _ = _boundaries(bucket)
        outer, inner = np.append(np.searchsorted(new, used), len(new)), np.append(used, len(bucket))
        return {
            "bucket": bucket[used],
            "ctx": _lists(context[new].view(np.int64), outer, np.int64),
            "kinds": _lists(np.diff(np.append(new, len(context))), outer, np.int32),
            "symbol": _lists(symbol.view(np.int32), inner, np.int32),
            "p": _lists(p, inner, np.float32),
        }


def _wanted(root: Root, dealt: Dealt):
    """(bucket, class) of next classes that are not in ``root``."""

    def run(batches):
        for batch in batches:
            for classes in _texts_of(batch):
                ((at, context),) = contexts_of(classes, [])
                some = ~root.has(classes[at])
                at, context = at[some], context[some]
                bucket = dealt(context, context - context, classes[at])
                pairs = np.unique(bucket.astype(np.uint64) << np.uint64(32) | classes[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((pairs >> np.uint64(32)).astype(np.int32)), pa.array((pairs & np.uint64(0xFFFFFFFF)).view(np.int64))], names=["bucket", "class"]
                )

    return run


class _Classes:
    """Words (h, n) as (class, n)."""

    def __init__(self, symbols: Symbols):
        self.symbols = symbols

    def __call__(self, batch):
        return {"class": self.symbols(batch.column("h").to_numpy().view(np.uint64)).view(np.int64), "n": batch.column("n")}


class Grown:
    """The tree: tables of its levels, each with its :class:`Tested`, ``contexts`` (ctx, total, kinds, left), left in log10; ``runs`` for each length from 2 on."""

    def __init__(self, symbols: Symbols, runs: list[Bits], contexts: DataFrame | None, levels: list[tuple[DataFrame, Tested]]):
        self.symbols, self.runs, self.contexts, self.levels = symbols, runs, contexts, levels

    def mapped(self, make, schema: str, columns: tuple[str, ...] = ENTRY_COLUMNS) -> DataFrame:
        """Rows of all levels by ``make(tested)``."""
        return reduce(DataFrame.unionByName, [mapped(level.select(*columns), make(tested), schema) for level, tested in self.levels])


def grown(
    texts: DataFrame, words: DataFrame, tokens: int, fresh: float, least: int = LEAST, depth: int = DEPTH, gain: float = GAIN, entry: int = ENTRY
) -> Grown:
    """The suffix tree of training texts (text), given their words (word, n)."""
    often = words.filter(F.col("n") >= least)
    symbols = Symbols(Bits(often.select("h"), often.count()))
    spark = texts.sparkSession
    classes = stored(mapped(words, _Classes(symbols), "class long, n long").groupBy("class").agg(F.sum("n").alias("n")), "lm-classes")
    share = (1 - fresh) / max(1, tokens)
    end = int(END_CLASS)
    ends = classes.filter(F.col("class").isin(0, end)).toArrow()
    sums = dict(zip(ends.column("class").to_pylist(), ends.column("n").to_pylist()))
    real = classes.filter(~F.col("class").isin(0, end))
    top = real.orderBy(F.desc("n"), "class").limit(HEAD_CLASSES).toArrow()
    root = Root(
        np.append(top.column("class").to_numpy(), [0, end]).astype(np.uint64),
        np.append(top.column("n").to_numpy() * share, [sums.get(0, 0) * share + fresh, max(1, sums.get(end, 0)) * share]),
        share,
    )
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // BUCKET)
    numbered = stored(texts.select("text").mapInArrow(_classed(symbols), CLASSED), "lm-classed")

    #: a context is hot with more occurrences; there are less than HOT
    limit = max(BUCKET, tokens // HOT)
    hot = real.filter(F.col("n") > limit).toArrow()
    hot = pa.table([value_of(hot.column("class").to_numpy().view(np.uint64)).view(np.int64), hot.column("n").to_numpy(), np.zeros(len(hot), np.int64)], names=["run", "n", "suffix"])
    dealt, runs, levels = Dealt(1, buckets, hot, None), [], []
    for k in range(1, depth + 1):
        listed = numbered.mapInArrow(_count_level(runs, dealt), LISTED).groupBy("bucket")
        if k == 1 and len(top) < HEAD_CLASSES:
            merged = listed.applyInArrow(_alone(_merge(k, least, entry, gain, dealt.places, root)), LEVEL)
        else:
            if k == 1:
                parents, brought = root, numbered.mapInArrow(_wanted(root, dealt), "bucket int, class long").distinct().join(real, "class")
            else:
                parents, brought = Suffixes(), mapped(levels[-1][0].select(*ENTRY_COLUMNS), _Parents(levels[-1][1], dealt), PARENTS)
            merged = listed.cogroup(brought.groupBy("bucket")).applyInArrow(_merge(k, least, entry, gain, dealt.places, parents), LEVEL)
        level = stored(merged, "lm-level", ROWS)
        levels.append((level, Tested(level, least, gain)))
        if k < depth:
            found = level.select(F.explode(F.arrays_zip("run", "run_n", "run_suffix")).alias("r")).select("r.*")
            runs.append(Bits(found.select(F.col("run").alias("h")), level.agg(F.sum(F.size("run"))).first()[0] or 0))
            dealt = Dealt(k + 1, buckets, found.filter(F.col("run_n") > limit).toArrow(), dealt)
    for table in (numbered, classes):
        dropped(table)
    tree = Grown(symbols, runs, None, levels)
    kept = tree.mapped(_Kept, "ctx long, total long, kinds long, left double", CONTEXT_COLUMNS)
    contexts = kept.groupBy("ctx").agg(*[F.max(c).alias(c) for c in ("total", "kinds", "left")])
    tree.contexts = stored(contexts, "lm-contexts", ROWS)
    return tree


class Head:
    """The most frequent contexts and entries of a tree, and a bit table of all contexts.

    ``often`` is how often an entry occurs that is in the head, ``looked`` how many of
    the training words look for one that is not.
    """

    def __init__(self, tree: Grown):
        self.symbols, self.runs = tree.symbols, tree.runs
        self.count = tree.contexts.count()
        self.bits = Bits(tree.contexts.select(F.col("ctx").alias("h")), self.count)
        top = tree.contexts.orderBy(F.desc("total"), "ctx").limit(HEAD_CONTEXTS).select("ctx", "left").toArrow()
        context = top.column("ctx").to_numpy().view(np.uint64)
        order = np.argsort(context)
        self.contexts, self.left = Places(context[order]), top.column("left").to_numpy()[order]
        times = tree.mapped(_Times, "n long, entries long", (*CONTEXT_COLUMNS, "n")).groupBy("n").agg(F.sum("entries").alias("entries"))
        times = times.orderBy(F.desc("n")).toArrow()
        n, entries = (times.column(k).to_numpy() for k in range(2))
        fits = int((np.cumsum(entries) <= HEAD_ENTRIES).sum())
        self.often = int(n[fits]) + 1 if fits < len(n) else 1
        self.looked = int((n * entries)[fits:].sum())
        self.whole = fits == len(n) and len(context) == self.count
        found = tree.mapped(lambda tested: _Entries(tested, self.often), "codes array<long>, values array<float>").toArrow()
        code = _flat(found, "codes").view(np.uint64)
        order = np.argsort(code)
        self.codes, self.value = Places(code[order]), _flat(found, "values")[order]

    def rest(self, tree: Grown, buckets: int) -> DataFrame:
        """All other contexts and entries; see BUCKETED."""
        entries = tree.mapped(lambda tested: _RareEntries(tested, self.often, buckets), BUCKETED)
        if len(self.contexts.keys) < self.count:
            entries = entries.unionByName(mapped(tree.contexts.select("ctx", "left"), _RareContexts(self.contexts, buckets), BUCKETED))
        return stored(entries, "lm-rest", ROWS)


class _Score:
    """Sums over what travels to the tasks, and for the joins that follow the other words and contexts."""

    def __init__(self, tree: Head, head: tuple[np.ndarray, np.ndarray], tokens: int, kinds: int, fresh: float):
        """``head``: sorted hashes of words and their counts."""
        self.tree, self.head = tree, Places(head[0])
        # the last place is that of all other words
        self.own = np.append(np.log10(head[1]) + math.log10((1 - fresh) / max(1, tokens)), np.nan)
        self.base = np.append(np.log10(head[1] + 1) - math.log10(tokens + kinds + 1), np.nan)

    def _gains(self, symbol: np.ndarray):
        """What the contexts and entries in the head add at each token, and (places, hashes) of those that are not in it."""
        tree, gain, open_ = self.tree, np.zeros(len(symbol)), []
        for at, context in contexts_of(symbol, tree.runs):
            near = tree.bits.has(context)
            at, context = at[near], context[near]
            place, code = tree.contexts.of(context), coded(context, symbol[at])
            entry = tree.codes.of(code)
            # each code is there once, whatever is known of its context
            listed, left = entry >= 0, (entry < 0) & (place >= 0)
            gain[at[listed]] += tree.value[entry[listed]]
            gain[at[left]] += tree.left[place[left]]
            if not tree.whole:
                open_.append((at[~listed], code[~listed]))
                outside = ~listed & (place < 0)
                open_.append((at[outside], context_key(context[outside])))
        return gain, open_

    def _group(self, texts: pa.Array, out: dict) -> None:
        words = Words(texts)
        gain, open_ = self._gains(self.tree.symbols(words.hashes)[words.at])
        starts, edges = words.starts, np.append(0, words.ends + 1)
        place = self.head.of(words.hashes)[words.at]
        base, own, frequent = self.base[place], self.own[place], place >= 0
        out["n_tokens"].append(np.diff(edges))
        out["base"].append(np.add.reduceat(np.where(frequent, base, 0.0), starts))
        out["score"].append(np.add.reduceat(np.where(frequent, own, 0.0) + gain, starts))
        out["n_head"].append(np.add.reduceat(frequent.astype(np.int64), starts))
        rare = np.flatnonzero(~frequent)
        out["rare"].append((np.diff(np.searchsorted(rare, edges)), words.hashes[words.at[rare]].view(np.int64)))
        at, code = (np.concatenate(x) for x in zip(*open_)) if open_ else (np.empty(0, np.int64), np.empty(0, np.uint64))
        order = np.argsort(at, kind="stable")
        cuts, code = np.searchsorted(at[order], edges).tolist(), code[order]
        out["pending"] += [code[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def __call__(self, batch):
        out = {k: [] for k in ("n_tokens", "score", "base", "n_head", "rare", "pending")}
        for texts in chunks_of(batch, SCORE_BYTES):
            self._group(texts, out)
        columns = {k: np.concatenate(out[k]) for k in ("n_tokens", "score", "base", "n_head")} | {"pending": out["pending"]}
        counts, rare = (np.concatenate(x) for x in zip(*out["rare"]))
        columns["rare"] = _lists(rare, np.append(0, np.cumsum(counts)), np.int64)
        return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), **columns}


SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, score double, base double, n_head long, "
    "rare array<long>, pending binary"
)


def past_head(scored: DataFrame, rest: DataFrame, buckets: int) -> DataFrame:
    """Rows of SCORED with what the contexts and entries outside the head add, without ``pending``."""
    looked = mapped(scored.select("row", "pending"), _Looked(buckets), BUCKETED)
    found = looked.groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInArrow(_found, "row long, more double")
    more = stored(found.groupBy("row").agg(F.sum("more").alias("more")), "lm-more")
    return scored.drop("pending").join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")


def lm_scores(
    docs: DataFrame, modulus: int = 7, held: int = 2, least: int = LEAST, depth: int = DEPTH, entry: int = ENTRY, gain: float = GAIN
) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learned from rows whose crc32 of the id mod ``modulus`` is not ``held``.

    Contexts have up to ``depth`` words and ``least`` occurrences, their entries
    ``entry``; a context stays for ``gain`` nats an entry. Words have ``least``, too.

    The score is over the whole text, its end included, with all words outside the
    training vocabulary as one symbol, as in the base score.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A
    null text counts as empty and has its end token alone. A null id is never held
    out of training (held_out is null). Repeated rows count each. Without training
    rows every token is the one unknown symbol. Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (remainder("doc_id", modulus) == held).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    training = rows.filter(~F.coalesce("held_out", F.lit(False)))
    words = stored(word_counts(training), "words")
    size = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("once")).first()
    tokens, kinds = size.tokens or 0, size.kinds
    # the unknown symbol has the mass of the words seen once
    fresh = (size.once + 1) / (tokens + 2)
    tree = grown(training, words, tokens, fresh, least, depth, gain, entry)
    near = Head(tree)
    top = words.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    head = h[np.argsort(h)], n[np.argsort(h)]
    score, buckets, parts = _Score(near, head, tokens, kinds, fresh), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // (PER_LOOKUP * BUCKET)), []
    if near.whole:
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        parts.append(stored(mapped(numbered, score, SCORED).drop("pending"), "scores"))
    rest = None if near.whole else near.rest(tree, buckets)
    for table in (tree.contexts, *[level for level, _ in tree.levels]):
        dropped(table)
    # one slice after the other, so that what is looked for is not there together
    slices = 0 if near.whole else max(1, math.ceil(PER_LOOKUP * near.looked / tokens))
    for k in range(slices):
        numbered = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == k).withColumn("row", F.monotonically_increasing_id() + (k << 57))
        scored = stored(mapped(numbered, score, SCORED), "scores")
        parts.append(stored(past_head(scored, rest, buckets), "lm-scored"))
        dropped(scored)
    if rest is not None:
        dropped(rest)
    scored = reduce(DataFrame.unionByName, parts)

    # what the frequent words leave: counts of the other words, by a join on their hashes
    others = words.filter(F.col("n") <= int(n.min(initial=0 if not len(n) else n[0]))).select("h", F.col("n").alias("c"))
    rare = scored.select("row", F.explode("rare").alias("h"))
    bottom = math.log10(tokens + kinds + 1)
    own = F.log10(F.col("c") * F.lit((1 - fresh) / max(1, tokens)))
    found = rare.join(others, "h", "left").groupBy("row").agg(
        F.count("c").alias("n_found"),
        F.sum(F.log10(F.col("c") + 1) - F.lit(bottom)).alias("found"),
        F.sum(F.coalesce(own, F.lit(math.log10(fresh)))).alias("gained"),
    )
    found = stored(found, "lm-found")
    dropped(words)
    joined = scored.drop("rare").join(found, "row", "left")
    n_found = F.coalesce("n_found", F.lit(0))
    n_new = F.col("n_tokens") - F.col("n_head") - n_found
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + n_found).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("found", F.lit(0.0)) - n_new * F.lit(bottom)).alias("base_score"),
        (F.col("score") + F.coalesce("gained", F.lit(0.0))).alias("score"),
    )
