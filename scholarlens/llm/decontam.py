"""Benchmark decontamination by templates: typed placeholders, window hash join and slot consistency.

Numbers, units and names of a text become placeholders, so that a question with
other figures or persons in it keeps its template. Windows of ``WIDTH`` template
words are looked up in the benchmark's windows; an item leaks into a document
when ``COVERAGE`` of its distinct windows occur there and the slots agree: what
stands in the document for a value of the item is the same wherever it stands.
Whether a capital marks a name depends on what stands before it, so a line break
counts as the start of a sentence and as none, and an item's first word as a name
and as none. A second set of windows, of the words as they are but for case, finds
whole items whatever stands before them and in any case; either set is enough.

An item of w distinct windows that leaks has more than w - ``COVERAGE`` w of any of them in
the document, so the windows that the fewest items share, just as many that one of
them must be there, are the item's keys. A bit table of bounded size picks the
documents that may have one; their windows are joined with the table of keys, and
each pair found is held against each other whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.llm.common import TEXT_ROWS, Bits, WordMemo, byte_texts, hash_word, kept_in_worker, mapped, stored, window_hashes

WIDTH, COVERAGE, AGREEMENT = 5, 0.8, 0.8
NUMBER, UNIT, NAME = 3, 5, 7
#: Units of measure and money, as they stand behind a number.
UNITS = frozenset(
    b"mm cm m km in ft yd mi mg g kg lb lbs oz t ml l cl s sec secs min mins h hr hrs hour hours minute minutes second seconds "
    b"day days week weeks month months year years km/h mph kmh meter meters metre metres inch inches foot feet mile miles "
    b"gram grams pound pounds dollar dollars cent cents euro euros usd eur gbp percent degrees litre litres liter liters".split()
)
_NUMBER = re.compile(rb"[+-]?[$\xe2\x82\xac]*\d[\d.,:/]*%?")
_EDGE = b".,;:!?\"'()[]{}<>|*#&$%/\\-_~`^=+"
_CAPITAL, _STOP, _SLOT = 1, 2, 4
#: A line break becomes a word that ends a sentence.
_BREAK, _MARK, _MARK_WORD = re.compile(rb"[\r\n]+"), b" .|. ", b".|."


def _word(word: bytes) -> int:
    """Hash of a word's template form with three flags in the low bits: capitalised, ends a sentence, is a slot."""
    stop = _STOP if word[-1:] in b".!?:" else 0
    bare = word.strip(_EDGE)
    if not bare:
        return stop
    if _NUMBER.fullmatch(bare):
        return NUMBER << 3 | _SLOT | stop
    lower = bare.decode().casefold().encode()
    if lower in UNITS:
        return UNIT << 3 | _SLOT | stop
    letters = bare.decode()
    capital = _CAPITAL if letters[0].isupper() and (len(letters) == 1 or not letters[1:].isupper()) and letters[0].isalpha() else 0
    return (hash_word(lower) >> 3) << 3 | capital | stop


class Template:
    """Template form of texts; the memo of words lives as long as the task."""

    def __init__(self):
        self.memo = None

    def __call__(self, text: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, bool]:
        """(forms, value hashes, slot marks, does it begin with a capital?) of the words that have letters or digits.

        A form is the template words' hashes. A name is a capitalised word that does not
        begin a sentence or the text; there is a second form if line breaks change that.
        """
        broken = _BREAK.search(text) is not None
        if broken:
            text = _BREAK.sub(_MARK, text)
        if self.memo is None:
            self.memo = kept_in_worker(("template",), lambda: WordMemo(_word))
        words = text.split()
        codes = self.memo.values_of(words, np.uint64)
        flags = codes & np.uint64(7)
        form = codes >> np.uint64(3)
        stop = (flags & np.uint64(_STOP)) != 0
        opening = np.ones(len(codes), bool)
        opening[1:] = stop[:-1]
        slot = (flags & np.uint64(_SLOT)) != 0
        capital = (flags & np.uint64(_CAPITAL)) != 0
        name = capital & ~opening
        value = form.copy()
        if slot.any():
            at = np.flatnonzero(slot)
            value[at] = [hash_word(words[k].strip(_EDGE).lower()) for k in at]
        kept = form != 0
        forms = [np.where(name, np.uint64(NAME), form)[kept]]
        if broken:
            # without the breaks: a word after one begins a sentence if the word before the break ended one
            real = np.flatnonzero(np.fromiter((w != _MARK_WORD for w in words), bool, len(words)))
            inner = np.ones(len(codes), bool)
            inner[real[1:]] = stop[real[:-1]]
            more = capital & ~inner
            if (more != name).any():
                forms.append(np.where(more, np.uint64(NAME), form)[kept])
                name = name | more
        return forms, value[kept], (slot | name)[kept], bool(kept.any() and capital[np.argmax(kept)])


class Item:
    """A benchmark item: its windows as templates, in all their forms, and as plain words."""

    def __init__(self, text: bytes, width: int, form: Template):
        forms, self.values, self.slots, capital = form(text)
        # an item shorter than a window is known by its whole sequence
        self.span = min(width, max(1, len(self.values)))
        if capital and len(self.values) >= width:
            for words in list(forms):
                words = words.copy()
                words[0] = NAME
                forms.append(words)
        self.forms = [window_hashes(words, self.span) for words in forms]
        self.plain = np.unique(window_hashes(self.values, self.span))
        # another form of a window stands for the window
        self.kinds, number = np.unique(self.forms[0], return_inverse=True)
        self.number: dict[int, int] = {}
        self.first: dict[int, int] = {}
        for windows in self.forms:
            for at, (h, n) in enumerate(zip(windows.tolist(), number.tolist())):
                self.number.setdefault(h, n)
                self.first.setdefault(h, at)


class _Windows:
    """Windows of items as rows (item, kind, h, number), kind 0 as templates and 1 as plain words, and how many each kind has."""

    def __init__(self, width: int):
        self.width, self.form = width, Template()

    def __call__(self, batch):
        out = {k: [] for k in ("item", "kind", "h", "number", "span", "windows")}
        for row, text in zip(batch.column("item").to_pylist(), byte_texts(batch, "text")):
            item = Item(text, self.width, self.form)
            sets = [(0, h, n) for h, n in item.number.items()], [(1, h, n) for n, h in enumerate(item.plain.tolist())]
            for found, size in zip(sets, (len(item.kinds), len(item.plain))):
                for kind, h, n in found:
                    for column, value in zip(out.values(), (row, kind, h - (1 << 63), n, item.span, size)):
                        column.append(value)
        return out


class _Candidates:
    """Documents that have windows of the bit table, with those windows: (doc_id, text, hits)."""

    def __init__(self, known: Bits, spans: list[int]):
        self.known, self.spans, self.form = known, spans, Template()

    def hits(self, words: np.ndarray) -> np.ndarray:
        found = [window_hashes(words, span) for span in self.spans]
        return np.unique(np.concatenate([h[self.known.has(h)] for h in found])) if found else np.empty(0, np.uint64)

    def __call__(self, batch):
        out = {k: [] for k in ("doc_id", "text", "hits")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch, "text")):
            forms, values, _, _ = self.form(text)
            hits = np.unique(np.concatenate([*map(self.hits, forms), self.hits(values)]))
            if len(hits):
                for column, value in zip(out.values(), (doc_id, text, (hits ^ np.uint64(1 << 63)).view(np.int64))):
                    column.append(value)
        return out


def slot_agreement(item: Item, windows: list[np.ndarray], values: np.ndarray, slots: np.ndarray) -> float:
    """Share of slot meetings in which an item's value stands for its usual value in the document.

    Windows of the document are read in order. One that goes on where the item's last
    window left off meets the item's next one, any other the item's first of its kind,
    so each place is read once however often windows repeat.
    """
    keys = np.array(list(item.first), np.uint64)
    at = np.unique(np.concatenate([np.flatnonzero(np.isin(w, keys)) for w in windows]))
    pairs, shift = set(), None
    for p in at.tolist():
        here = [int(w[p]) for w in windows]
        q = -1 if shift is None else p - shift
        if not (0 <= q < len(item.forms[0]) and any(int(f[q]) in here for f in item.forms)):
            q = next(item.first[h] for h in here if h in item.first)
            shift = p - q
        for k in range(item.span):
            if item.slots[q + k] or slots[p + k]:
                pairs.add((q + k, p + k))
    met: dict[int, dict[int, int]] = {}
    for q, p in pairs:
        row = met.setdefault(int(item.values[q]), {})
        row[int(values[p])] = row.get(int(values[p]), 0) + 1
    return sum(max(row.values()) for row in met.values()) / len(pairs) if pairs else 1.0


class _Leaks:
    """Pairs (doc_id, text, item_id, item_text) held against each other whole; those that leak stay."""

    def __init__(self, width: int, coverage: float, agreement: float):
        self.width, self.coverage, self.agreement, self.form = width, coverage, agreement, Template()
        self.last, self.read = None, None

    def judged(self, item: Item, forms: list[np.ndarray], values: np.ndarray, slots: np.ndarray) -> tuple | None:
        windows = [window_hashes(words, item.span) for words in forms]
        found = np.unique(np.concatenate(windows)).tolist()
        matched, size, agreement = len({item.number[h] for h in found if h in item.number}), len(item.kinds), 0.0
        if matched and matched >= self.coverage * size:
            agreement = slot_agreement(item, windows, values, slots)
        if agreement < self.agreement:
            matched, size = len(np.intersect1d(window_hashes(values, item.span), item.plain)), len(item.plain)
            if not matched or matched < self.coverage * size:
                return None
            # the words are the item's own
            agreement = 1.0
        return matched, size, matched / size, agreement

    def __call__(self, batch):
        out = {k: [] for k in ("doc_id", "item_id", "matched_windows", "item_windows", "coverage", "slot_agreement")}
        rows = zip(batch.column("doc_id").to_pylist(), byte_texts(batch, "text"), batch.column("item_id").to_pylist(), byte_texts(batch, "item_text"))
        for doc_id, text, item_id, item_text in rows:
            # pairs of a document follow each other
            if text != self.last:
                self.last, self.read = text, self.form(text)
            forms, values, slots, _ = self.read
            leak = self.judged(Item(item_text, self.width, self.form), forms, values, slots)
            if leak is not None:
                for column, value in zip(out.values(), (doc_id, item_id, *leak)):
                    column.append(value)
        return out


LEAKS = "doc_id long, item_id long, matched_windows long, item_windows long, coverage double, slot_agreement double"


def item_keys(windows: DataFrame, coverage: float) -> DataFrame:
    """(kind, h, item): for each item and kind the windows that the fewest items share, one of which a leak must have."""
    shared = windows.groupBy("kind", "h").agg(F.count("*").alias("items"))
    rated = windows.join(shared, ["kind", "h"])
    # the forms of a window are as common as the commonest of them
    common = rated.groupBy("item", "kind", "number", "windows").agg(F.max("items").alias("items"), F.collect_list("h").alias("forms"))
    order = F.row_number().over(Window.partitionBy("item", "kind").orderBy("items", "number"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("windows") * coverage - 1e-9))
    keys = common.withColumn("rank", order).filter(F.col("rank") <= F.col("windows") - needed + 1)
    return keys.select("kind", F.explode("forms").alias("h"), "item")


def leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, agreement: float = AGREEMENT
) -> DataFrame:
    """Pairs of a document (doc_id, text) and a benchmark item (item_id, text) that leaks into it.

    Null and blank texts have no windows and leak nothing; items shorter than a
    window are compared as a whole sequence. Null ids stay null in the pairs.
    Repeated rows give repeated pairs; other columns are ignored. An empty
    benchmark gives no pair.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    schema = "item long, kind int, h long, number long, span int, windows long"
    windows = stored(mapped(items.select("item", "text"), _Windows(width), schema), "windows")
    spans = sorted(r.span for r in windows.select("span").distinct().collect())
    keys = stored(item_keys(windows, coverage), "keys")
    # keys are kept with the sign bit turned; a table of 2 MB errs in less than one of a thousand places for small benchmarks
    known = Bits(keys.select((F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).alias("h")), keys.count(), 24)
    near = mapped(docs, _Candidates(known, spans), "doc_id long, text binary, hits array<long>")
    near = stored(near.withColumn("row", F.monotonically_increasing_id()), "near", TEXT_ROWS)
    hits = near.select("row", F.explode("hits").alias("h"))
    pairs = hits.join(keys.select("h", "item").distinct(), "h").select("row", "item").distinct()
    held = pairs.join(near.select("row", "doc_id", "text"), "row")
    held = held.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    held = held.sortWithinPartitions("row").select("doc_id", "text", "item_id", "item_text")
    return mapped(held, _Leaks(width, coverage, agreement), LEAKS)
