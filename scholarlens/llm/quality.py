"""Quality: gated attention over passages, learned from document labels alone.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by
what it looks like (classes of characters, case, symbols, repeats, lengths) and a
small tanh layer; gated attention weighs the passages, and a logistic reads the
weighted representation. All weights are trained together in numpy on a bounded
sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import TEXT_ROWS, chunks_of, mapped, remainder
from scholarlens.llm.toxicity import labelled_sample, threshold

SAMPLE_PER_CLASS, SAMPLE_CHARS = 2_000, 20_000
PASSAGE, HIDDEN, ATTENTION = 64, 16, 8
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4
CUT = 0.3
#: Bytes of text scored at once.
SCORE_BYTES = 3_000_000
_CLASSES = ("lower", "upper", "digit", "high", "stop", "mark", "bar", "symbol")
FEATURES = [*(f"share_{c}" for c in _CLASSES), "chars", "words_distinct", "words_repeated", "pieces_distinct", "mixed", "all_upper", "bare", "words"]


def _byte_classes() -> np.ndarray:
    out = np.full(256, _CLASSES.index("symbol"))
    for members, name in ((range(97, 123), "lower"), (range(65, 91), "upper"), (range(48, 58), "digit"), (range(128, 256), "high")):
        out[list(members)] = _CLASSES.index(name)
    for members, name in ((b".,;:'", "stop"), (b"!?", "mark"), (b"|", "bar")):
        out[list(members)] = _CLASSES.index(name)
    return out


_BYTES = _byte_classes()


def word_facts(words: pa.Array) -> np.ndarray:
    """Numbers of words: bytes of each class, mixed letters and symbols, all capitals, no letter."""
    binary = words.cast(pa.large_binary())
    sizes = pc.binary_length(binary).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(binary.to_pylist()), np.uint8)
    n = len(_CLASSES)
    counts = np.bincount(np.repeat(np.arange(len(sizes)) * n, sizes) + _BYTES[data], minlength=n * len(sizes)).reshape(-1, n)
    letters = counts[:, 0] + counts[:, 1] + counts[:, 3]
    symbols = counts[:, 5] + counts[:, 6] + counts[:, 7]
    facts = [(letters > 0) & (symbols > 1), (counts[:, 1] > 1) & (counts[:, 0] == 0), letters == 0]
    return np.column_stack([counts, *facts]).astype(np.float32)


def _distinct(groups: np.ndarray, starts: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """How many different forms each group has; groups begin at ``starts``."""
    keys = np.sort(groups * (int(forms.max()) + 1) + forms)
    return np.add.reduceat(np.append(True, keys[1:] != keys[:-1]).astype(np.float32), starts)


class Encoder:
    """Passage features of many texts at once; the facts of a word are worked out once for all of them."""

    def __init__(self, passage: int = PASSAGE):
        self.passage = passage

    def __call__(self, text: bytes) -> np.ndarray:
        """(passages x features); an empty text is one passage of zeros."""
        return self.all(pa.array([text.decode(errors="replace")]))[0]

    def all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(passages x features) of all texts, and the first passage of each."""
        lists = pc.ascii_split_whitespace(texts)
        found = lists.flatten().dictionary_encode()
        number, words = found.indices.to_numpy(zero_copy_only=False), found.dictionary
        # white space at the ends of a text gives empty words
        real = number != pc.index(words, "").as_py()
        before, edges = np.append(0, np.cumsum(real)), lists.offsets.to_numpy()
        before = before[edges - edges[0]]
        number, lengths = number[real], np.diff(before)
        full = -(-lengths // self.passage)
        counts = np.maximum(1, full - ((full > 1) & (lengths - (full - 1) * self.passage < self.passage // 4)))
        first = np.append(0, np.cumsum(counts))
        out = np.zeros((first[-1], len(FEATURES)), np.float32)
        texts_of = np.repeat(np.arange(len(counts)), counts)
        # an empty text has a passage and no words
        filled = np.flatnonzero(lengths[texts_of] > 0)
        if not len(filled):
            return out, first[:-1]
        owner = texts_of[filled]
        starts = before[owner] + (filled - first[owner]) * self.passage
        sizes = np.diff(np.append(starts, len(number)))
        form = pc.ascii_lower(words).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[number]
        sums = np.add.reduceat(word_facts(words)[number], starts, axis=0)
        n = len(_CLASSES)
        chars = np.maximum(1, sums[:, :n].sum(axis=1))
        passage = np.repeat(np.arange(len(starts)), sizes)
        same = np.append(False, (form[1:] == form[:-1]) & (passage[1:] == passage[:-1]))
        whole = np.flatnonzero(lengths > 0)
        # repeats of whole lines further apart show over the whole text
        overall = np.zeros(len(lengths))
        overall[whole] = _distinct(np.repeat(np.arange(len(whole)), lengths[whole]), before[whole], form) / lengths[whole]
        distinct = _distinct(passage, starts, form)
        sizes = sizes.astype(np.float32)
        out[filled] = np.column_stack(
            [
                sums[:, :n] / chars[:, None],
                chars / sizes / 8,
                distinct / sizes,
                np.add.reduceat(same.astype(np.float32), starts) / sizes,
                overall[owner],
                sums[:, n] / sizes,
                sums[:, n + 1] / sizes,
                sums[:, n + 2] / sizes,
                np.log1p(sizes) / 5,
            ]
        )
        return out, first[:-1]


class Model:
    """tanh encoder, gated attention (tanh times sigmoid) and a logistic on the weighted passages."""

    def __init__(self, features: int = len(FEATURES), hidden: int = HIDDEN, attention: int = ATTENTION, seed: int = 3):
        rng = np.random.default_rng(seed)

        def start(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.p = {
            "encode": start(features, hidden),
            "encode_bias": np.zeros(hidden),
            "view": start(hidden, attention),
            "gate": start(hidden, attention),
            "weigh": start(attention),
            "read": start(hidden),
            "bias": np.zeros(1),
        }
        self.mean, self.scale, self.shift = np.zeros(features), np.ones(features), 0.0

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """Logits of bags of passages; ``starts`` has the first passage of each."""
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["encode"] + p["encode_bias"])
        view, gate = np.tanh(h @ p["view"]), 1 / (1 + np.exp(-(h @ p["gate"])))
        e = (view * gate) @ p["weigh"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return z @ p["read"] + p["bias"][0], (h, view, gate, a, z, sizes)

    def gradients(self, x, starts, labels, weights) -> dict[str, np.ndarray]:
        p = self.p
        logit, (h, view, gate, a, z, sizes) = self.forward(x, starts)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weights / weights.sum()
        dz = np.repeat(d[:, None] * p["read"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        mean = np.repeat(np.add.reduceat(a * da, starts), sizes)
        de = a * (da - mean)
        both = de[:, None] * p["weigh"]
        dview, dgate = both * gate * (1 - view**2), both * view * gate * (1 - gate)
        dh = a[:, None] * dz + dview @ p["view"].T + dgate @ p["gate"].T
        dpre = dh * (1 - h**2)
        return {
            "encode": ((x - self.mean) / self.scale).T @ dpre,
            "encode_bias": dpre.sum(axis=0),
            "view": h.T @ dview,
            "gate": h.T @ dgate,
            "weigh": (view * gate).T @ de,
            "read": z.T @ d,
            "bias": np.array([d.sum()]),
        }

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        logits, _ = self.forward(x, starts)
        return 1 / (1 + np.exp(-np.clip(logits + self.shift, -700, 700)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 3) -> Model:
    """Fit by Adam on documents with 0/1 labels; the cut CUT is put where it parts the classes best."""
    model, rng = Model(seed=seed), np.random.default_rng(seed)
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        model.p["read"][:] = 0
        model.shift = 0.0 if len(texts) == 0 else (20.0 if labels[0] else -20.0)
        return model
    every, firsts = Encoder().all(pa.array([t.decode(errors="replace") for t in texts]))
    bags = np.split(every, firsts[1:])
    model.mean, model.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    weights = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            x = np.concatenate([bags[i] for i in part])
            starts = np.append(0, np.cumsum([len(bags[i]) for i in part])[:-1])
            step += 1
            for name, g in model.gradients(x, starts, labels[part], weights[part]).items():
                g = g + DECAY * model.p[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.p[name] -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    logits, _ = model.forward(every, firsts)
    # scores keep their meaning at CUT: its logit lies at the best cut of the training scores
    model.shift = float(np.log(CUT / (1 - CUT)) - threshold(logits, labels))
    return model


def _scores(model: Model, batch) -> np.ndarray:
    encode = Encoder()
    return np.concatenate([model.scores(*encode.all(texts)) for texts in chunks_of(batch, SCORE_BYTES)])


class _Score:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batch):
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": _scores(self.model, batch)}


def _fitted(docs: DataFrame, labels: DataFrame, folds: int) -> Model:
    return train(*labelled_sample(docs, labels, "quality", folds, SAMPLE_PER_CLASS, SAMPLE_CHARS))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) teach only through rows whose crc32 of the id modulo
    ``folds`` is not 0. Null texts score like empty ones; a null id gives a null
    held_out; repeated rows score alike; other columns are ignored. Without labels
    of both classes every score is that of the one class, or 0.5.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), (remainder("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    scored = mapped(rows, _Score(_fitted(docs, labels, folds)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


class _Keep:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batch):
        at = np.flatnonzero(_scores(self.model, batch) >= CUT)
        return {name: batch.column(name).take(at) for name in batch.schema.names}


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be of quality, with all their columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, _Keep(_fitted(docs, labels, folds)), schema, TEXT_ROWS)
