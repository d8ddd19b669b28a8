"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the embeddings of itself and of its character n-grams,
all hashed into one table, so an unseen misspelling shares most of its vectors
with the word it hides. A window of words is the average of its words, and a
softmax over two classes reads it. Table and softmax are trained together on a
bounded sample of labelled documents; the label belongs to the document, so its
most suspicious window stands for it, chosen anew in each round.

A document's score is the highest probability among its windows; a run of one
word counts once. As everything
before the softmax is an average, a word contributes one number, which is kept
for each distinct word; scoring is a running mean of those numbers.
"""

from __future__ import annotations

from array import array
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import WordMemo, byte_texts, kept_in_worker, mapped, remainder

#: Labelled documents of each class that train the model, and the longest text among them.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2_000, 20_000
BUCKETS, DIM, WINDOW = 1 << 16, 12, 8
GRAMS = (3, 4, 5, 6, 7)
ROUNDS, EPOCHS, BATCH, RATE = 5, 3, 256, 0.1
_EDGE = b".,;:!?\"'()[]{}<>|*#&$%/\\-_~`^=+"


def bare(word: bytes) -> bytes:
    """A word in lower case without punctuation at its ends; all that its vectors depend on."""
    return (word.strip(_EDGE) or word).decode("utf-8", "replace").lower().encode()


def subwords(form: bytes) -> list[int]:
    """Buckets of a bare word and its character n-grams, its ends marked."""
    text = "<" + form.decode() + ">"
    parts = [text] + [text[k : k + n] for n in GRAMS for k in range(len(text) - n + 1) if n < len(text)]
    return [xxhash.xxh3_64_intdigest(p.encode()) % BUCKETS for p in parts]


class Windows:
    """All windows of a set of documents, over a common list of distinct words."""

    def __init__(self, texts: list[bytes], window: int):
        ids: dict[bytes, int] = {}
        # compact arrays: there are millions of words and n-grams
        words, starts, docs = array("i"), array("q", [0]), array("i")
        for d, text in enumerate(texts):
            own = [ids.setdefault(bare(w), len(ids)) for w, _ in groupby(text.split())] or [ids.setdefault(b"", len(ids))]
            for k in range(0, max(1, len(own) - window // 2), window // 2):
                words.extend(own[k : k + window])
                starts.append(len(words))
                docs.append(d)
        parts, ends = array("i"), array("q")
        for form in ids:
            parts.extend(subwords(form))
            ends.append(len(parts))
        self.words, self.docs, self.parts = (np.frombuffer(x, np.int32) for x in (words, docs, parts))
        self.starts, self.ends = np.frombuffer(starts, np.int64), np.frombuffer(ends, np.int64)

    def word_scores(self, bucket_scores: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(bucket_scores.astype(np.float32)[self.parts], np.append(0, self.ends[:-1]), dtype=np.float64)
        return sums / np.diff(np.append(0, self.ends))

    def scores(self, model: Model) -> np.ndarray:
        """Logit of each window."""
        words = self.word_scores(model.bucket_scores())
        sums = np.add.reduceat(words[self.words], self.starts[:-1])
        return sums / np.diff(self.starts) + model.bias

    def bag(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, weight, row) of all subwords of the chosen windows; the weights of a row sum to 1."""
        lengths = self.starts[chosen + 1] - self.starts[chosen]
        at = np.repeat(self.starts[chosen] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        words, row = self.words[at], np.repeat(np.arange(len(chosen)), lengths)
        starts = np.append(0, self.ends[:-1])[words]
        counts = self.ends[words] - starts
        at = np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        weight = np.repeat(1 / (counts * lengths[row]), counts)
        return self.parts[at], weight, np.repeat(row, counts)


class Model:
    """Embeddings and softmax; with two classes the softmax is a logistic of the difference of its rows."""

    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, window: int = WINDOW, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.window = window
        self.embed = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
        self.soft = rng.normal(0, 3.0, (dim, 2))
        self.bias = 0.0
        self._squares = [np.full(buckets, 1e-8), np.full(dim, 1e-8), 1e-8]

    def bucket_scores(self) -> np.ndarray:
        return self.embed @ (self.soft[:, 1] - self.soft[:, 0])

    def word_score(self, form: bytes) -> float:
        """The one number that a bare word contributes."""
        return float(self._scores[subwords(form)].mean())

    def frozen(self) -> Model:
        """The model with only the numbers that scoring needs."""
        self._scores = self.bucket_scores().astype(np.float32)
        self.digest = xxhash.xxh3_64_intdigest(self._scores.tobytes())
        del self.embed, self._squares
        return self

    def learn(self, bag: tuple, labels: np.ndarray, weights: np.ndarray, rate: float) -> None:
        """One step of AdaGrad on the cross entropy of a batch of windows."""
        buckets, weight, row = bag
        used, local = np.unique(buckets, return_inverse=True)
        vectors = self.embed[used]
        mix = np.zeros((len(labels), vectors.shape[1]))
        contribution = vectors[local] * weight[:, None]
        ends = np.flatnonzero(np.append(np.diff(row), 1))
        mix[row[ends]] = np.add.reduceat(contribution, np.append(0, ends[:-1] + 1))
        direction = self.soft[:, 1] - self.soft[:, 0]
        error = (1 / (1 + np.exp(-np.clip(mix @ direction + self.bias, -30, 30))) - labels) * weights / weights.sum()
        grad_direction = mix.T @ error
        coefficient = np.bincount(local, weight * error[row], len(used))
        grad = coefficient[:, None] * direction[None, :]
        self._squares[0][used] += (grad**2).sum(axis=1)
        self.embed[used] -= rate * grad / np.sqrt(self._squares[0][used])[:, None]
        self._squares[1] += grad_direction**2
        step = rate * grad_direction / np.sqrt(self._squares[1])
        self.soft[:, 1] -= step / 2
        self.soft[:, 0] += step / 2
        self._squares[2] += error.sum() ** 2
        self.bias -= rate * error.sum() / np.sqrt(self._squares[2])


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on documents with 0/1 labels.

    The first round learns from whole documents' windows alike; later rounds take
    the highest window of each document, a positive one's as positive and a
    negative one's as the hardest negative, with as many random negative windows.
    """
    model, rng = Model(seed=seed), np.random.default_rng(seed)
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        # nothing to tell apart: every document gets the share of the one class
        model.embed[:] = 0
        model.bias = 0.0 if len(texts) == 0 else (20.0 if labels[0] else -20.0)
        return model.frozen()
    windows = Windows(texts, model.window)
    owner = labels[windows.docs]
    for turn in range(ROUNDS):
        if turn == 0:
            chosen = np.arange(len(owner))
        else:
            scores = windows.scores(model)
            order = np.lexsort((-scores, windows.docs))
            first = order[np.append(0, np.flatnonzero(np.diff(windows.docs[order])) + 1)]
            negative = np.flatnonzero(owner == 0)
            chosen = np.concatenate([first, rng.choice(negative, min(len(negative), 2 * len(first)), replace=False)])
        target = owner[chosen].astype(float)
        balance = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
        for _ in range(EPOCHS if turn else 1):
            order = rng.permutation(len(chosen))
            for k in range(0, len(order), BATCH):
                part = order[k : k + BATCH]
                model.learn(windows.bag(chosen[part]), target[part], balance[part], RATE * (3 if turn else 2))
    # the bias that parts the highest windows of the two classes best, halfway through the gap
    scores = windows.scores(model)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, windows.docs, scores)
    model.bias -= threshold(top, labels)
    return model.frozen()


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best balanced accuracy, in the middle of its gap."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    missed = np.append(0, np.cumsum(y)) / max(1, y.sum())
    passed = np.append(0, np.cumsum(1 - y)) / max(1, (1 - y).sum())
    k = int(np.argmax(passed - missed))
    if k == 0 or k == len(s):
        return float(s[0] if k == 0 else s[-1])
    return float((s[k - 1] + s[k]) / 2)


class _Score:
    def __init__(self, model: Model):
        self.model, self.memo = model, None

    def fresh(self) -> WordMemo:
        forms = WordMemo(self.model.word_score)
        return WordMemo(lambda word: forms[bare(word)])

    def one(self, text: bytes) -> float:
        words = text.split() or [b""]
        values = self.memo.values_of(words, np.float64)
        values = values[np.append(True, values[1:] != values[:-1])]
        width = min(self.model.window, len(values))
        sums = np.concatenate([[0.0], np.cumsum(values)])
        best = float((sums[width:] - sums[:-width]).max()) / width + self.model.bias
        return float(1 / (1 + np.exp(-max(-700.0, min(700.0, best)))))

    def __call__(self, batch):
        self.memo = kept_in_worker(("toxicity", self.model.digest), self.fresh)
        return {
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "score": [self.one(text) for text in byte_texts(batch, "text")],
        }


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, per_class: int, chars: int
) -> tuple[list[bytes], np.ndarray]:
    """A bounded sample of labelled texts outside the held-out fold: ``per_class`` rows of each label at most.

    Twice as many ids of each label are drawn, those with the least hash, and only
    they meet the texts; of these the first ``per_class`` with a text of at most
    ``chars`` characters are taken. An id with two labels is no example; of rows that
    repeat an id one counts.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"), F.min(label).alias("least")).filter("y = least")
    known = known.select("doc_id", "y", F.xxhash64("doc_id").alias("order"))
    # 4 x per_class ids at most, so the broadcast has a fixed bound
    drawn = [known.filter(F.col("y") == y).orderBy("order").limit(2 * per_class) for y in (0, 1)]
    wanted = F.broadcast(drawn[0].unionByName(drawn[1]))
    rows = docs.filter(F.col("text").isNotNull() & (F.length("text") <= chars)).select("doc_id", "text")
    found = rows.join(wanted, "doc_id").groupBy("doc_id", "y", "order").agg(F.min("text").alias("text")).toArrow()
    found = found.sort_by([("y", "ascending"), ("order", "ascending"), ("doc_id", "ascending")])
    y = found.column("y").to_numpy().astype(np.int64)
    place = np.arange(len(y)) - np.searchsorted(y, y)
    kept = np.flatnonzero(place < per_class)
    return [t.encode() for t in found.column("text").take(kept).to_pylist()], y[kept]


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) teach only through rows whose crc32 of the id modulo
    ``folds`` is not 0. Null texts score like empty ones; a null id gives a null
    held_out; repeated rows score alike; other columns are ignored. Without labels
    of both classes every score is that of the one class, or 0.5.
    """
    texts, y = labelled_sample(docs, labels, "toxic", folds, SAMPLE_PER_CLASS, SAMPLE_CHARS)
    model = train(texts, y)
    rows = docs.select(
        F.col("doc_id").cast("long"), (remainder("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    scored = mapped(rows, _Score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
