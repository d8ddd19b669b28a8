"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.sources.folders import shared_folder

WORDS_KEPT = 250_000
#: Rows that go to Python at once where they hold whole texts or sets.
TEXT_ROWS = 1_000
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold that a row belongs to."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % modulus


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def free_name(name: str, columns: list[str]) -> str:
    """``name``, lengthened until it differs from all ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again; cuts lineage and survives executors.

    ``batch`` bounds the rows that go to Python at once, for those that hold whole texts.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    # shuffle files that led to the table are of no more use
    before = {_CLEANS: spark.conf.get(_CLEANS, "false"), _BATCH: spark.conf.get(_BATCH)}
    spark.conf.set(_CLEANS, "true")
    if batch is not None:
        spark.conf.set(_BATCH, batch)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def _holder() -> types.ModuleType:
    holder = sys.modules.setdefault("_kept_between_tasks", types.ModuleType("_kept_between_tasks"))
    holder.__dict__.setdefault("kept", {})
    holder.__dict__.setdefault("asked", False)
    return holder


def kept_in_worker(key: tuple, make):
    """``make()``, kept under ``key`` in this Python process, which serves many tasks one after another.

    Functions of this package come to a worker anew for each task, so what should
    outlive a task is held by a module of its own. Only the key used last is kept, and
    tasks of :func:`mapped` that ask for none let it go, so that the stages of one job
    do not add up their memory.
    """
    holder = _holder()
    kept, holder.asked = holder.kept, True
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


class WordMemo(dict):
    """A mapping from a word to ``make(word)`` that holds the words met last, ``limit`` to twice as many.

    A full generation becomes the old one; words met again move on, others go.
    """

    def __init__(self, make, limit: int = WORDS_KEPT):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self.put(word, value)
        return value

    def put(self, word, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value

    def values_of(self, words: Iterable, dtype) -> np.ndarray:
        words = list(words)
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))


def hash_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


MULTIPLIER = np.uint64(0x100000001B3)
#: Logarithm of the most bits of a bit table.
MOST_BITS = 27


class Bits:
    """A set of 64-bit hashes as a bit table of bounded size; it may hold others too, and misses none."""

    def __init__(self, hashes: DataFrame, n: int, least: int = 16):
        """``hashes`` has column h; ``n`` is about how many they are; the table has 2 ** ``least`` bits or more."""
        self.log = min(MOST_BITS, max(least, math.ceil(math.log2(64 * max(1, n)))))
        place = F.shiftrightunsigned("h", 64 - self.log)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - self.log}) & 63 as int))")
        found = hashes.select(F.shiftright(place, 6).alias("k"), bit.alias("b")).groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
        self.table = np.zeros(1 << (self.log - 6), np.uint64)
        self.table[found.column("k").to_numpy()] = found.column("b").to_numpy().view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.log)
        return (self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbouring items, given the items' hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = h[:n].copy()
    for k in range(1, width):
        total *= MULTIPLIER
        total += h[k : k + n]
    return mixed(total)


def valid_texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """Texts of a string or binary column, "" for null; bytes that are not UTF-8 become U+FFFD, in all operators alike."""
    raw = batch.column(column).cast(pa.binary())
    try:
        return pa.compute.fill_null(raw.cast(pa.string()), "")
    except pa.ArrowInvalid:
        return pa.array([(x or b"").decode(errors="replace") for x in raw.to_pylist()], pa.string())


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of :func:`valid_texts`."""
    return valid_texts(batch, column).cast(pa.binary()).to_pylist()


def chunks_of(batch: pa.RecordBatch, size: int) -> list[pa.Array]:
    """The texts of a batch in runs of about ``size`` bytes; a longer text is a run of its own."""
    texts = valid_texts(batch, "text")
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy())
    cuts, at = [0], 0
    while at < len(texts):
        at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        cuts.append(at)
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def mapped(df: DataFrame, make, schema: str, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` with ``make(batch) -> dict of columns`` and a schema in DDL.

    ``make`` may carry state in attributes: it is pickled once for each task. It gets
    ``rows`` rows at most at a time, if given.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder = _holder()
        holder.asked = False
        for batch in batches:
            step = rows or batch.num_rows
            for at in range(0, batch.num_rows, step or 1):
                out = make(batch.slice(at, step))
                if not holder.asked:
                    holder.kept.clear()
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)
