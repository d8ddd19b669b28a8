"""Media columns: content-addressed payloads in tar shards, metadata from range reads of headers.

Writing. Every task writes the payloads of its rows, as grey 8-bit PNG images,
into one tar file in the shared folder, under the digest of the stored form;
a payload that the task has already written is not written again. Rows get the
digest, the shard and the place of the payload in it.

One address for a digest. The least (shard, offset) of a digest is the address
that all rows of it carry, so equal payloads are read once.

Reading. The distinct addresses are dealt by shard. A first range read of the
fixed-size head of each image fills the metadata columns; a second one of the
whole member gives the samples back, from which the features come.

Shards are written through pyarrow's file systems under a name of their own for
each attempt, so a task that runs twice leaves an orphan and never a torn file.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import as_array, byte_texts, new_path, stored

BLOCK, WIDTH, LEVEL = 64, 64, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEAD = 33
SHARD_BYTES = 256 << 20


def payload_of(text: bytes) -> bytes:
    """The bytes of a text, filled up with zeros to a positive multiple of BLOCK."""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image, WIDTH samples a row, without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_head(data: bytes) -> dict:
    """Width, height, bit depth and colour type from the first HEAD bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour": colour}


def from_png(data: bytes) -> bytes:
    """The samples of an image made by :func:`to_png`; checks every chunk."""
    head, at, parts = png_head(data), len(SIGNATURE), []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(head["height"], head["width"] + 1)
    return lines[:, 1:].tobytes()


def open_folder(url: str):
    """(pyarrow file system, path) of a folder by its URL; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if ":" in url.split("/")[0] else (fs.LocalFileSystem(), url)


class Shard:
    """A tar file being written; members are named by digest and found by offset and length."""

    def __init__(self, folder: str):
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.out, self.at, self.places = files.open_output_stream(f"{path}/{self.name}"), 0, {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(format=tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % tarfile.BLOCKSIZE))
            self.places[digest] = (self.at + len(head), len(data))
            self.at += len(head) + -(-len(data) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
        return self.places[digest]

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()


_PLACES = "doc_id long, n_bytes long, media_sha256 string, shard string, offset long, media_bytes long"


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads of ``docs`` (doc_id, text) to tar shards; a row for each with its place."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(_PLACES))

    def run(batches):
        shard = None
        for batch in batches:
            rows = []
            for text in byte_texts(batch, "text"):
                if shard is None or shard.at > SHARD_BYTES:
                    if shard is not None:
                        shard.close()
                    shard = Shard(folder)
                image = to_png(payload_of(text))
                digest = hashlib.sha256(image).hexdigest()
                rows.append((len(text), digest, shard.name, *shard.add(digest, image)))
            columns = list(zip(*rows)) or [[]] * 5
            values = [batch.column("doc_id"), *columns]
            yield pa.RecordBatch.from_arrays([as_array(v, f.type) for v, f in zip(values, target)], schema=target)
        if shard is not None:
            shard.close()

    return docs.mapInArrow(run, _PLACES)


def features_of(samples: bytes) -> str:
    """Mean, spread and entropy of the samples, and their share above 127."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / counts.sum()
    values = np.arange(256)
    mean = float(share @ values)
    spread = float(np.sqrt(max(0.0, share @ (values - mean) ** 2)))
    used = share[share > 0]
    entropy = float(-(used @ np.log2(used)))
    return f"mean={mean:.4f};sd={spread:.4f};entropy={entropy:.4f};high={share[128:].sum():.4f}"


_READ = (
    "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "feature string, width int, height int, bit_depth int"
)


def read_shards(places: DataFrame, folder: str) -> DataFrame:
    """Metadata and features of distinct payloads (media_sha256, shard, offset, media_bytes), by range reads.

    A member whose bytes do not have the digest that names it fails the task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(_READ))

    def run(batches):
        files, path = open_folder(folder)
        opened, name = None, None
        for batch in batches:
            rows = []
            for place in batch.to_pylist():
                if place["shard"] != name:
                    if opened is not None:
                        opened.close()
                    name = place["shard"]
                    opened = files.open_input_file(f"{path}/{name}")
                opened.seek(place["offset"])
                head = png_head(opened.read(HEAD))
                opened.seek(place["offset"])
                data = opened.read(place["media_bytes"])
                if hashlib.sha256(data).hexdigest() != place["media_sha256"]:
                    raise ValueError(f"{name} at {place['offset']} does not hold {place['media_sha256']}")
                samples = from_png(data)
                rows.append(
                    (
                        place["media_sha256"],
                        len(samples),
                        hashlib.sha256(samples).hexdigest(),
                        zlib.crc32(samples[-BLOCK:]),
                        features_of(samples),
                        head["width"],
                        head["height"],
                        head["bit_depth"],
                    )
                )
            columns = list(zip(*rows)) or [[]] * len(target)
            yield pa.RecordBatch.from_arrays([as_array(v, f.type) for v, f in zip(columns, target)], schema=target)
        if opened is not None:
            opened.close()

    ordered = places.repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(run, _READ)


def extract(shard: bytes) -> dict[str, bytes]:
    """All members of a shard by name, with the standard tar reader."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar}


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text) as an image in tar shards and return its media columns.

    Null texts count as empty and are stored as one block of zeros. Null ids and
    repeated rows keep a row each; equal texts have one address and equal values.
    Other columns are ignored. ``folder`` is a shared folder, by default a new one
    beside the session's checkpoints.
    """
    folder = folder or new_path(docs.sparkSession, "media")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    places = stored(write_shards(rows, folder), "places")
    address = places.groupBy("media_sha256").agg(F.min(F.struct("shard", "offset")).alias("at"), F.first("media_bytes").alias("media_bytes"))
    address = address.select("media_sha256", "at.shard", "at.offset", "media_bytes")
    # read once and keep: the join below would read again for a lost executor
    read = stored(read_shards(address, folder), "features")
    known = read.join(address, "media_sha256")
    joined = places.select("doc_id", "n_bytes", "media_sha256").join(known, "media_sha256")
    return joined.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        "shard",
        "offset",
        "width",
        "height",
        "bit_depth",
    )
