"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left.

Writing. Records with equal payloads of LEAST bytes or more are one response, that of
the least page_id, and revisits of it, which carry no payload. Every task writes its
rows into archives of its own in the shared folder, a gzip member for each record (or
plain records), under a name of their own for each attempt: a task that runs twice
leaves an orphan, and only archives that the manifest names are read.

Reading. A record is taken when all checks hold: the gzip member's checksum and length,
the version line, the fields, the block's length and end, and the digests. Where one
fails, the reader looks for the next place at which a member or a version line begins a
record that passes all checks, goes on from there, and logs the bytes between as a gap.
Members are unpacked in pieces, and no further than the record's own length says, so
damage cannot make a reader unpack without end. One task reads one archive of about
FILE_BYTES and holds one record and a window of the file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import as_array, new_path, stored
from scholarlens.llm.media import open_folder

#: Payloads of so many bytes are kept once.
LEAST = 100
#: An archive is closed once it is longer.
FILE_BYTES = 128 << 20
#: Longest head of a record, and the bytes read at a time.
HEAD, WINDOW = 1 << 16, 1 << 20
#: Rows and payload bytes of one batch of what is read.
ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Fixed values of the format: the first bytes of a gzip member, a version line, ends, the profile of revisits.
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class Damaged(ValueError):
    """Why no record begins at a place."""


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.fields.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        """What follows the head of an HTTP block; other blocks are all payload."""
        if "application/http" in self.fields.get("content-type", ""):
            return self.block.partition(END)[2]
        return self.block


def _line(name: str, value) -> bytes:
    return f"{name}: {value}\r\n".encode()


def safe_url(url: str) -> str:
    """The URL with blanks, controls and line ends as percent codes: it must fit on one line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  \ud800-\udfff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode(errors="surrogatepass")), url)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """The record of a page: a response with its payload, or a revisit of the page ``refers_to``."""
    revisit = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", size) + b"\r\n"
    block = http + (payload or b"")
    lines = [b"WARC/1.1\r\n", _line("WARC-Type", "revisit" if revisit else "response"), _line("WARC-Record-ID", record_id(page_id, digest))]
    lines.append(_line("WARC-Date", DATE))
    if url is not None:
        lines.append(_line("WARC-Target-URI", safe_url(url)))
    if page_id is not None:
        lines.append(_line("Page-ID", page_id))
    lines += [_line("WARC-Payload-Digest", f"sha256:{digest}"), _line("Payload-Length", size)]
    if revisit:
        lines += [_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", record_id(refers_to, digest)), _line("Refers-To-Page-ID", refers_to)]
    lines += [_line("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), b"Content-Type: application/http;msgtype=response\r\n"]
    return b"".join([*lines, _line("Content-Length", len(block)), b"\r\n", block, END])


def info_record() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    lines = [b"WARC/1.1\r\n", _line("WARC-Type", "warcinfo"), _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), _line("WARC-Date", DATE)]
    return b"".join([*lines, b"Content-Type: application/warc-fields\r\n", _line("Content-Length", len(block)), b"\r\n", block, END])


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class Archive:
    """An archive being written."""

    def __init__(self, folder: str, packed: bool):
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        self.packed, self.records, self.bytes = packed, 0, 0
        self.name = f"{uuid.uuid4().hex}.warc" + ".gz" * packed
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self._put(info_record())

    def _put(self, record: bytes) -> None:
        data = member(record) if self.packed else record
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(record)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.name, self.bytes, self.records


_MANIFEST = "file string, bytes long, records long"


def write_archives(rows: DataFrame, folder: str, packed: bool = True) -> DataFrame:
    """Write ``rows`` (page_id, url, payload, payload_bytes, payload_digest, refers_to); the manifest of the archives."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(_MANIFEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, closed = None, []
        for batch in batches:
            names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
            for values in zip(*[batch.column(c) for c in names]):
                if archive is None or archive.bytes > FILE_BYTES:
                    if archive is not None:
                        closed.append(archive.close())
                    archive = Archive(folder, packed)
                archive.add(page_record(*[v.as_py() for v in values]))
        if archive is not None:
            closed.append(archive.close())
        yield pa.RecordBatch.from_arrays([as_array([x[k] for x in closed], f.type) for k, f in enumerate(target)], schema=target)

    return rows.mapInArrow(run, _MANIFEST)


class Source:
    """A file by places, read in windows."""

    def __init__(self, opened, size: int):
        self.opened, self.size, self.at, self.window = opened, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Bytes from ``at``, fewer than ``n`` only at the end of the file."""
        if at < self.at or at + n > self.at + len(self.window):
            self.opened.seek(at)
            self.at, self.window = at, self.opened.read(max(0, min(max(n, WINDOW), self.size - at)))
        return self.window[at - self.at : at - self.at + n]


def _fields(head: bytes) -> dict[str, str]:
    if not VERSION.match(head):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a field without a colon")
        fields.setdefault(name.strip().lower(), value.strip())
    if not re.fullmatch(r"\d{1,15}", fields.get("content-length", ""), re.A):
        raise Damaged("no length")
    return fields


def _checked(fields: dict[str, str], block: bytes) -> Record:
    record = Record(fields, block)
    told = [("warc-block-digest", block)] + ([] if record.kind == "revisit" else [("warc-payload-digest", record.payload)])
    for name, data in told:
        kind, _, digest = fields.get(name, "").partition(":")
        if kind == "sha256" and hashlib.sha256(data).hexdigest() != digest:
            raise Damaged(f"{name[5:]} differs")
    return record


def plain_record(source: Source, at: int) -> tuple[Record, int]:
    """The record that begins at ``at`` and the place after it."""
    head, found, _ = source.read(at, HEAD).partition(END)
    if not VERSION.match(head):
        raise Damaged("no version line")
    if not found:
        raise Damaged("no end of the head")
    fields, begin = _fields(head), at + len(head) + len(END)
    size = int(fields["content-length"])
    if source.read(begin + size, len(END)) != END:
        raise Damaged("no end of the record")
    return _checked(fields, source.read(begin, size)), begin + size + len(END)


def packed_record(source: Source, at: int) -> tuple[Record, int]:
    """The record of the gzip member that begins at ``at`` and the place after it."""
    unpacker, out, fed, fields, whole = zlib.decompressobj(31), bytearray(), at, None, HEAD
    while not unpacker.eof:
        data = unpacker.unconsumed_tail
        if not data:
            data = source.read(fed, min(HEAD, source.size - fed))
            fed += len(data)
            if not data:
                raise Damaged("the member ends early")
        try:
            out += unpacker.decompress(data, HEAD)
        except zlib.error:
            raise Damaged("the member does not unpack") from None
        if fields is None:
            if not VERSION.match(out[:10]) and len(out) >= 10:
                raise Damaged("no version line")
            cut = out.find(END)
            if cut >= 0:
                fields = _fields(bytes(out[:cut]))
                begin = cut + len(END)
                whole = begin + int(fields["content-length"]) + len(END)
        if len(out) > whole:
            raise Damaged("the member is longer than its record" if fields else "no end of the head")
    if fields is None or len(out) != whole or not out.endswith(END):
        raise Damaged("no end of the record")
    return _checked(fields, bytes(out[begin : -len(END)])), fed - len(unpacker.unused_data)


def record_at(source: Source, at: int) -> tuple[Record, int]:
    if source.read(at, len(GZIP)) == GZIP:
        return packed_record(source, at)
    return plain_record(source, at)


_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_LONGEST = 10


def next_record(source: Source, at: int) -> tuple[int, Record, int] | None:
    """(place, record, place after it) of the first record from ``at`` on that passes all checks."""
    while at < source.size:
        data = source.read(at, WINDOW)
        last = at + len(data) >= source.size
        for found in _START.finditer(data):
            try:
                return (at + found.start(), *record_at(source, at + found.start()))
            except Damaged:
                continue
        if last:
            return None
        # a start may lie across the end of the window
        at += len(data) - _LONGEST + 1
    return None


def salvage(source: Source) -> Iterator[tuple[int, int, Record | None, str | None]]:
    """(start, end, record, None) of each record and (start, end, None, reason) of each gap, in order and without holes."""
    at = 0
    while at < source.size:
        try:
            record, end = record_at(source, at)
        except Damaged as why:
            found = next_record(source, at + 1)
            yield at, found[0] if found else source.size, None, str(why)
            if found is None:
                return
            at, record, end = found
        yield at, end, record, None
        at = end


_READ = (
    "file string, start long, end long, gap string, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,18}", text, re.A) else None


def _row(file: str, start: int, end: int, record: Record | None, gap: str | None, payloads: bool) -> tuple:
    if record is None:
        return (file, start, end, gap, *[None] * 7)
    field = record.fields.get
    if record.kind == "revisit":
        size, digest, payload = _number(field("payload-length")), field("warc-payload-digest", "").removeprefix("sha256:") or None, None
    else:
        payload = record.payload
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return (
        file, start, end, None, record.kind, _number(field("page-id")), field("warc-target-uri"), size, digest,
        _number(field("refers-to-page-id")), payload if payloads else None,
    )


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """All records and gaps of the archives (file, bytes) in ``folder``.

    A gap has its reason in ``gap`` and nothing but file, start and end besides; a
    revisit's size and digest are those its record tells. Archives that are empty have
    no rows. Payloads are returned on demand.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(_READ))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([as_array([x[k] for x in rows], f.type) for k, f in enumerate(target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        rows, held = [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                # the file's own size: a damaged archive may differ from what the manifest tells
                with files.open_input_file(f"{path}/{file}") as opened:
                    for place in salvage(Source(opened, opened.size())):
                        rows.append(_row(file, *place, payloads))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) >= ROWS or held >= BATCH_BYTES:
                            yield made(rows)
                            rows, held = [], 0
        yield made(rows)

    files = manifest.select("file")
    # names are a few bytes, so without a number the archives would all go to one task
    return files.repartition(max(1, files.count())).mapInArrow(run, _READ)


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of ``pages``; payloads of revisits are null.

    Only digests and ids are grouped; the join with the groups of more than one row may split hot digests.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    groups = rows.filter(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(groups.filter("n > 1 and first is not null").drop("n"), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(revisit, F.col("first")).alias("refers_to"),
    )


def archived(pages: DataFrame, folder: str | None = None, packed: bool = True) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to WARC archives and read them back, a row for each page.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, file and
    start. Null html counts as empty; a null url gives a record without one, blanks and
    line ends in urls become percent codes. Of rows with equal payloads of 100 bytes or
    more, all with the least page_id are responses (a repeated row is a response like
    its twin); rows without a page_id revisit that one, and are responses if no row of
    theirs has one. Other columns are ignored. A gap in archives just written is an
    error. ``folder`` is a shared folder, by default a new one beside the checkpoints.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    manifest = stored(write_archives(page_records(pages), folder, packed), "warc-manifest")
    read = stored(read_archives(manifest, folder).drop("payload", "url"), "warc-read")
    gap = read.filter("gap is not null").first()
    if gap is not None:
        raise ValueError(f"{folder}/{gap.file} cannot be read from {gap.start} to {gap.end}: {gap.gap}")
    told = read.filter("record_type in ('response', 'revisit')")
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "start")
