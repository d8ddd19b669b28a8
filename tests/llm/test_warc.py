import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import Row

from scholarlens.llm import warc
from scholarlens.llm.queries import ORACLES, op13_warc
from tests.oracles import oracle_rows, rows_of


class Bytes:
    """A file at hand; counts the bytes read."""

    def __init__(self, data):
        self.data, self.at, self.count = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.count += len(out)
        return out


def read(data):
    return list(warc.salvage(warc.Source(Bytes(data), len(data))))


def records(n, packed, seed=0, sizes=(0, 3000)):
    """Records of pages with random letters, as they stand in an archive."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        payload = bytes(rng.choices(b"abcdefgh \n", k=rng.randint(*sizes)))
        record = warc.page_record(k, f"http://x/{k}", payload, len(payload), hashlib.sha256(payload).hexdigest(), None)
        out.append(warc.member(record) if packed else record)
    return out


def ids(found):
    return [int(r.fields["page-id"]) for _, _, r, _ in found if r]


def holes(found, size):
    """No byte is passed over: records and gaps follow each other without holes."""
    assert [a for a, *_ in found] == [0, *[b for _, b, *_ in found]][:-1] and (found[-1][1] if found else 0) == size


def test_round_trip_equals_sql(spark, sf_dir):
    assert rows_of(op13_warc(spark, sf_dir)) == oracle_rows(ORACLES["op13_warc"], sf_dir)


@pytest.mark.parametrize("packed", [True, False])
def test_each_damage_costs_its_record_alone(packed):
    parts = records(9, packed)
    starts = [sum(map(len, parts[:k])) for k in range(10)]
    rng = random.Random(3)
    for k in range(9):
        for _ in range(6):
            at = rng.randrange(len(parts[k]))
            if packed and 4 <= at <= 9:
                continue  # time, flags and system of a member's head are no part of its checks
            broken = bytearray(parts[k])
            broken[at] ^= 1 << rng.randrange(8)
            data = b"".join([*parts[:k], bytes(broken), *parts[k + 1 :]])
            found = read(data)
            holes(found, len(data))
            gaps = [(a, b) for a, b, r, _ in found if r is None]
            if not gaps:
                # fields that no digest covers may change and stay a record
                assert not packed and len(ids(found)) >= 8
                continue
            assert gaps == [(starts[k], starts[k + 1])] and ids(found) == [i for i in range(9) if i != k]


@pytest.mark.parametrize("packed", [True, False])
def test_cuts_and_rubbish(packed):
    parts = records(6, packed)
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    cut = len(parts[2]) // 2
    lost = b"".join([*parts[:2], parts[2][:cut], *parts[3:]])
    found = read(lost)
    assert ids(found) == [0, 1, 3, 4, 5] and [(a, b) for a, b, r, _ in found if r is None] == [(starts[2], starts[2] + cut)]
    short = whole[: starts[5] + 10]
    found = read(short)
    assert ids(found) == [0, 1, 2, 3, 4] and found[-1][:2] == (starts[5], len(short)) and found[-1][3]
    for rubbish in (b"\0" * 50, b"WARC/1.1\r\nno field", b"\x1f\x8b\x08 no member", random.Random(1).randbytes(3 * warc.WINDOW // 2), b"WARC/1.0\r\nContent-Length: 999999999\r\n\r\n"):
        data = rubbish + parts[0] + rubbish + rubbish + parts[1] + rubbish
        found = read(data)
        holes(found, len(data))
        assert ids(found) == [0, 1] and sum(r is None for _, _, r, _ in found) == 3
    assert read(b"") == [] and ids(read(b"nothing here")) == []


def test_starts_across_windows(monkeypatch):
    """A record is found wherever a window of the search ends."""
    monkeypatch.setattr(warc, "WINDOW", 64)
    for packed in (True, False):
        part = records(1, packed, sizes=(200, 200))[0]
        for n in range(40, 140):
            assert ids(read(b"?" * n + part)) == [0]


def test_members_that_claim_more():
    """A member that goes on after its record, or whose length is wrong, is a gap and is not unpacked to its end."""
    payload = b"x" * 500
    record = warc.page_record(1, None, payload, 500, hashlib.sha256(payload).hexdigest(), None)
    large = warc.member(record + bytes(50 << 20))
    good = records(1, True)[0]
    found = read(large + good)
    assert ids(found) == [0] and found[0][3] == "the member is longer than its record"
    assert read(warc.member(record.replace(b"Content-Length: 5", b"Content-Length: 6")))[0][3]
    assert read(zlib.compressobj(6, zlib.DEFLATED, 31).flush())[0][2] is None


def test_marks_inside_payloads_cost_no_reading():
    """Version lines that claim long blocks are refused by a look at the block's end."""
    fake = b"WARC/1.0\r\nContent-Length: 900000\r\n\r\n" * 2000
    data = b"?" + fake + bytes(1 << 20) + records(1, False)[0]
    source = Bytes(data)
    assert ids(list(warc.salvage(warc.Source(source, len(data))))) == [0]
    assert source.count < 5_000 * warc.WINDOW


@pytest.mark.parametrize("packed", [True, False])
def test_pages_of_all_kinds(spark, tmp_path, packed):
    long = "é" * 60
    rows = [(5, "u", long), (3, "a b\r\nWARC/1.1", long), (9, None, long), (None, "u", long), (3, "again", long), (1, "u", None), (2, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "y" * 100), (8, "u", "y" * 100), (10, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 9), (None, "u", "z" * 200), (11, "u", "ß" * 3_000_000)]
    frame = spark.createDataFrame([Row(payload="p", file=1, start=i, first="f", n=2, page_id=a, url=b, html=c) for i, (a, b, c) in enumerate(rows)], "payload string, file long, start long, first string, n long, page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(frame, str(tmp_path / "w"), packed).collect()), key=repr)
    expect = []
    for a, _, c in rows:
        data = (c or "").encode()
        same = [x for x, _, y in rows if (y or "").encode() == data and x is not None]
        first = min(same) if same and len(data) >= 100 else None
        revisit = first is not None and a != first
        expect.append((a, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(expect, key=repr)
    assert warc.archived(frame.limit(0)).collect() == []


def test_damaged_archives_on_disk(spark, tmp_path, monkeypatch):
    """Many archives, of which one is cut and one has a hole: rows of all others, and the gaps with their places."""
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    rows = [(k, f"http://h/{k}", f"{k} " * random.Random(k).randint(50, 400)) for k in range(120)]
    folder = str(tmp_path / "w")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(warc.page_records(pages), folder)
    manifest = spark.createDataFrame(manifest.collect())
    files = sorted((r for r in manifest.collect() if r.records >= 3), key=lambda r: r.file)
    assert manifest.count() > 3
    for r, change in zip(files[:2], (lambda d: d[:-7], lambda d: d[:400] + bytes(30) + d[430:])):
        path = f"{folder}/{r.file}"
        data = open(path, "rb").read()
        with open(path, "wb") as out:
            out.write(change(data))
    read_back = warc.read_archives(manifest, folder, payloads=True).collect()
    gaps = [r for r in read_back if r.gap is not None]
    assert {r.file for r in gaps} == {r.file for r in files[:2]} and all(r.payload is None and r.end > r.start for r in gaps)
    assert {g.end for g in gaps if g.file == files[0].file} == {os.path.getsize(f"{folder}/{files[0].file}")}
    texts = {k: t for k, _, t in rows}
    good = [r for r in read_back if r.record_type == "response"]
    assert all(r.payload.decode() == texts[r.page_id] and r.url == f"http://h/{r.page_id}" for r in good)
    hurt = sum(r.records for r in files[:2])
    assert 120 - hurt < len(good) < 120
