import pytest

from scholarlens.plans.groups import group_count, topic_groups
from scholarlens.sources.sinks import append_new, file_fault, kept_result, updated


def test_append_passes_over_known_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert append_new(rows, path, ["k"]).count() == 2
    assert sorted(r.k for r in append_new(spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string"), path, ["k"]).collect()) == [1, 2, 3]


def test_a_manifest_is_taken_whole_or_refused(spark):
    table = spark.createDataFrame([(1, "A", 7), (2, "B", 8)], "id int, code string, other int")
    codes = spark.createDataFrame([("A",), ("B",), ("C",)], "code string")
    make = lambda *rows: spark.createDataFrame(list(rows), "id int, code string")
    assert sorted(map(tuple, updated(table, make((1, "C")), codes).collect())) == [(1, "C", 7), (2, "B", 8)]
    for bad in (make((1, "Z")), make((9, "A")), make((1, "A"), (1, "B"))):
        with pytest.raises(ValueError, match="refused"):
            updated(table, bad, codes)


def test_results_are_made_once(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.range(3)

    assert [kept_result(spark, str(tmp_path), "f1", compute).count() for _ in range(2)] == [3, 3] and len(made) == 1
    kept_result(spark, str(tmp_path), "f2", compute)
    assert len(made) == 2


def test_file_faults(spark):
    rows = [("a.pdf", b"%PDF-1.7"), ("a.PDF", b"PK\x03\x04"), ("a.jpeg", b"\xff\xd8\xff\xe0"), ("a.exe", b"MZ"), ("a.docx", b""), ("a.png", None)]
    frame = spark.createDataFrame(rows, "name string, content binary")
    assert [r.f for r in frame.select(file_fault("name", "content").alias("f")).collect()] == [None, "content_mismatch", None, "unsupported_type", "empty_file", "empty_file"]


def test_group_counts():
    assert [group_count(n) for n in (0, 1, 4, 5, 35, 36, 47, 48, 1000)] == [1, 1, 4, 5, 5, 6, 7, 8, 8]


def test_groups_cover_all_works(spark, sf_dir):
    rows = topic_groups(spark, sf_dir).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.group_id, []).append(r.size)
    assert len({r.id for r in rows}) == len(rows) and all(len(v) == v[0] for v in sizes.values())
    assert [len(sizes[k]) for k in sorted(sizes)] == sorted((len(v) for v in sizes.values()), reverse=True)
