import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from scholarlens import registry
from scholarlens.operators.author_lines import detected_authors, in_page_order
from tests.oracles import TABLES, oracle_rows, rows_of

T = "Smart Farm Monitoring System\nfor Small Towns"
#: (title page, names): marked and unmarked blocks, and pages on which nobody can be told.
LAYOUTS = [
    (f"{T}\n\nby\n\nJuan Dela Cruz\nMaria Santos\n\n\n\nThe work", ["Juan Dela Cruz", "Maria Santos"]),
    (f"{T}\nSubmitted by: Juan P. Cruz\nMaria Santos", ["Juan P. Cruz", "Maria Santos"]),
    (f"{T}\nResearchers:\nCruz, Juan P. Santos, Maria L.\nLim, Ana", ["Cruz, Juan P.", "Santos, Maria L.", "Lim, Ana"]),
    (f"{T}\nResearchers used the old way.\nCruz, Juan P.\nSantos, Maria L.", []),
    (f"{T}\nby\nJuan Cruz juan@psu.edu.ph 09171234567\nMaria Santos\nINTRODUCTION\nPedro Reyes", ["Juan Cruz", "Maria Santos"]),
    (f"{T}\nby\n\n\n\nJuan Cruz", []),
    (f"{T}\nBY SMART SENSORS AND EARLY WARNING\nby\nAna Lim", ["Ana Lim"]),
    (f"{T}\nAbstract\nby\nAna Lim", []),
    (f"{T}\nby\nAna Lim\nANA LIM\nana reyes", ["Ana Lim"]),
    (f"{T}\nprepared by Maria Clara Santos and others of the town", []),
    (f"{T}\n\nCRUZ, JUAN PEDRO\nSANTOS, MARIA CLARA\n\nA Thesis Presented to the Faculty", ["CRUZ, JUAN PEDRO", "SANTOS, MARIA CLARA"]),
    (f"{T}\nPEDRO LUIS B. LUNA, Don Honorio Ventura State University\nMARIO PAUL B. REYES, Don Honorio Ventura State University", ["PEDRO LUIS B. LUNA", "MARIO PAUL B. REYES"]),
    (f"{T}\nJuan P. Cruz\nPampanga State University\njuan@psu.edu.ph\nMaria L. Santos\nBarangay Uno, Mexico, Pampanga\n0917 123 4567\nJose R. Lim\nAdviser: Ana M. Reyes\nPio T. Go", ["Juan P. Cruz", "Maria L. Santos", "Jose R. Lim"]),
    (f"{T}\nJuan P. Cruz\n\nThe rest", []),
    (f"{T}\nSome other line\nJuan P. Cruz\nMaria L. Santos", []),
    (f"{T}\nJuan P. Cruz\n\n\n\n\nMaria L. Santos", []),
    (f"{T}\nJuan P. Cruz\nMaria L. Santos\nMay 2024\nJose R. Lim", ["Juan P. Cruz", "Maria L. Santos"]),
    ("Another Title\nJuan P. Cruz\nMaria L. Santos", []),
    (f"University of the Town\n{T}\nJuan Cruz III\nMaria L. Santos", ["Juan Cruz III", "Maria L. Santos"]),
    (f"{T}\nby\n" + "\n".join(f"Name{chr(65 + k)} Of{chr(97 + k)} Reyes".replace("Of", "Of") for k in range(15)), None),
    (f"{T}\nby\nJosé Ñúñez\nO'Neil Santos-Lim\n12 Main Street", ["José Ñúñez", "O'Neil Santos-Lim"]),
    ("", []), (None, []), ("by\nAna Lim", ["Ana Lim"]), ("x\n" * 200 + "by\nAna Lim", []),
]


def test_authors_of_many_layouts(spark):
    rows = spark.createDataFrame([(k, t, "Smart Farm Monitoring System for Small Towns") for k, (t, _) in enumerate(LAYOUTS)], "id int, body string, title string")
    got = {r.id: r.found_authors for r in detected_authors(rows, "body", "title").collect()}
    for k, (page, names) in enumerate(LAYOUTS):
        if names is None:
            assert len(got[k]) == 12, got[k]
        else:
            assert got[k] == names, (k, page, got[k])
    bare = detected_authors(rows.withColumn("title", F.lit(None).cast("string")), "body", "title").filter("id = 10").first()
    assert bare.found_authors == [] and detected_authors(rows.limit(0), "body", "title").collect() == []


#: (title, page, names): titles that begin or end as a marker, a heading or a name does.
TITLES = [
    ("By Farms Of Towns. A.", "By Farms Of Towns. A.\nby\n\nJuan Cruz\nMaria Santos", ["Juan Cruz", "Maria Santos"]),
    ("By The Town", "By The Town\nSubmitted by: Juan Cruz", ["Juan Cruz"]),
    ("By", "By\nby\nJuan Cruz", ["Juan Cruz"]),
    ("Abstract Art of Towns", "Abstract Art of Towns\nby\nJuan Cruz", ["Juan Cruz"]),
    ("Introduction", "\nIntroduction\nResearchers: Cruz, Juan P. Santos, Maria", ["Cruz, Juan P.", "Santos, Maria"]),
    ("Smart Farms by the Sea and\nby Ana Lim", "Head\nSmart Farms by the Sea and\n\nby Ana Lim\nby\nJuan Cruz", ["Juan Cruz"]),
    ("By Ana Lim", "By Ana Lim\nJuan P. Cruz\nMaria L. Santos", ["Juan P. Cruz", "Maria L. Santos"]),
    ("By Ana Lim", "By Ana Lim\nthe work", []),
    ("Other", "By Ana Lim\nJuan Cruz", ["Ana Lim", "Juan Cruz"]),
    ("Farms", "by Ana Lim\nFarms\nJuan P. Cruz", ["Ana Lim"]),
    ("Farms", "Farms\nAbstract\nby\nJuan Cruz", []),
]


def test_lines_of_the_title_are_no_markers(spark):
    rows = spark.createDataFrame([(k, t, p) for k, (t, p, _) in enumerate(TITLES)], "id int, title string, body string")
    got = {r.id: r.found_authors for r in detected_authors(rows, "body", "title").collect()}
    assert got == {k: names for k, (_, _, names) in enumerate(TITLES)}


def test_author_blocks_equal_their_sql_whatever_a_title_begins_with(spark, sf_dir, tmp_path):
    heads = ["By steant hewh be ininen. Onthes atst. To. A.", "By The Hewh", "BY", "Abstract of it", "ABSTRACT", "Introduction.", "Submitted by Dr. Hewh", "Prepared by", "Chapter 1", "By: Hewh, A.", "The old way"]
    texts = [f"{head}\nthtiones thedthtion erinnde whntther thingand" for head in heads for _ in range(4)] + [None, "", "by"]
    labels = [i for i in range(0, len(texts), 3)] + [0, 9]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": labels, "quality": [1] * len(labels)}), tmp_path / "labels.parquet")
    for name in set(TABLES) - {"documents", "labels"}:
        os.symlink(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    want = oracle_rows(registry.oracle_sql()["author_blocks"], str(tmp_path))
    assert len(want[1]) == 46 and rows_of(registry.queries()["author_blocks"](spark, str(tmp_path))) == want


def test_order_on_the_page(spark):
    cases = [
        (["B C", "A B"], ["x A.B. y", "B C"], ["A B", "B C"]),
        (["B C", "A B"], ["B C and A B"], ["B C", "A B"]),
        (["B C", "Z Z"], ["A", "B C"], ["B C", "Z Z"]),
        (["B C", "b c"], ["B C"], ["B C", "b c"]),
        (["A"], ["A"], ["A"]), ([], ["A"], []), (["B", "A"], [], ["B", "A"]), (["B", "..."], ["...", "B"], ["B", "..."]),
    ]
    frame = spark.createDataFrame([(k, n, r) for k, (n, r, _) in enumerate(cases)], "id int, n array<string>, r array<string>")
    got = {x.id: x.o for x in frame.select("id", in_page_order(F.col("n"), F.col("r")).alias("o")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}
