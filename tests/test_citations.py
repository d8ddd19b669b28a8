import duckdb

from scholarlens.plans.search import _CITED, citation_edges


def test_short_targets_are_found_as_the_oracle_finds_them(spark):
    docs = [(1, "We follow Deep Rivers of Europe, and more."), (2, "deep rivers"), (3, "one two three four five six seven eight nine"), (4, None), (5, ""),
            (6, "rivers of europe deep")]
    items = [(10, "Deep rivers of Europe"), (11, "two three four five six seven eight"), (12, "one two three four five six seven eight ten"), (13, "deep"),
             (14, None), (15, "!"), (16, "seven eight nine ten")]
    got = citation_edges(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    with duckdb.connect() as connection:
        connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        connection.executemany("INSERT INTO documents VALUES (?, ?)", docs)
        connection.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
        expect = set(connection.execute(f"WITH {_CITED} SELECT citing, cited FROM edges").fetchall())
    assert {(1, 10), (3, 11)} <= expect and {(r.citing, r.cited) for r in got.collect()} == expect
