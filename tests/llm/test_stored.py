import os

from pyspark.sql import functions as F

from scholarlens.llm.common import stored


def test_shuffle_files_that_led_to_a_stored_table_are_removed(spark):
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in root for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = files()
    table = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert not files() - before
    assert table.agg(F.sum("count")).first()[0] == 1000


def test_tasks_that_keep_nothing_let_go_of_what_others_kept(spark):
    import sys

    from scholarlens.llm.common import kept_in_worker, mapped

    def keeps(batch):
        kept_in_worker(("a",), lambda: [0])
        return {"n": [batch.num_rows]}

    def asks_not(batch):
        return {"n": [batch.num_rows]}

    def left(batch):
        kept = sys.modules["_kept_between_tasks"].kept
        return {"n": [len(kept)]}

    frame = spark.range(0, 2_500, 1, 1)
    assert [r.n for r in mapped(frame, keeps, "n long", 1_000).collect()] == [1_000, 1_000, 500]
    assert {r.n for r in mapped(frame, left, "n long").collect()} <= {0, 1}
    mapped(frame, keeps, "n long").collect()
    mapped(frame, asks_not, "n long").collect()
    assert [r.n for r in mapped(frame, left, "n long").collect()] == [0]
