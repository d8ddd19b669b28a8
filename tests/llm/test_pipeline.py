from pyspark.sql import functions as F

import corpus_pipeline
from scholarlens.llm.decontam import leaks
from scholarlens.llm.near_dup import near_duplicates
from scholarlens.llm.quality import quality
from scholarlens.llm.secrets import secret_spans


def test_each_stage_on_its_own_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, first = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := str(tmp_path / str(k)))
        out = spark.read.parquet(path)
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        given = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert out.columns == columns and kept <= given
        if name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            assert kept == {r.doc_id for r in quality(docs, labels).filter("predicted = 1").collect()}
        elif name == "near_duplicates":
            assert kept == {r.doc_id for r in near_duplicates(docs, corpus_pipeline.NEAR).filter("kept").collect()}
        elif name == "decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert given - kept == {r.doc_id for r in leaks(docs, bench).collect()}
        elif name == "secrets":
            assert kept == given and secret_spans(out).filter(F.size("base") > 0).count() == 0
            assert out.filter("n_chars <> length(text)").count() == 0
            same = out.join(first.withColumnRenamed("text", "before"), "doc_id").filter("text = before").count()
            touched = secret_spans(docs).filter(F.size("reported") > 0).count()
            assert same == len(given) - touched
        else:
            assert kept == given
        docs = out


def test_stages_pass_odd_rows_and_empty_tables(spark, sf_dir, tmp_path):
    rows = [(None, None, "en", None, None), (1, None, None, "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "token = abcdefgh12 " * 3, "en", "s", 57),
            (4, "the calm river runs to the sea and rests there for a while", "en", "s", 58), (5, "word " * 50_000, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start, name in ((frame, "odd"), (frame.limit(0), "none")):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(path)
        if name == "none":
            assert docs.count() == 0


def test_run_is_a_registered_query(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf_dir).columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_rows_without_an_id_lose_secrets_and_leaks(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(None, "password = abcdefgh12345 and more", 0), (None, f"Some words. {item}", 0), (None, "a calm river", 0), (7, "a calm river", 0), (7, item, 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    masked = corpus_pipeline.mask_secrets(spark, docs, sf_dir).collect()
    assert len(masked) == 6 and any("<secret>" in (r.text or "") for r in masked) and not any("abcdefgh12345" in (r.text or "") for r in masked)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_leaks(spark, docs, sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([rows[0][:2], rows[2][:2], rows[3][:2], rows[5][:2]], key=str)
