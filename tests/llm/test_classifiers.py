import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from scholarlens.llm.quality import FEATURES, Encoder, Model as QualityModel, accepted, quality
from scholarlens.llm.toxicity import Model, subwords, threshold, toxicity, train


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def medium(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize(("score", "label", "cut", "least"), [(toxicity, "toxic", 0.5, 0.94), (quality, "quality", 0.3, 0.98)])
def test_held_out_accuracy(spark, medium, score, label, cut, least):
    docs, labels = medium
    wanted = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == held_out(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    judged = [r.predicted == wanted[r.doc_id] for r in rows if r.held_out and r.doc_id in wanted]
    assert len(judged) > 500 and np.mean(judged) > least


def small(spark, label):
    good = [(k, f"the calm river number {k} runs to the sea and rests") for k in range(40)]
    bad = [(100 + k, f"THE!! worthless$$$ idiot### {k} SCUM!! trash&&& MORON!!") for k in range(40)]
    docs = [Row(score="x", text=t, doc_id=i, held_out=1) for i, t in good + bad]
    docs += [Row(score="x", text=t, doc_id=i, held_out=1) for i, t in ((None, "some text"), (901, None), (902, ""), (902, ""), (903, "idiot " * 30_000))]
    marks = [(i, int(label == "quality")) for i, _ in good] + [(i, int(label == "toxic")) for i, _ in bad]
    marks += [(5, 0), (5, 1), (None, 1), (901, 1), (7777, 0)]
    frame = spark.createDataFrame(docs, "score string, text string, doc_id long, held_out int")
    return frame, spark.createDataFrame(marks, f"doc_id long, {label} int")


@pytest.mark.parametrize(("score", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_edge_cases(spark, score, label):
    docs, labels = small(spark, label)
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].held_out is None
    assert by[901][0].score == by[902][0].score == by[902][1].score
    assert label != "toxic" or by[903][0].predicted == 1
    right = [by[k][0].predicted == int(label == "quality") for k in range(40)] + [by[100 + k][0].predicted == int(label == "toxic") for k in range(40)]
    assert np.mean(right) > 0.95
    assert score(docs.limit(0), labels).collect() == []
    assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
    one = labels.filter(f"{label} = 1")
    assert all(r.predicted == 1 for r in score(docs, one).collect())


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = small(spark, "toxic")
    fold = [i for i in range(40) if held_out(i)]
    flipped = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({','.join(map(str, fold))}) THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(str, toxicity(docs, labels).collect())) == sorted(map(str, toxicity(docs, flipped).collect()))


def test_a_misspelling_shares_vectors_with_the_word():
    same = set(subwords(b"worthless")) & set(subwords(b"worthles"))
    assert len(same) > len(subwords(b"worthles")) / 2
    texts = [b"a calm day by the sea"] * 20 + [b"you worthless idiot there"] * 20
    model = train([t + b" %d" % k for k, t in enumerate(texts)], np.repeat([0, 1], 20))
    assert model.word_score(b"worthles") > model.word_score(b"sea")
    assert isinstance(model, Model)


def test_threshold_parts_the_classes():
    assert threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == pytest.approx(0.5)


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(0)
    model = QualityModel(features=5, hidden=4, attention=3)
    x, starts, labels, weights = rng.normal(size=(9, 5)), np.array([0, 2, 5]), np.array([1, 0, 1]), np.ones(3)

    def loss():
        logit, _ = model.forward(x, starts)
        return float((np.log1p(np.exp(logit)) - labels * logit).mean())

    for name, grad in model.gradients(x, starts, labels, weights).items():
        flat = model.p[name].reshape(-1)
        for k in range(0, len(flat), 3):
            keep = flat[k]
            flat[k] = keep + 1e-5
            up = loss()
            flat[k] = keep - 1e-5
            down = loss()
            flat[k] = keep
            assert (up - down) / 2e-5 == pytest.approx(grad.reshape(-1)[k], abs=1e-6)


def test_passages_cover_whole_texts():
    encode = Encoder(passage=10)
    assert encode(b"").shape[0] == 1 and encode(b"one").shape[0] == 1
    assert encode(b"w " * 1000).shape[0] == 100
    # junk at the very end of a long text still shows in its last passage
    assert encode(b"word " * 990 + b"X%%% " * 10)[-1][7] > 0


def test_features_of_many_texts_are_those_of_each():
    texts = ["", "one", "  Calm RIVER calm\tRiver\n", "x! " * 145, "", "É\u00a0x a|b ##! " * 90, "   ", "w " * 130]
    features, first = Encoder().all(pa.array(texts))
    for text, part in zip(texts, np.split(features, first[1:])):
        assert np.array_equal(part, Encoder()(text.encode()))
    calm = dict(zip(FEATURES, features[first[2]]))
    assert (calm["words_distinct"], calm["pieces_distinct"], calm["all_upper"], calm["words_repeated"]) == (0.5, 0.5, 0.25, 0)
    assert [len(x) for x in np.split(features, first[1:])] == [1, 1, 1, 3, 1, 4, 1, 2] and not features[0].any()


def test_accepted_keeps_columns(spark):
    docs, labels = small(spark, "quality")
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id < 40").count() == 40 and kept.filter("doc_id between 100 and 139").count() == 0
