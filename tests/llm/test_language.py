"""Language identification: held-out accuracy, calibration and odd inputs."""

import zlib

from pyspark.sql import functions as F

from utterscope.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op6(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    right = [r.lang_pred == truth[r.doc_id] for r in held]
    assert sum(right) / len(right) > 0.97
    # the calibrated probability is about as often right as it says
    assert abs(sum(r.score for r in held) / len(held) - sum(right) / len(right)) < 0.05


def test_odd_rows(odd_docs, no_docs):
    got = language.learn_and_predict(odd_docs).collect()
    assert len(got) == 9 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [True]
    assert language.learn_and_predict(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.learn_and_predict(unlabelled).collect()} == {("und", 0.0)}


def test_only_the_text_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = language.fold_of()
    model = language.fit_language_model(docs.where(fold != 0), 50, calibrate=fold == 1)
    first = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_language(docs, model).collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    assert first == {r.doc_id: (r.lang_pred, r.score) for r in language.predict_language(other, model).collect()}
    assert (model.weights == 0).mean() > 0.1  # the penalty leaves weights at zero


def test_stretches_of_a_long_text_have_the_same_grams(monkeypatch):
    text = "Straße über allem, élan vital " * 50
    whole = sorted(x for g in language.gram_buckets(text) for x in g.tolist())
    monkeypatch.setattr(language, "SEGMENT", 64)
    cut = [x for g in language.gram_buckets(text) for x in g.tolist()]
    assert set(cut) == set(whole)


def test_rejected_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = docs.limit(3).withColumn("text", F.lit("123 ... 456"))
    assert language.keep_identified(docs.union(junk), sample_per_language=50).count() == docs.count()
