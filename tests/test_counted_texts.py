"""Fits and scores over term counts that are made once."""
import numpy as np
import pytest
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import functions as F

from utterscope.config import TrainingSettings
from utterscope.operators import jobs
from utterscope.operators import models as md
from utterscope.operators.search import Choice, Range


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    words = {"x": ["alpha", "beta", "gamma", "both"], "y": ["delta", "epsilon", "zeta", "both"]}
    return spark.createDataFrame([(i // 2, "xy"[i % 2], " ".join(rng.choice(words["xy"[i % 2]], 5))) for i in range(120)],
                                 "id long, label string, text string")


@pytest.fixture
def tokenised(monkeypatch):
    """How often texts were given to a tokenizer."""
    calls = []
    plain = RegexTokenizer.transform
    monkeypatch.setattr(RegexTokenizer, "transform", lambda self, df, *a: calls.append(1) or plain(self, df, *a))
    return calls


def test_a_model_of_counts_is_that_of_texts(spark, rows):
    counted = md.counted(rows.withColumn("copy", F.col("text")), "text", [256, 512])
    assert counted.columns == ["id", "label", "copy", "_tf_text_256", "_tf_text_512", "_row"]
    for size in (256, 512):
        a, index = md.fit_classifier(rows, "text", "label", num_features=size, max_iter=5)
        b, _ = md.fit_classifier(counted, "text", "label", num_features=size, max_iter=5)
        of_texts = sorted((r.id, r.text, [round(x, 9) for x in r.logits]) for r in md.score(a, rows, index).collect())
        of_counts = sorted((r.id, r.copy, [round(x, 9) for x in r.logits]) for r in md.score(b, counted, index).collect())
        from_text = sorted((r.id, r.text, [round(x, 9) for x in r.logits]) for r in md.score(b, rows, index).collect())
        assert of_texts == of_counts == from_text


def test_an_ensemble_counts_texts_once_to_fit_and_once_to_predict(spark, rows, tokenised):
    models, index = md.train_ensemble(rows, "text", "label", "id", [1, 2, 3], num_features=256, max_iter=3)
    assert len(tokenised) == 1
    got = md.ensemble_predict(models, rows, index, "id")
    assert len(tokenised) == 2
    assert got.columns == ["id", "label", "text", "logits", "confidence", "pred_label"]
    own = [{(r.id, r.text): r.logits for r in md.score(m, rows, index).collect()} for m in models]
    for r in got.collect():
        assert r.logits == pytest.approx(np.mean([o[r.id, r.text] for o in own], axis=0))


def test_a_search_counts_texts_once(spark, rows, tokenised):
    settings = TrainingSettings(text_column="text", label_column="label", k_folds=2, num_features=256, max_iter=2)
    t = jobs.halving_classifier_search(rows, "id", {"reg_param": Range(0.001, 1.0, log=True), "num_features": Choice((64, 256))},
                                       settings, n_trials=2, group=2)
    assert len(tokenised) == 1 and t.count() == 3
    jobs.search_classifier(rows, "id", [{"num_features": 64, "max_iter": 2}, {"num_features": 64, "max_iter": 3}], settings)
    assert len(tokenised) == 2
    jobs.train_classifier(rows, "id", settings)
    assert len(tokenised) == 3


def test_sizes_from_a_range_are_counted_for_each_fit(spark, rows):
    settings = TrainingSettings(text_column="text", label_column="label", k_folds=2, max_iter=2)
    t = jobs.halving_classifier_search(rows, "id", {"num_features": Range(64, 256, whole=True)}, settings, n_trials=2, group=2)
    assert t.count() == 3
