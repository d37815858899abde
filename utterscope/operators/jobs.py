"""Whole jobs made of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.config import InferenceSettings, TrainingSettings
from utterscope.functions import text as tx
from utterscope.operators import metrics as mt
from utterscope.operators import models as md
from utterscope.operators import prep as pp
from utterscope.operators import scoring as sc
from utterscope.operators import splits as sp
from utterscope.session import reliable_checkpoint

REPORT_COLUMNS = ["Interaction ID", "Date/time", "Phrase", "Topic bot", "Phrase normalized", "Topic tool", "Summary",
                  "Confidence"]


def predict_report(utterances: DataFrame, score, settings: InferenceSettings, order_cols: list, intent_dim: DataFrame,
                   examples: list[tuple[str, str]] | None = None, make_generator=None) -> DataFrame:
    """I7 + F5: utterances to the prediction report of eight columns.

    Columns are named and filled (B1 to B4), texts validated (B6),
    ``score(rows) -> rows with logits and class_names`` called, the decision
    taken at the settings' temperature and threshold (C1 to C3) and compared
    with the bot's topic (C5); the normalised phrase comes from the rules or,
    with the decided intent as context (B9), from the generator.
    """
    rows = pp.prepare_utterances(utterances, order_cols)
    rows = rows.withColumn("_text", tx.validate_text("Phrase", settings.max_text_length))
    decided = sc.classify(score(rows), settings.temperature, settings.confidence_threshold, settings.nomatch_label)
    bot = tx.unicode_strip(F.col("Topic bot"))
    report = decided.select(
        "Interaction ID", "Date/time", "Phrase", bot.alias("Topic bot"), "_text",
        F.col("tool_label").alias("Topic tool"), sc.summary_status("status", "Topic bot", "tool_label").alias("Summary"),
        sc.scale_confidence("confidence").alias("Confidence"), pp.gate_intent_context("tool_label").alias("_intent"))
    return pp.normalise_phrases(report, "_text", "_intent", intent_dim, examples, make_generator,
                                out="Phrase normalized").select(*REPORT_COLUMNS)


def evaluate(scored: DataFrame, key: str, choices: list[tuple[float, float]], nomatch: str = "NOMATCH",
             true: str = "true_label") -> dict[tuple[float, float], dict[str, DataFrame]]:
    """E5 to E15 and G5, G6 for each (temperature, threshold).

    ``scored`` (key, true label, logits, class_names) is kept once, and so are
    the decisions of all choices (key, true, predicted, confidence), from
    which all reports follow.
    """
    kept = reliable_checkpoint(scored.select(key, F.col(true).alias("true_label"), "logits", "class_names"))
    decided = [sc.classify(kept, t, h, nomatch).select(
        F.lit(i).alias("choice"), key, "true_label", F.col("tool_label").alias("pred_label"), "confidence")
        for i, (t, h) in enumerate(choices)]
    every = reliable_checkpoint(mt.with_correct(reduce(DataFrame.union, decided))) if decided else None
    out = {}
    for i, (temperature, threshold) in enumerate(choices):
        d = every.filter(F.col("choice") == i).drop("choice")
        wrong = d.where(~F.col("correct"))
        out[temperature, threshold] = {
            "accuracy": mt.accuracy(d), "f1_scores": mt.f1_scores(d), "classification_report": mt.classification_report(d),
            "confusion_matrix": mt.confusion_matrix(d), "confidence_stats": mt.confidence_stats(d),
            "confidence_bands": mt.confidence_bands(d), "confidence_by_correctness": mt.confidence_by_correctness(d),
            "histogram": mt.histogram(d, "confidence", 20), "error_patterns": mt.error_patterns(d),
            "error_summary": mt.error_summary(d),
            "top_errors": wrong.where(F.col("confidence") >= 0.8).orderBy(F.desc("confidence"), key).limit(5),
            "errors": wrong.orderBy("confidence", key)}
    return out


def _weighted_f1(model, index: DataFrame, rows: DataFrame, key: str, label: str) -> float:
    """Weighted F1 of a classifier on labelled rows; labels it never saw
    count as errors."""
    named = md.score(model, rows, index).withColumn("pred_label", F.element_at(
        "class_names", F.array_position("logits", F.array_max("logits")).cast("int")))
    return float(mt.f1_scores(named.select(F.col(label).cast("string").alias("true_label"), "pred_label")).first()["f1_weighted"])


def train_classifier(df: DataFrame, key: str, settings: TrainingSettings) -> dict:
    """A classifier for each regularisation of the settings, fitted on the
    training rows; the one of best weighted F1 on the validation rows is
    returned with its F1 on the test rows.  Ties go to the first."""
    text, label = settings.text_column, settings.label_column
    rows = md.counted(df.select(key, text, label), text, [settings.num_features])
    keys = list(dict.fromkeys([key, label]))
    outer = md.with_flags(rows, keys, {"is_test": lambda r: sp.stratified_split(r, label, key, settings.test_size, settings.seed)})
    test, rest = outer.where("is_test").drop("is_test"), outer.where(~F.col("is_test")).drop("is_test")
    inner = md.with_flags(rest, keys, {"is_test": lambda r: sp.stratified_split(r, label, key, settings.val_size, settings.seed)})
    train, held = inner.where(~F.col("is_test")).drop("is_test"), inner.where("is_test").drop("is_test")
    best, scores = None, []
    for reg in settings.reg_params:
        model, index = md.fit_classifier(train, text, label, settings.use_class_weights, reg_param=reg,
                                         max_iter=settings.max_iter, num_features=settings.num_features)
        scores.append((reg, _weighted_f1(model, index, held, key, label)))
        if best is None or scores[-1][1] > best[0]:
            best = (scores[-1][1], reg, model, index)
    return {"model": best[2], "labels": best[3], "reg_param": best[1], "validation": scores,
            "test_f1": _weighted_f1(best[2], best[3], test, key, label)}


def _folds(df: DataFrame, key: str, settings: TrainingSettings, sizes: set[int] | None) -> DataFrame:
    """Rows with their ``fold``, counted by ``sizes`` numbers of features."""
    text, label = settings.text_column, settings.label_column

    def folded(rows: DataFrame) -> DataFrame:
        return sp.stratified_folds(rows, label, key, settings.k_folds, settings.seed)

    if sizes is None:
        return reliable_checkpoint(folded(df.select(key, text, label)))
    return md.with_flags(md.counted(df.select(key, text, label), text, sizes), list(dict.fromkeys([key, label])), {"fold": folded})


def search_classifier(df: DataFrame, key: str, choices: list[dict], settings: TrainingSettings) -> DataFrame:
    """I3 over classifier settings: (trial, step, f1, value) — weighted F1 of
    every choice (arguments of the text pipeline) on every held-out fold,
    ``value`` the running mean over folds; feeds E25 to E27."""
    text, label = settings.text_column, settings.label_column
    folds = _folds(df, key, settings, {md._features(text, **choice) for choice in choices})
    rows = []
    for trial, choice in enumerate(choices):
        total = 0.0
        for step in range(settings.k_folds):
            model, index = md.fit_classifier(folds.where(F.col("fold") != step), text, label, settings.use_class_weights, **choice)
            f1 = _weighted_f1(model, index, folds.where(F.col("fold") == step), key, label)
            total += f1
            rows.append((trial, step, f1, total / (step + 1)))
    return df.sparkSession.createDataFrame(rows, "trial int, step int, f1 double, value double")


def halving_classifier_search(df: DataFrame, key: str, space: dict, settings: TrainingSettings, n_trials: int = 16,
                              group: int = 8, at_once: int = 4) -> DataFrame:
    """I3 as a search: ``search.halving_search`` over arguments of the text
    pipeline (``reg_param``, ``elastic_net``, ``max_iter``, ``num_features``),
    scored by weighted F1 on the held-out fold of stratified ones."""
    from utterscope.operators.search import Choice, halving_search
    text, label = settings.text_column, settings.label_column
    sizes = space.get("num_features", Choice((md._features(text),)))
    # any number of a range may be asked for: then texts are counted for each fit
    folds = _folds(df, key, settings, set(sizes.values) if isinstance(sizes, Choice) else None)

    def fitted(choice: dict, step: int) -> float:
        model, index = md.fit_classifier(folds.where(F.col("fold") != step), text, label, settings.use_class_weights, **choice)
        return _weighted_f1(model, index, folds.where(F.col("fold") == step), key, label)

    return halving_search(df.sparkSession, space, settings.k_folds, fitted, n_trials, group, seed=settings.seed, at_once=at_once)
