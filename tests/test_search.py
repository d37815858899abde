"""Search by halving: fits saved, table kept, draws drawn to the better side."""

import math

import pytest

from utterscope.config import TrainingSettings
from utterscope.operators import jobs, tuning
from utterscope.operators.search import Choice, DensitySampler, Range, halving_search

SPACE = {"rate": Range(1e-4, 1.0, log=True), "depth": Range(1, 9, whole=True), "kind": Choice(("a", "b", "c"))}


def score(settings, fold):
    return 1 / (1 + (math.log10(settings["rate"]) + 2) ** 2 + 0.1 * abs(settings["depth"] - 4)
                + (settings["kind"] != "b")) - 0.001 * fold


def test_pruned_trials_are_not_fitted_further(spark):
    calls = []

    def counted(settings, fold):
        calls.append(fold)
        return score(settings, fold)

    t = halving_search(spark, SPACE, 4, counted, n_trials=16, group=8, startup=4)
    rows = t.orderBy("trial", "step").collect()
    assert len(calls) == len(rows) == 2 * (8 + 4 + 2 + 1) < 16 * 4
    assert t.columns == ["trial", "step", "rate", "depth", "kind", "f1", "value"]
    by = {}
    for r in rows:
        by.setdefault(r["trial"], []).append(r)
    for trial in by.values():
        assert [r["step"] for r in trial] == list(range(len(trial)))
        for n, r in enumerate(trial, 1):
            assert r["value"] == pytest.approx(sum(x["f1"] for x in trial[:n]) / n)
            assert r["f1"] == pytest.approx(score(r.asDict(), r["step"]))
            assert 1e-4 <= r["rate"] <= 1 and r["depth"] in range(1, 10) and r["kind"] in "abc"
    assert sorted(len(x) for x in by.values()) == sorted(2 * ([4] + [3] + [2] * 2 + [1] * 4))
    best = tuning.best_trial(t).first()
    assert len(by[best["trial"]]) == 4 and tuning.fold_summary(t).count() == 16 and tuning.median_pruning(t).count() == 16


def test_same_table_whatever_runs_side_by_side(spark):
    one, many = (halving_search(spark, SPACE, 3, score, n_trials=10, group=5, at_once=n).collect() for n in (1, 5))
    assert one == many


def test_later_draws_lie_nearer_the_best():
    early, late = [], []
    for seed in range(20):
        sampler = DensitySampler(SPACE, seed)
        for n in range(40):
            settings = sampler.ask()
            value = score(settings, 0)
            sampler.tell(settings, value)
            (early if n < 10 else late if n >= 30 else []).append(value)
    assert sum(late) / len(late) > 1.5 * sum(early) / len(early)


def test_ranges_hold_their_bounds():
    for r in SPACE.values():
        if isinstance(r, Range):
            assert r.value(-1) == pytest.approx(r.low) and r.value(2) == pytest.approx(r.high)
            assert all(abs(r.place(r.value(p)) - p) < (0.1 if r.whole else 1e-9) for p in (0.0, 0.3, 1.0))
    with pytest.raises(ValueError):
        halving_search(None, SPACE, 0, score)


def test_classifier_search_finds_the_setting_that_learns(spark):
    words = {"x": "alpha beta gamma", "y": "delta epsilon zeta"}
    rows = [(i, "xy"[i % 2], " ".join(words["xy"[i % 2]].split()[: 1 + i % 3])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    settings = TrainingSettings(text_column="text", label_column="label", k_folds=2, use_class_weights=False)
    t = jobs.halving_classifier_search(df, "id", {"max_iter": Choice((0, 5)), "elastic_net": Range(0.0, 0.5),
                                                  "num_features": Choice((256,))}, settings, n_trials=4, group=4)
    best = tuning.best_trial(t).first()
    if any(r["max_iter"] == 5 for r in t.collect()):
        assert best["max_iter"] == 5 and best["mean_f1"] > 0.9
