"""Metrics on small labelled fixtures, checked by hand-written Python."""
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from utterscope.operators import metrics as mt
from utterscope.operators import weights as wt


def py_f1(true, pred):
    labels = sorted(set(true) | set(pred))
    f1s, sup = [], []
    for l in labels:
        tp = sum(1 for t, p in zip(true, pred) if t == l and p == l)
        fp = sum(1 for t, p in zip(true, pred) if t != l and p == l)
        fn = sum(1 for t, p in zip(true, pred) if t == l and p != l)
        pr = tp / (tp + fp) if tp + fp else 0.0
        rc = tp / (tp + fn) if tp + fn else 0.0
        f1s.append(2 * pr * rc / (pr + rc) if pr + rc else 0.0)
        sup.append(sum(1 for t in true if t == l))
    return sum(f * s for f, s in zip(f1s, sup)) / sum(sup), sum(f1s) / len(f1s)


def test_f1_with_unseen_predicted_label(spark):
    true = ["a"] + ["b"] * 2 + ["c"] * 7
    pred = ["a", "b", "z", "c", "c", "c", "b", "c", "c", "a"]
    df = spark.createDataFrame(list(zip(true, pred)), "true_label string, pred_label string")
    r = mt.f1_scores(df).first()
    w, m = py_f1(true, pred)
    assert abs(r["f1_weighted"] - w) < 1e-12 and abs(r["f1_macro"] - m) < 1e-12
    cm = mt.confusion_matrix(df)
    assert cm.count() == 16 and cm.agg(F.sum("n")).first()[0] == len(true)


def test_class_weights_include_empty_label(spark):
    df = spark.createDataFrame([("a",)] * 1 + [("b",)] * 2 + [("c",)] * 7, "l string")
    dim = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "l string")
    got = {r["l"]: r["weight"] for r in wt.class_weights(df, "l", dim).collect()}
    n, c = 10, 4
    raw = {k: n / (c * max(v, 1)) for k, v in {"a": 1, "b": 2, "c": 7, "d": 0}.items()}
    lo, hi = min(raw.values()), max(raw.values())
    norm = {k: 0.5 + 1.5 * (v - lo) / (hi - lo) for k, v in raw.items()}
    mean = sum(norm.values()) / 4
    for k in norm:
        assert abs(got[k] - norm[k] / mean) < 1e-12
    same = spark.createDataFrame([("a",), ("b",)], "l string")
    assert {r["weight"] for r in wt.class_weights(same, "l").collect()} == {1.0}


def test_exact_median_matches_numpy(spark):
    rnd = random.Random(7)
    vals = [rnd.random() for _ in range(501)] + [0.25] * 300  # skewed duplicates
    groups = [(i % 3, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(groups, "g int, x double")
    got = {r["g"]: r["median"] for r in mt.exact_median(df, "x", ["g"]).collect()}
    for g in range(3):
        assert got[g] == float(np.median([v for k, v in groups if k == g]))
    one = mt.exact_median(df, "x").first()["median"]
    assert one == statistics.median(vals)


def test_histogram_closed_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], "confidence double")
    h = {r["bin"]: r["n"] for r in mt.histogram(df, "confidence", 4).collect()}
    assert h == {0: 1, 1: 0, 2: 1, 3: 2}
