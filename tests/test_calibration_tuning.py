"""Temperature fit, NLL property, pruning rule."""
import numpy as np
from pyspark.sql import functions as F

from utterscope.operators import calibration as cb
from utterscope.operators import tuning as tu


def _logits(spark, scale, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 4, 400)
    base = rng.normal(size=(400, 4))
    base[np.arange(400), y] += 1.0
    return spark.createDataFrame([(b.tolist() if True else None, int(l)) for b, l in zip(base * scale, y)],
                                 "logits array<double>, label int")


def test_over_and_under_confident(spark):
    over = _logits(spark, 6.0, 0)
    t, nll = cb.fit_temperature(over)
    assert t > 1.5
    nll1 = cb.nll_at_temperature(over, [1.0]).first()["nll"]
    assert nll <= nll1 + 1e-12
    under = _logits(spark, 0.3, 1)
    assert cb.fit_temperature(under)[0] < 0.8


def test_median_pruning(spark):
    rows = []
    for trial in range(8):
        for step in range(5):
            v = 0.8 if trial not in (5, 7) else 0.2
            rows.append((trial, step, 1.0, 0.5, v, v))
    df = spark.createDataFrame(rows, "trial int, step int, temperature double, threshold double, f1 double, value double")
    got = {r["trial"]: (r["pruned"], r["pruned_at_step"]) for r in tu.median_pruning(df).collect()}
    assert got[5] == (True, 2) and got[7] == (True, 2)
    assert not any(got[t][0] for t in (0, 1, 2, 3, 4, 6))
    best = tu.best_trial(df).first()
    assert best["trial"] == 0
