"""Hyper-parameter search tables.

``cv_trials`` cross-validates the centroid scorer over a settings grid:
stratified folds (D2), centroids refit without the held-out fold (each row
feeds the k-1 folds it trains), every setting evaluated in one pass.  The
trials table it returns (trial, step = fold, value = running mean F1) is
what the summaries and the median-pruning rule read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterscope.functions import vectors as vx
from utterscope.operators import metrics as mt
from utterscope.operators.scoring import _logit_expr
from utterscope.operators.splits import stratified_folds
from utterscope.session import sized_broadcast


def fold_centroids(df: DataFrame, label: str, vec: str, k: int, name_fn) -> DataFrame:
    """(held, cl) — per held-out fold, the packed class table fitted on the
    other folds (k rows; each with classes x dims values)."""
    tr = df.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda h: h != F.col("fold")))
                   .alias("held"), label, F.posexplode(vx.as_double(vec)).alias("pos", "x"))
    means = tr.groupBy("held", label, "pos").agg(F.avg("x").alias("m"))
    cents = (means.groupBy("held", label).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_s"))
                  .select("held", F.col(label).alias("cls"), name_fn(F.col(label)).alias("name"),
                          F.transform("_s", lambda e: e["m"]).alias("centroid")))
    cents = cents.withColumn("cnorm", vx.norm("centroid"))
    return cents.groupBy("held").agg(
        F.sort_array(F.collect_list(F.struct("cls", "name", "centroid", "cnorm"))).alias("cl"))


def cv_trials(df: DataFrame, label: str, key: str, vec: str, settings: list[tuple[float, float]],
              name_fn, k: int = 5, seed: int = 42, scale: float = 20.0) -> DataFrame:
    """(trial, step, temperature, threshold, f1, value) — weighted F1 of
    every setting on every held-out fold; value = running mean over folds."""
    folds = stratified_folds(df, label, key, k, seed)
    packs = sized_broadcast(fold_centroids(folds, label, vec, k, name_fn), 1000)
    scored = folds.join(packs, F.col("fold") == F.col("held"))
    scored = scored.withColumn("logits", _logit_expr(vx.as_double(vec), F.col("cl"), "cosine", scale)) \
                   .withColumn("names", F.transform("cl", lambda c: c["name"])).drop("cl")
    st = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(float(t)).alias("temperature"),
                            F.lit(float(h)).alias("threshold")) for i, (t, h) in enumerate(settings)])
    x = scored.select(key, "fold", name_fn(F.col(label)).alias("true_label"), "logits", "names",
                      F.explode(st).alias("s")).select("*", "s.*").drop("s")
    x = x.withColumn("probs", vx.softmax("logits", F.col("temperature")))
    x = x.withColumn("conf", F.array_max("probs")).withColumn(
        "pl", F.element_at("names", vx.argmax("probs") + 1))
    pred = (F.when(F.col("pl") == "NOMATCH", F.lit("NOMATCH"))
             .when(F.col("conf") < F.col("threshold"), F.lit("UNLISTED")).otherwise(F.col("pl")))
    x = x.withColumn("pred_label", pred)
    f1 = mt.f1_scores(x, "true_label", "pred_label", by=["trial", "temperature", "threshold", "fold"])
    w = Window.partitionBy("trial").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    return f1.select("trial", F.col("fold").alias("step"), "temperature", "threshold",
                     F.col("f1_weighted").alias("f1"), F.avg("f1_weighted").over(w).alias("value"))


def _settings_of(trials: DataFrame) -> list[str]:
    """The columns that say what a trial tried."""
    return [c for c in trials.columns if c not in ("trial", "step", "f1", "value")]


def fold_summary(trials: DataFrame) -> DataFrame:
    """Mean and population std of the fold F1 per trial."""
    return trials.groupBy("trial", *_settings_of(trials)).agg(
        F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.count("*").alias("n_folds"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the highest mean F1 (lowest trial number on ties)
    of those that reached the most folds: pruned ones have fewer."""
    s = fold_summary(trials)
    s = s.filter(F.col("n_folds") == s.agg(F.max("n_folds")).scalar())
    best = s.agg(F.max_by(F.struct("trial", *_settings_of(trials), "mean_f1"),
                          F.struct("mean_f1", -F.col("trial"))).alias("b"))
    return best.select("b.*")


def median_pruning(trials: DataFrame, n_startup: int = 5, n_warmup: int = 2) -> DataFrame:
    """A trial is pruned at the first step >= ``n_warmup`` where its
    running value is below the median of the earlier trials' values at that
    step (after ``n_startup`` trials).  Computed over the trials table."""
    # earlier trials' values at the same step (bounded by the trial count),
    # median of the sorted frame
    w = Window.partitionBy("step").orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    t = trials.withColumn("_prev", F.array_sort(F.collect_list("value").over(w)))
    n = F.size("_prev")
    even = (F.element_at("_prev", (n / 2).cast("int")) + F.element_at("_prev", (n / 2).cast("int") + 1)) / 2
    t = t.withColumn("_med", F.when(n == 0, F.lit(None)).when(n % 2 == 1,
                     F.element_at("_prev", ((n + 1) / 2).cast("int"))).otherwise(even))
    flag = (F.col("trial") >= n_startup) & (F.col("step") >= n_warmup) & (F.col("value") < F.col("_med"))
    return t.groupBy("trial").agg(F.min(F.when(flag, F.col("step"))).alias("pruned_at_step")) \
            .withColumn("pruned", F.col("pruned_at_step").isNotNull())
