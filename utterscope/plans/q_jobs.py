"""Whole jobs over their whole tables (I1, I3, I5, I6, H8), under what must
hold of any right result: fitted models and clusters have no exact SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterscope.config import TrainingSettings
from utterscope.functions import vectors as vx
from utterscope.operators import jobs
from utterscope.operators import models as md
from utterscope.operators import tuning as tu
from utterscope.operators.search import Choice, Range
from utterscope.operators.stability import stability_cluster
from utterscope.plans import sql as q
from utterscope.plans import tables as tb
from utterscope.plans.q_discovery import _labelled_text
from utterscope.plans.q_metrics import SWEEP
from utterscope.plans.registry import query

R6 = 6
TRAINING = TrainingSettings(text_column="text", label_column="quality", k_folds=3, max_iter=8, num_features=1 << 12,
                            reg_params=(1.0, 0.05))
SPACE = {"reg_param": Range(1e-3, 1.0, log=True), "elastic_net": Range(0.0, 0.5), "max_iter": Range(3, 8, whole=True),
         "num_features": Choice((1 << 10, 1 << 12))}
N_TRIALS = 6


@query("training_job", """SELECT 2 AS n_tried, TRUE AS best_chosen, TRUE AS scores_are_shares,
  CAST(count(DISTINCT quality) AS BIGINT) AS n_labels FROM documents JOIN labels USING (doc_id)""")
def training_job(spark, sf):
    """The regularisation of best F1 on validation rows is chosen and
    scored on the test rows."""
    out = jobs.train_classifier(_labelled_text(spark, sf), "doc_id", TRAINING)
    scores = [f for _, f in out["validation"]]
    best = dict(out["validation"])[out["reg_param"]] == max(scores)
    shares = all(0.0 <= f <= 1.0 for f in [*scores, out["test_f1"]])
    return out["labels"].agg(F.lit(len(scores)).alias("n_tried"), F.lit(best).alias("best_chosen"),
                             F.lit(shares).alias("scores_are_shares"), F.count("*").alias("n_labels"))


@query("search_job", f"""SELECT CAST({N_TRIALS} AS BIGINT) AS n_trials, TRUE AS pruned_are_not_fitted,
  TRUE AS survivors_were_best, TRUE AS running_means, TRUE AS best_has_all_folds FROM (SELECT 1) z""")
def search_job(spark, sf):
    """A search by halving; fewer fits than trials times folds, of each
    step the better half goes on, ``value`` is the mean so far."""
    t = jobs.halving_classifier_search(_labelled_text(spark, sf), "doc_id", SPACE, TRAINING, N_TRIALS, group=N_TRIALS)
    best = tu.best_trial(t).select("trial").scalar()
    folds = t.groupBy("trial").agg(F.count("*").alias("n"), F.max(F.struct("step", "value")).alias("last"), F.sum("f1").alias("total"))
    steps = t.join(folds, "trial").groupBy("step").agg(
        F.min(F.when(F.col("n") > F.col("step") + 1, F.col("value"))).alias("stayed"),
        F.max(F.when(F.col("n") == F.col("step") + 1, F.col("value"))).alias("left"))
    kept = steps.filter(F.col("stayed").isNotNull()).agg(F.min(F.col("stayed") >= F.col("left") - 1e-12)).scalar()
    return folds.agg(
        F.count("*").alias("n_trials"), (F.sum("n") < N_TRIALS * TRAINING.k_folds).alias("pruned_are_not_fitted"),
        kept.alias("survivors_were_best"),
        F.min(F.abs(F.col("last.value") - F.col("total") / F.col("n")) < 1e-9).alias("running_means"),
        F.max((F.col("trial") == best) & (F.col("n") == TRAINING.k_folds)).alias("best_has_all_folds"))


@query("evaluation_job", f"""WITH {q.scored_cte()},
settings(temperature, threshold) AS (VALUES {", ".join(f"({t}, {h})" for t, h in SWEEP)}),
sc AS (SELECT s.vec_id, s.true_label, s.class_names, st.temperature, st.threshold,
              {q.softmax_sql('s.logits', 'st.temperature')} AS probs FROM scored s, settings st),
dec AS (SELECT *, list_max(probs) AS confidence, class_names[list_position(probs, list_max(probs))] AS pl FROM sc),
ev AS (SELECT temperature, threshold, true_label,
              CASE WHEN pl = 'NOMATCH' THEN 'NOMATCH' WHEN confidence < threshold THEN 'UNLISTED' ELSE pl END AS pred_label
       FROM dec),
g AS (SELECT temperature, threshold, count(*) AS n, count(*) FILTER (WHERE true_label = pred_label) AS hits FROM ev GROUP BY ALL)
SELECT temperature, threshold, round(hits * 1.0 / n, 6) AS accuracy, n AS confusion_rows, n AS histogram_rows,
       n - hits AS error_rows FROM g""")
def evaluation_job(spark, sf):
    """The job's reports for each setting agree with one another and
    with the decisions."""
    out = jobs.evaluate(tb.scored(spark, sf), "vec_id", SWEEP)
    rows = []
    for (t, h), reports in out.items():
        rows.append(reports["accuracy"].select(
            F.lit(float(t)).alias("temperature"), F.lit(float(h)).alias("threshold"), F.round("accuracy", R6).alias("accuracy"),
            reports["confusion_matrix"].agg(F.sum("n")).scalar().alias("confusion_rows"),
            reports["histogram"].agg(F.sum("n")).scalar().alias("histogram_rows"),
            reports["errors"].agg(F.count("*")).scalar().alias("error_rows")))
    first, *rest = rows
    for r in rest:
        first = first.union(r)
    return first


@query("ensemble_job", """SELECT doc_id, TRUE AS is_mean, TRUE AS is_likeliest, 2 AS n_classes
FROM documents JOIN labels USING (doc_id)""")
def ensemble_job(spark, sf):
    """I5 + I2: what the ensemble gives every row is the mean of the logits
    that its models give it one by one, and their likeliest class."""
    d = md.counted(_labelled_text(spark, sf), "text", [1 << 12])
    models, index = md.train_ensemble(d, "text", "quality", "doc_id", [42, 43], max_iter=5, num_features=1 << 12)
    got = md.ensemble_predict(models, d, index, "doc_id")
    for i, m in enumerate(models):
        got = got.join(md.score(m, d, index).select("doc_id", F.col("logits").alias(f"own{i}"), F.col("class_names").alias("names")).drop(
            *(["names"] if i else [])), "doc_id")
    off = F.zip_with("logits", F.zip_with("own0", "own1", lambda a, b: (a + b) / 2), lambda x, y: F.abs(x - y) < 1e-9)
    return got.select("doc_id", F.forall(off, lambda x: x).alias("is_mean"),
                      (F.element_at("names", vx.argmax("logits") + 1) == F.col("pred_label")).alias("is_likeliest"),
                      F.size("names").alias("n_classes"))


@query("stability_cluster", """SELECT vec_id, TRUE AS large_enough, TRUE AS numbered_by_size FROM embeddings""")
def stability(spark, sf):
    """H8 by stability: clusters have the least size or more and are numbered
    by size from 0; a plain quadratic version is in the tests."""
    c = stability_cluster(tb.vectors(spark, sf), "vec_id", "v", 30, 3)
    sizes = c.filter("topic_id >= 0").groupBy("topic_id").agg(F.count("*").alias("n"))
    told = sizes.agg(F.sort_array(F.collect_list(F.struct("topic_id", "n"))).alias("l"))
    ordered = F.forall(F.transform("l", lambda x, i: (x["topic_id"] == i) & (
        (i == 0) | (x["n"] <= F.get(F.col("l"), i - 1)["n"]))), lambda x: x)
    return c.join(sizes, "topic_id", "left").select(
        "vec_id", (F.coalesce("n", F.lit(30)) >= 30).alias("large_enough"),
        told.select(ordered).scalar().alias("numbered_by_size"))
