"""Queries for scoring and decisions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from utterscope.functions import vectors as vx
from utterscope.operators import scoring as sc
from utterscope.operators import weights as wt
from utterscope.plans import sql as q
from utterscope.plans import tables as tb
from utterscope.plans.registry import query

R6 = 6


def report(spark, sf):
    """One projection over the classified rows (no join needed —
    the input, prediction and decision share one lineage)."""
    c = tb.classified(spark, sf)
    return (c.withColumn("bot_topic", tb.bot_topic())
             .withColumn("summary", sc.summary_status("status", "bot_topic", "tool_label")))


@query("predict_report", f"""WITH {q.report_cte()}
SELECT vec_id, true_label, bot_topic, tool_label, status, round(confidence, 6) AS confidence,
       round_even(confidence * 10, 2) AS confidence_10, summary FROM report""")
def predict_report(spark, sf):
    return report(spark, sf).select(
        "vec_id", "true_label", "bot_topic", "tool_label", "status",
        F.round("confidence", R6).alias("confidence"),
        sc.scale_confidence("confidence").alias("confidence_10"), "summary")


@query("summary_distribution", f"""WITH {q.report_cte()}
SELECT summary, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM report GROUP BY summary""")
def summary_distribution(spark, sf):
    """E17 — the flagship."""
    from utterscope.operators import metrics as mt
    return mt.share_by(report(spark, sf), "summary")


@query("label_distribution", f"""WITH {q.report_cte()}
SELECT tool_label, n, pct FROM (
  SELECT tool_label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
  FROM report GROUP BY tool_label) t
ORDER BY n DESC, tool_label LIMIT 5""")
def label_distribution(spark, sf):
    """Top-5 predicted labels (a top-k report: the limit is the feature)."""
    from utterscope.operators import metrics as mt
    return mt.share_by(report(spark, sf), "tool_label").orderBy(F.desc("n"), "tool_label").limit(5)


@query("softmax_temperature", f"""WITH {q.classified_cte()}
SELECT vec_id, CAST(i - 1 AS INTEGER) AS cls, round(probs[i], 6) AS prob
FROM (SELECT vec_id, probs, unnest(generate_series(1, len(probs))) AS i FROM classified) t""")
def softmax_temperature(spark, sf):
    """C1 in long form: every class probability of every row."""
    s = sc.softmax_temperature(tb.scored(spark, sf), "logits", tb.TEMPERATURE)
    return s.select("vec_id", F.posexplode_outer("probs").alias("cls", "prob")) \
            .select("vec_id", F.col("cls").cast("int").alias("cls"), F.round("prob", R6).alias("prob"))


@query("argmax_confidence", f"""WITH {q.classified_cte()}
SELECT vec_id, pred_idx, pred_label, round(confidence, 6) AS confidence FROM classified""")
def argmax_confidence(spark, sf):
    c = tb.classified(spark, sf)
    return c.select("vec_id", "pred_idx", "pred_label", F.round("confidence", R6).alias("confidence"))


@query("decide_status", f"""WITH {q.classified_cte()}
SELECT vec_id, tool_label, status FROM classified""")
def decide_status(spark, sf):
    """C3 (label NOMATCH wins; strict threshold)."""
    return tb.classified(spark, sf).select("vec_id", "tool_label", "status")


@query("decide_nomatch", f"""WITH {q.classified_cte(0.8, 0.5)}
SELECT vec_id, CASE WHEN confidence < 0.5 THEN 'NOMATCH' ELSE pred_label END AS label_out,
       round(confidence, 6) AS confidence FROM classified""")
def decide_nomatch(spark, sf):
    """C4 with the notebook settings (T = 0.8, threshold 0.5)."""
    c = tb.classified(spark, sf, 0.8, 0.5)
    return c.select("vec_id", sc.decide_nomatch(F.col("pred_label"), F.col("confidence"), 0.5)
                    .alias("label_out"), F.round("confidence", R6).alias("confidence"))


@query("stakeholder_report", f"""WITH {q.classified_cte(1.5, 0.65)}
SELECT vec_id AS user_sentence_id,
       CASE WHEN confidence < 0.65 THEN 'NOMATCH' ELSE pred_label END AS predicted_intent,
       CASE WHEN confidence > 0.8 THEN 'High' WHEN confidence > 0.6 THEN 'Medium'
            ELSE 'Low (Check Manually)' END AS model_certainty,
       round(confidence, 6) AS confidence_score FROM classified""")
def stakeholder_report(spark, sf):
    """T = 1.5, threshold 0.65, C4 + C7, four columns."""
    c = tb.classified(spark, sf, 1.5, 0.65)
    return c.select(F.col("vec_id").alias("user_sentence_id"),
                    sc.decide_nomatch(F.col("pred_label"), F.col("confidence"), 0.65).alias("predicted_intent"),
                    sc.certainty_tier("confidence").alias("model_certainty"),
                    F.round("confidence", R6).alias("confidence_score"))


@query("top_k_labels", f"""WITH {q.classified_cte()},
ranked AS (
  SELECT vec_id, class_names[i] AS label, probs[i] AS p,
         row_number() OVER (PARTITION BY vec_id ORDER BY probs[i] DESC, i) AS r
  FROM (SELECT vec_id, probs, class_names, unnest(generate_series(1, len(probs))) AS i FROM classified) t)
SELECT vec_id,
  max(CASE WHEN r = 1 THEN label END) AS top1_label, round(max(CASE WHEN r = 1 THEN p END), 6) AS top1_prob,
  max(CASE WHEN r = 2 THEN label END) AS top2_label, round(max(CASE WHEN r = 2 THEN p END), 6) AS top2_prob,
  max(CASE WHEN r = 3 THEN label END) AS top3_label, round(max(CASE WHEN r = 3 THEN p END), 6) AS top3_prob
FROM ranked WHERE r <= 3 GROUP BY vec_id""")
def top_k_labels(spark, sf):
    """Top-3 labels and probabilities per row."""
    c = tb.classified(spark, sf).withColumn("top", sc.top_k_labels("probs", "class_names", 3))
    cols = ["vec_id"]
    for i in range(3):
        e = F.element_at("top", i + 1)
        cols += [e.label.alias(f"top{i + 1}_label"), F.round(e.prob, R6).alias(f"top{i + 1}_prob")]
    return c.select(*cols)


@query("nearest_centroid_logits", f"""WITH {q.scored_cte()}
SELECT vec_id, CAST(i - 1 AS INTEGER) AS cls, round(logits[i], 6) AS logit
FROM (SELECT vec_id, logits, unnest(generate_series(1, len(logits))) AS i FROM scored) t""")
def nearest_centroid_logits(spark, sf):
    """C14 in long form."""
    s = tb.scored(spark, sf)
    return s.select("vec_id", F.posexplode_outer("logits").alias("cls", "logit")) \
            .select("vec_id", F.col("cls").cast("int").alias("cls"), F.round("logit", R6).alias("logit"))


@query("class_centroids", f"""WITH {q.centroids_cte()}
SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(c[i], 6) AS value, n AS size
FROM (SELECT label, c, n, unnest(generate_series(1, len(c))) AS i FROM cent) t""")
def class_centroids(spark, sf):
    """E20 per class, long form (class, position, mean value)."""
    cents = sc.group_centroids(tb.vectors(spark, sf), "label", "v")
    return cents.select("label", F.posexplode_outer("centroid").alias("pos", "value"), "size") \
                .select("label", F.col("pos").cast("int").alias("pos"),
                        F.round("value", R6).alias("value"), "size")


def _two_models(spark, sf):
    """Model A: cosine centroid scorer; model B: negative-euclidean scorer,
    both over every row."""
    a = tb.scored(spark, sf, "cosine").select("vec_id", "label", "class_names",
                                              F.col("logits").alias("logits_a"))
    b = tb.scored(spark, sf, "neg_euclidean").select("vec_id", F.col("logits").alias("logits_b"))
    return a.join(b, "vec_id")


def _two_models_sql() -> str:
    return f"""{q.scored_cte('cosine', sfx='_a')},
{q.scored_cte('neg_euclidean', sfx='_b')},
model_pair AS (SELECT a.vec_id, a.label, a.class_names, a.logits AS logits_a, b.logits AS logits_b
         FROM scored_a a JOIN scored_b b USING (vec_id))"""


@query("ensemble_logits", f"""WITH {_two_models_sql()},
ens AS (SELECT vec_id, class_names,
          list_transform(list_zip(logits_a, logits_b), lambda p: (p[1] + p[2]) / 2.0) AS logits FROM model_pair),
pr AS (SELECT vec_id, class_names, {q.softmax_sql('logits', 1.0)} AS probs FROM ens)
SELECT vec_id, class_names[list_position(probs, list_max(probs))] AS pred_label,
       round(list_max(probs), 6) AS confidence FROM pr""")
def ensemble_logits(spark, sf):
    """Mean of two models' logits, then softmax (T = 1) and argmax."""
    e = sc.ensemble_logits(_two_models(spark, sf), ["logits_a", "logits_b"])
    e = sc.argmax_confidence(sc.softmax_temperature(e, "logits", 1.0))
    return e.select("vec_id", vx.at("class_names", F.col("pred_idx")).alias("pred_label"),
                    F.round("confidence", R6).alias("confidence"))


@query("symmetric_kl", f"""WITH {_two_models_sql()},
lp AS (SELECT vec_id,
  list_transform(logits_a, lambda x: x - (list_max(logits_a) + ln(list_sum(list_transform(logits_a, lambda y: exp(y - list_max(logits_a))))))) AS la,
  list_transform(logits_b, lambda x: x - (list_max(logits_b) + ln(list_sum(list_transform(logits_b, lambda y: exp(y - list_max(logits_b))))))) AS lb
  FROM model_pair),
kl AS (SELECT vec_id,
  list_sum(list_transform(list_zip(lb, la), lambda p: exp(p[1]) * (p[1] - p[2]))) AS kl_ba,
  list_sum(list_transform(list_zip(la, lb), lambda p: exp(p[1]) * (p[1] - p[2]))) AS kl_ab FROM lp)
SELECT round(avg(kl_ba), 6) AS kl_ba, round(avg(kl_ab), 6) AS kl_ab,
       round((avg(kl_ba) + avg(kl_ab)) / 2.0, 6) AS symmetric_kl, count(*) AS n_rows FROM kl""")
def symmetric_kl(spark, sf):
    """Disagreement between the two scorers (batch-mean of each KL)."""
    s = sc.symmetric_kl(_two_models(spark, sf), "logits_a", "logits_b")
    return s.agg(F.round(F.avg("kl_ba"), R6).alias("kl_ba"), F.round(F.avg("kl_ab"), R6).alias("kl_ab"),
                 F.round((F.avg("kl_ba") + F.avg("kl_ab")) / 2.0, R6).alias("symmetric_kl"),
                 F.count("*").alias("n_rows"))


def _weights_sql() -> str:
    """class weights per class id (E2 over the scored labels) as a list."""
    return """cnt AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
tot AS (SELECT sum(n) AS total, count(*) AS c FROM cnt),
w0 AS (SELECT label, CAST(total AS DOUBLE) / (c * greatest(n, 1)) AS w FROM cnt, tot),
mm AS (SELECT min(w) AS lo, max(w) AS hi FROM w0),
w1 AS (SELECT label, CASE WHEN hi - lo < 1e-6 THEN 1.25 ELSE 0.5 + 1.5 * (w - lo) / (hi - lo) END AS w FROM w0, mm),
w2 AS (SELECT label, w / avg(w) OVER () AS w FROM w1),
wl AS (SELECT list(w ORDER BY label) AS weights FROM w2)"""


def _with_weights(spark, sf):
    s = tb.scored(spark, sf)
    w = wt.class_weights(s, "label")
    packed = w.select(F.sort_array(F.collect_list(F.struct("label", "weight"))).alias("ws"))
    return s.withColumn("_ws", packed.scalar()) \
            .withColumn("weights", F.transform("_ws", lambda e: e.weight)).drop("_ws")


@query("weighted_ce", f"""WITH {q.scored_cte()}, {_weights_sql()},
lsm AS (SELECT label, logits, list_transform(logits, lambda x: x - (list_max(logits) + ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))))) AS lp FROM scored),
terms AS (
  SELECT sum(-((CASE WHEN i - 1 = label THEN 0.9 ELSE 0.0 END) + 0.1 / len(lp)) * lp[i] * weights[i]) AS num,
         max(weights[label + 1]) AS den
  FROM (SELECT row_number() OVER () AS rid, label, lp, unnest(generate_series(1, len(lp))) AS i FROM lsm) t, wl
  GROUP BY rid)
SELECT round(sum(num) / sum(den), 6) AS weighted_ce, count(*) AS n_rows FROM terms""")
def weighted_ce(spark, sf):
    """Class-weighted smoothed CE (eps = 0.1) of the scored table."""
    s = _with_weights(spark, sf)
    out = sc.weighted_ce(s, "logits", "label", "weights", eps=0.1)
    return out.select(F.round("weighted_ce", R6).alias("weighted_ce"), "n_rows")


FOCAL_GAMMA = 1.3798296530795757
FOCAL_SMOOTHING = 0.09242568547841506


@query("focal_loss", f"""WITH {q.scored_cte()}, {_weights_sql()},
lsm AS (SELECT row_number() OVER () AS rid, label, list_transform(logits, lambda x: x - (list_max(logits) + ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))))) AS lp FROM scored),
terms AS (
  SELECT rid, max(label) AS label, max(lp[label + 1]) AS lpy,
         sum(-((CASE WHEN i - 1 = label THEN 1.0 - {FOCAL_SMOOTHING} ELSE 0.0 END) + {FOCAL_SMOOTHING} / len(lp)) * lp[i]) AS ce
  FROM (SELECT rid, label, lp, unnest(generate_series(1, len(lp))) AS i FROM lsm) t GROUP BY rid)
SELECT round(avg(pow(1.0 - exp(lpy), {FOCAL_GAMMA}) * ce * weights[label + 1]), 6) AS focal_loss,
       count(*) AS n_rows FROM terms, wl""")
def focal_loss(spark, sf):
    """C11 with the tuned gamma / smoothing and class weights as alpha."""
    s = _with_weights(spark, sf)
    out = sc.focal_loss(s, "logits", "label", "weights", gamma=FOCAL_GAMMA, eps=FOCAL_SMOOTHING)
    return out.select(F.round("focal_loss", R6).alias("focal_loss"), "n_rows")


def _centroid_model_factory(centroids: np.ndarray, scale: float):
    """make_predict_fn for score_batches: a numpy cosine scorer."""
    def make():
        c = centroids / np.linalg.norm(centroids, axis=1, keepdims=True)

        def predict(x: np.ndarray) -> np.ndarray:
            m = np.asarray(x, dtype=np.float64).reshape(len(x), -1)
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
            return scale * (m @ c.T)
        return predict
    return make


@query("score_batches", f"""WITH {q.classified_cte()}
SELECT vec_id, pred_idx, round(confidence, 6) AS confidence FROM classified""")
def score_batches(spark, sf):
    """Fixed-size (32-row) batch scoring through a pluggable model."""
    emb = tb.vectors(spark, sf)
    cents = sc.group_centroids(emb, "label", "v")
    # the model's parameters (classes x dims) are small and fixed at fit time
    mat = np.array([r.centroid for r in cents.orderBy("label").collect()], dtype=np.float64)
    out = sc.score_batches(emb, "v", _centroid_model_factory(mat, tb.LOGIT_SCALE),
                           n_classes=len(mat), batch_size=32,
                           input_shape=[mat.shape[1]])
    out = sc.argmax_confidence(sc.softmax_temperature(out, "logits", tb.TEMPERATURE))
    return out.select("vec_id", "pred_idx", F.round("confidence", R6).alias("confidence"))
