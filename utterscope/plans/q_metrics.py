"""Evaluation queries over the classified flagship.

Truth = the row's intent, prediction = the tool label (UNLISTED counts as a
wrong label, as in the evaluation job).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from utterscope.functions import vectors as vx
from utterscope.operators import metrics as mt
from utterscope.operators import scoring as sc
from utterscope.plans import sql as q
from utterscope.plans import tables as tb
from utterscope.plans.registry import query

R6 = 6


def evaluated(spark, sf, temperature=tb.TEMPERATURE, threshold=tb.THRESHOLD):
    c = tb.classified(spark, sf, temperature, threshold)
    return c.select("vec_id", "true_label", F.col("tool_label").alias("pred_label"),
                    "confidence", "probs", "class_names")


EVAL = f"""{q.classified_cte()},
ev AS (SELECT vec_id, true_label, tool_label AS pred_label, confidence, probs, class_names,
              coalesce(true_label = tool_label, false) AS correct FROM classified)"""

PRF = """pairs AS (SELECT true_label AS t, pred_label AS p, count(*) AS c FROM ev GROUP BY 1, 2),
universe AS (SELECT t AS label FROM pairs UNION SELECT p FROM pairs),
cnt AS (
  SELECT u.label,
         coalesce((SELECT sum(c) FROM pairs WHERE t = u.label AND p = u.label), 0) AS tp,
         coalesce((SELECT sum(c) FROM pairs WHERE p = u.label), 0) AS n_pred,
         coalesce((SELECT sum(c) FROM pairs WHERE t = u.label), 0) AS support
  FROM universe u),
prf0 AS (
  SELECT label, support,
         CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM cnt),
prf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                 ELSE 0.0 END AS f1 FROM prf0)"""


@query("accuracy", f"""WITH {EVAL}
SELECT round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM ev""")
def accuracy(spark, sf):
    a = mt.accuracy(evaluated(spark, sf))
    return a.select(F.round("accuracy", R6).alias("accuracy"), "n")


@query("f1_scores", f"""WITH {EVAL}, {PRF}
SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro FROM prf""")
def f1_scores(spark, sf):
    """E6 (weighted by support) + E7 (macro over the true ∪ predicted labels)."""
    f = mt.f1_scores(evaluated(spark, sf))
    return f.select(F.round("f1_weighted", R6).alias("f1_weighted"), F.round("f1_macro", R6).alias("f1_macro"))


@query("classification_report", f"""WITH {EVAL}, {PRF}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, round(avg(CAST(correct AS DOUBLE)), 6), count(*) FROM ev
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM prf""")
def classification_report(spark, sf):
    r = mt.classification_report(evaluated(spark, sf))
    return r.select("label", *[F.round(c, R6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("confusion_matrix", f"""WITH {EVAL},
universe AS (SELECT true_label AS label FROM ev UNION SELECT pred_label FROM ev),
grid AS (SELECT a.label AS true_label, b.label AS pred_label FROM universe a CROSS JOIN universe b),
cnt AS (SELECT true_label, pred_label, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT g.true_label, g.pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt c USING (true_label, pred_label)""")
def confusion_matrix(spark, sf):
    """E9 long form, zero-filled over the label union."""
    return mt.confusion_matrix(evaluated(spark, sf))


@query("label_universe", f"""WITH {EVAL}
SELECT DISTINCT label FROM (SELECT true_label AS label FROM ev UNION ALL SELECT pred_label FROM ev) t""")
def label_universe(spark, sf):
    """G8."""
    return mt.label_universe(evaluated(spark, sf))


@query("confidence_stats", f"""WITH {EVAL}
SELECT round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median,
       round(stddev_pop(confidence), 6) AS std, round(min(confidence), 6) AS min,
       round(max(confidence), 6) AS max, count(*) AS n FROM ev""")
def confidence_stats(spark, sf):
    """E10."""
    s = mt.confidence_stats(evaluated(spark, sf))
    return s.select(*[F.round(c, R6).alias(c) for c in ("mean", "median", "std", "min", "max")], "n")


@query("confidence_bands", f"""WITH {EVAL},
bands(band_order, band) AS (VALUES (0, 'Very High (>0.90)'), (1, 'High (0.80-0.90)'),
  (2, 'Medium (0.70-0.80)'), (3, 'Low (0.50-0.70)'), (4, 'Very Low (<0.50)')),
cnt AS (SELECT
  sum(CASE WHEN confidence > 0.90 THEN 1 ELSE 0 END) AS b0,
  sum(CASE WHEN confidence >= 0.80 AND confidence <= 0.90 THEN 1 ELSE 0 END) AS b1,
  sum(CASE WHEN confidence >= 0.70 AND confidence < 0.80 THEN 1 ELSE 0 END) AS b2,
  sum(CASE WHEN confidence >= 0.50 AND confidence < 0.70 THEN 1 ELSE 0 END) AS b3,
  sum(CASE WHEN confidence < 0.50 THEN 1 ELSE 0 END) AS b4, count(*) AS total FROM ev)
SELECT band_order, band,
  CAST(CASE band_order WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 ELSE b4 END AS BIGINT) AS n,
  round(100.0 * (CASE band_order WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 ELSE b4 END) / total, 6) AS pct
FROM bands, cnt""")
def confidence_bands(spark, sf):
    """E11."""
    return mt.confidence_bands(evaluated(spark, sf))


@query("confidence_by_correctness", f"""WITH {EVAL}
SELECT correct, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median, count(*) AS n
FROM ev GROUP BY correct""")
def confidence_by_correctness(spark, sf):
    """E12."""
    s = mt.confidence_by_correctness(evaluated(spark, sf))
    return s.select("correct", F.round("mean", R6).alias("mean"), F.round("median", R6).alias("median"), "n")


def _hist_sql(bins: int, by: str | None) -> str:
    key = f"{by}, " if by else ""
    grid = (f"SELECT DISTINCT {by}, b AS bin FROM ev, range({bins}) r(b)" if by
            else f"SELECT b AS bin FROM range({bins}) r(b)")
    join = f"USING ({by}, bin)" if by else "USING (bin)"
    return f"""WITH {EVAL},
rng AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM ev),
binned AS (SELECT {key}CAST(CASE WHEN hi = lo THEN 0
    ELSE least(floor((confidence - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin
  FROM ev, rng),
cnt AS (SELECT {key}bin, count(*) AS n FROM binned GROUP BY {key}bin),
grid AS ({grid})
SELECT {key}CAST(bin AS INTEGER) AS bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM grid LEFT JOIN cnt {join}, rng"""


@query("confidence_histogram", _hist_sql(50, None))
def confidence_histogram(spark, sf):
    """50 equal-width bins over [min, max]."""
    h = mt.histogram(evaluated(spark, sf), "confidence", 50)
    return h.select(F.col("bin").cast("int").alias("bin"), F.round("bin_lo", R6).alias("bin_lo"),
                    F.round("bin_hi", R6).alias("bin_hi"), "n")


@query("confidence_histogram_by_correctness", _hist_sql(30, "correct"))
def confidence_histogram_by_correctness(spark, sf):
    """30 bins, split by correctness."""
    h = mt.histogram(mt.with_correct(evaluated(spark, sf)), "confidence", 30, by="correct")
    return h.select("correct", F.col("bin").cast("int").alias("bin"), F.round("bin_lo", R6).alias("bin_lo"),
                    F.round("bin_hi", R6).alias("bin_hi"), "n")


@query("error_patterns", f"""WITH {EVAL}
SELECT true_label, pred_label, n, pct FROM (
  SELECT true_label, pred_label, count(*) AS n,
         round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
  FROM ev WHERE NOT correct GROUP BY 1, 2) t
ORDER BY n DESC, true_label, pred_label LIMIT 10""")
def error_patterns(spark, sf):
    """Top-10 (true, predicted) error pairs."""
    return mt.error_patterns(evaluated(spark, sf), 10)


@query("error_summary", f"""WITH {EVAL}
SELECT count(*) AS n, CAST(sum(CASE WHEN NOT correct THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       round(100.0 * sum(CASE WHEN NOT correct THEN 1 ELSE 0 END) / count(*), 6) AS error_pct,
       CAST(sum(CASE WHEN NOT correct AND confidence < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS low_conf_errors,
       CAST(sum(CASE WHEN NOT correct AND confidence >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS high_conf_errors
FROM ev""")
def error_summary(spark, sf):
    """E15."""
    return mt.error_summary(evaluated(spark, sf))


@query("top_errors", f"""WITH {EVAL}
SELECT vec_id, true_label, pred_label, round(confidence, 6) AS confidence FROM ev
WHERE NOT correct AND confidence >= 0.8 ORDER BY confidence DESC, vec_id LIMIT 5""")
def top_errors(spark, sf):
    """The five most confident errors (conf >= 0.8) — a top-k report."""
    e = mt.with_correct(evaluated(spark, sf))
    return (e.where(~F.col("correct") & (F.col("confidence") >= 0.8))
             .orderBy(F.desc("confidence"), "vec_id").limit(5)
             .select("vec_id", "true_label", "pred_label", F.round("confidence", R6).alias("confidence")))


@query("error_sheet", f"""WITH {EVAL}
SELECT vec_id, true_label, pred_label, round(confidence, 6) AS confidence, correct FROM ev
WHERE NOT correct""")
def error_sheet(spark, sf):
    """Every error, ordered by confidence ascending."""
    e = mt.with_correct(evaluated(spark, sf))
    return (e.where(~F.col("correct")).orderBy("confidence", "vec_id")
             .select("vec_id", "true_label", "pred_label", F.round("confidence", R6).alias("confidence"),
                     "correct"))


@query("evaluation_sheet", f"""WITH {EVAL},
ranked AS (
  SELECT vec_id, class_names[i] AS label, row_number() OVER (PARTITION BY vec_id ORDER BY probs[i] DESC, i) AS r
  FROM (SELECT vec_id, probs, class_names, unnest(generate_series(1, len(probs))) AS i FROM ev) t),
top3 AS (SELECT vec_id, string_agg(label, '|' ORDER BY r) AS top3_intents FROM ranked WHERE r <= 3 GROUP BY vec_id)
SELECT vec_id, true_label, pred_label, round(confidence, 6) AS confidence, correct, top3_intents
FROM ev JOIN top3 USING (vec_id)""")
def evaluation_sheet(spark, sf):
    """Text key, truth, prediction, confidence, correctness and top-3."""
    e = mt.with_correct(evaluated(spark, sf))
    top = sc.top_k_labels("probs", "class_names", 3)
    return e.select("vec_id", "true_label", "pred_label", F.round("confidence", R6).alias("confidence"),
                    "correct", F.array_join(F.transform(top, lambda x: x["label"]), "|").alias("top3_intents"))


SWEEP = [(1.0, 0.0), (1.2, 0.65), (0.8, 0.5), (1.5, 0.65)]


@query("evaluation_sweep", f"""WITH {q.scored_cte()},
settings(temperature, threshold) AS (VALUES {", ".join(f"({t}, {h})" for t, h in SWEEP)}),
sc AS (SELECT s.vec_id, s.true_label, s.class_names, st.temperature, st.threshold,
              {q.softmax_sql('s.logits', 'st.temperature')} AS probs FROM scored s, settings st),
dec AS (SELECT *, list_max(probs) AS confidence, class_names[list_position(probs, list_max(probs))] AS pl FROM sc),
ev AS (SELECT temperature, threshold, true_label, confidence,
              CASE WHEN pl = 'NOMATCH' THEN 'NOMATCH' WHEN confidence < threshold THEN 'UNLISTED' ELSE pl END AS pred_label
       FROM dec)
SELECT round(temperature, 6) AS temperature, round(threshold, 6) AS threshold,
       round(avg(CASE WHEN true_label = pred_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(confidence), 6) AS mean_confidence,
       CAST(sum(CASE WHEN pred_label = 'UNLISTED' THEN 1 ELSE 0 END) AS BIGINT) AS n_unlisted,
       count(*) AS n
FROM ev GROUP BY temperature, threshold""")
def evaluation_sweep(spark, sf):
    """I6 over a settings table: every (T, threshold) in one pass — each
    scored row is expanded by a generator over the (tiny) settings list."""
    s = tb.scored(spark, sf)
    settings = F.array(*[F.struct(F.lit(t).alias("temperature"), F.lit(h).alias("threshold"))
                         for t, h in SWEEP])
    x = s.select("vec_id", "true_label", "class_names", "logits", F.explode(settings).alias("st"))
    x = x.select("*", "st.temperature", "st.threshold").drop("st")
    x = x.withColumn("probs", vx.softmax("logits", F.col("temperature")))
    x = sc.argmax_confidence(x).withColumn("pl", F.element_at("class_names", F.col("pred_idx") + 1))
    pred = (F.when(F.col("pl") == "NOMATCH", F.lit("NOMATCH"))
             .when(F.col("confidence") < F.col("threshold"), F.lit("UNLISTED")).otherwise(F.col("pl")))
    x = x.withColumn("pred_label", pred)
    return x.groupBy("temperature", "threshold").agg(
        F.round(F.avg(F.when(F.col("true_label") == F.col("pred_label"), 1.0).otherwise(0.0)), R6).alias("accuracy"),
        F.round(F.avg("confidence"), R6).alias("mean_confidence"),
        F.sum(F.when(F.col("pred_label") == "UNLISTED", 1).otherwise(0)).cast("long").alias("n_unlisted"),
        F.count("*").alias("n")).select(
        F.round("temperature", R6).alias("temperature"), F.round("threshold", R6).alias("threshold"),
        "accuracy", "mean_confidence", "n_unlisted", "n")
