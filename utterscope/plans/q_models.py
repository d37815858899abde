"""Calibration, tuning and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterscope.operators import calibration as cb
from utterscope.operators import splits as sp
from utterscope.operators import tuning as tu
from utterscope.plans import sql as q
from utterscope.plans import tables as tb
from utterscope.plans.registry import query

R6 = 6
GRID = cb.log_grid(0.1, 10.0, 41)
SETTINGS = [(t, h) for t in (0.8, 1.0, 1.2, 1.5) for h in (0.5, 0.65)]
CAL_FRAC = 0.20


def _nll_sql(src: str, grid_cte: str) -> str:
    """mean NLL per grid temperature of ``src(logits, label)``."""
    return f"""SELECT g.t AS temperature, avg(
      list_max(list_transform(s.logits, lambda x: x / g.t))
      + ln(list_sum(list_transform(s.logits, lambda x: exp(x / g.t - list_max(list_transform(s.logits, lambda y: y / g.t))))))
      - s.logits[s.label + 1] / g.t) AS nll
    FROM {src} s, {grid_cte} g GROUP BY g.t"""


def _fit_sql(src: str) -> str:
    """CTEs fitting T on ``src``: a 41-point log grid then two 21-point refinements."""
    vals = ", ".join(f"({i}, {repr(t)})" for i, t in enumerate(GRID))
    out = f"""g1(i, t) AS (VALUES {vals}),
n1 AS ({_nll_sql(src, 'g1')}),
b1 AS (SELECT temperature AS t, nll FROM n1 ORDER BY nll, temperature LIMIT 1)"""
    prev_g, prev_b, prev_n = "g1", "b1", 41
    for r in (2, 3):
        out += f""",
i{r} AS (SELECT i FROM {prev_g} WHERE t = (SELECT t FROM {prev_b})),
ab{r} AS (SELECT (SELECT t FROM {prev_g} WHERE i = greatest((SELECT i FROM i{r}) - 1, 0)) AS a,
                 (SELECT t FROM {prev_g} WHERE i = least((SELECT i FROM i{r}) + 1, {prev_n - 1})) AS b),
g{r} AS (SELECT j AS i, a + (b - a) * j / 20 AS t FROM ab{r}, range(21) r(j)),
n{r} AS ({_nll_sql(src, f'g{r}')}),
b{r} AS (SELECT temperature AS t, nll FROM n{r} ORDER BY nll, temperature LIMIT 1)"""
        prev_g, prev_b, prev_n = f"g{r}", f"b{r}", 21
    return out


SCORED = q.scored_cte()


@query("nll_at_temperature", f"""WITH {SCORED}, g(i, t) AS (VALUES {", ".join(f"({i}, {repr(t)})" for i, t in enumerate(GRID))})
SELECT round(temperature, 6) AS temperature, round(nll, 6) AS nll FROM ({_nll_sql('scored', 'g')}) z""")
def nll_at_temperature(spark, sf):
    """Mean NLL of the scored rows at 41 log-spaced temperatures."""
    n = cb.nll_at_temperature(tb.scored(spark, sf), GRID, "logits", "label")
    return n.select(F.round("temperature", R6).alias("temperature"), F.round("nll", R6).alias("nll"))


@query("fit_temperature", f"""WITH {SCORED}, {_fit_sql('scored')}
SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM b3""")
def fit_temperature(spark, sf):
    """I4: temperature minimising the NLL (grid + two refinements)."""
    from utterscope.session import scratch_table_path
    from utterscope.sources import writers as wr
    t, nll = cb.fit_temperature(tb.scored(spark, sf), "logits", "label")
    path = scratch_table_path(spark, "calibration")
    wr.save_calibration(spark, t, path, nll)          # A8: persisted, then read back
    t_loaded = wr.load_calibration(spark, path)
    return spark.read.parquet(path).where(F.col("temperature") == t_loaded).select(
        F.round("temperature", R6).alias("temperature"), F.round("nll", R6).alias("nll"))


CAL_SPLIT = f"""{SCORED},
hh AS (SELECT *, md5('42:' || CAST(vec_id AS VARCHAR)) AS h FROM scored),
cnt AS (SELECT label, count(*) AS n FROM hh GROUP BY label),
q0 AS (SELECT *, sum(n) OVER () AS tot, CAST(ceil(sum(n) OVER () * CAST({CAL_FRAC} AS DOUBLE)) AS BIGINT) AS nt FROM cnt),
q1 AS (SELECT *, (n * nt) // tot AS base, n * nt - ((n * nt) // tot) * tot AS rem FROM q0),
q2 AS (SELECT *, nt - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label) AS k FROM q1),
quota AS (SELECT label, base + CASE WHEN k <= lft THEN 1 ELSE 0 END AS quota FROM q2),
rk AS (SELECT hh.*, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS rn FROM hh),
cal AS (SELECT rk.* FROM rk JOIN quota USING (label) WHERE rn <= quota),
rest AS (SELECT rk.* FROM rk JOIN quota USING (label) WHERE rn > quota)"""


def _report_sql(t_expr: str, stage: str) -> str:
    p = q.softmax_sql("logits", "tt.tstar" if t_expr != "1.0" else "1.0")
    return f"""SELECT '{stage}' AS stage, {t_expr} AS temperature,
  avg(CASE WHEN list_position(pr, list_max(pr)) - 1 = label THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(list_max(pr)) AS mean_confidence, count(*) FILTER (WHERE list_max(pr) >= 0.9999) AS n_saturated,
  median(list_max(pr)) AS median_confidence
FROM (SELECT label, {p} AS pr FROM rest, tt) z"""


@query("calibration_report", f"""WITH {CAL_SPLIT}, {_fit_sql('cal')}, tt AS (SELECT t AS tstar FROM b3),
rep AS ({_report_sql('1.0', 'before')} UNION ALL {_report_sql('(SELECT t FROM b3)', 'after')})
SELECT stage, round(temperature, 6) AS temperature, round(accuracy, 6) AS accuracy,
       round(mean_confidence, 6) AS mean_confidence, round(median_confidence, 6) AS median_confidence,
       n_saturated, CASE WHEN (SELECT t FROM b3) > 1.5 THEN 'over-confident'
                         WHEN (SELECT t FROM b3) < 0.8 THEN 'under-confident' ELSE 'reasonable' END AS verdict
FROM rep""")
def calibration_report(spark, sf):
    """I8 + E29: hold out 20 % (stratified), fit T there, report before /
    after on the remaining rows."""
    s = sp.stratified_split(tb.scored(spark, sf), "label", "vec_id", CAL_FRAC, 42)
    cal, rest = s.where("is_test"), s.where(~F.col("is_test"))
    t, _ = cb.fit_temperature(cal, "logits", "label")
    r = cb.calibration_report(rest, t, "logits", "label")
    return r.select("stage", F.round("temperature", R6).alias("temperature"), F.round("accuracy", R6).alias("accuracy"),
                    F.round("mean_confidence", R6).alias("mean_confidence"),
                    F.round("median_confidence", R6).alias("median_confidence"), "n_saturated", "verdict")


def _trials(spark, sf):
    return tu.cv_trials(tb.vectors(spark, sf), "label", "vec_id", "v", SETTINGS, tb.intent_name, k=5)


CV_SQL = f"""emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS fold
      FROM emb),
tr AS (SELECT h.held, f.label, f.v FROM f, range(5) h(held) WHERE f.fold <> h.held),
cl AS (SELECT held, label, unnest(generate_series(1, len(v))) AS pos, unnest(v) AS x FROM tr),
cent AS (SELECT held, label, list(m ORDER BY pos) AS c FROM
         (SELECT held, label, pos, avg(x) AS m FROM cl GROUP BY held, label, pos) z GROUP BY held, label),
cls AS (SELECT held, label AS cls, {q.intent_name_sql('label')} AS name, c,
               sqrt(list_sum(list_transform(c, lambda x: x * x))) AS cnorm FROM cent),
lg AS (SELECT f.vec_id, f.fold, f.label,
         list(20.0 * list_dot_product(f.v, k.c) / (sqrt(list_sum(list_transform(f.v, lambda x: x * x))) * k.cnorm)
              ORDER BY k.cls) AS logits, list(k.name ORDER BY k.cls) AS names
       FROM f JOIN cls k ON k.held = f.fold GROUP BY f.vec_id, f.fold, f.label),
settings(trial, temperature, threshold) AS (VALUES {", ".join(f"({i}, {t}, {h})" for i, (t, h) in enumerate(SETTINGS))}),
pr AS (SELECT s.trial, s.temperature, s.threshold, lg.fold, {q.intent_name_sql('lg.label')} AS t,
              lg.names, {q.softmax_sql('lg.logits', 's.temperature')} AS probs FROM lg, settings s),
dec AS (SELECT trial, temperature, threshold, fold, t,
          CASE WHEN names[list_position(probs, list_max(probs))] = 'NOMATCH' THEN 'NOMATCH'
               WHEN list_max(probs) < threshold THEN 'UNLISTED'
               ELSE names[list_position(probs, list_max(probs))] END AS p FROM pr),
pairs AS (SELECT trial, temperature, threshold, fold, t, p, count(*) AS c FROM dec GROUP BY ALL),
lab AS (SELECT DISTINCT trial, temperature, threshold, fold, t AS label FROM pairs
        UNION SELECT DISTINCT trial, temperature, threshold, fold, p FROM pairs),
cnt AS (SELECT l.*,
   coalesce((SELECT sum(c) FROM pairs x WHERE x.trial = l.trial AND x.fold = l.fold AND x.t = l.label AND x.p = l.label), 0) AS tp,
   coalesce((SELECT sum(c) FROM pairs x WHERE x.trial = l.trial AND x.fold = l.fold AND x.p = l.label), 0) AS npred,
   coalesce((SELECT sum(c) FROM pairs x WHERE x.trial = l.trial AND x.fold = l.fold AND x.t = l.label), 0) AS support
   FROM lab l),
prf AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pp,
                  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rr FROM cnt),
f1 AS (SELECT *, CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0.0 END AS f FROM prf),
trials AS (SELECT trial, fold AS step, temperature, threshold, sum(f * support) / sum(support) AS f1
           FROM f1 GROUP BY trial, fold, temperature, threshold),
tv AS (SELECT *, avg(f1) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
       FROM trials)"""


@query("cv_trials", f"""WITH {CV_SQL}
SELECT CAST(trial AS INTEGER) AS trial, CAST(step AS INTEGER) AS step, round(temperature, 6) AS temperature,
       round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(value, 6) AS value FROM tv""")
def cv_trials(spark, sf):
    """5-fold CV of the centroid scorer over 8 (T, threshold) settings,
    centroids refit per fold."""
    t = _trials(spark, sf)
    return t.select(F.col("trial").cast("int").alias("trial"), F.col("step").cast("int").alias("step"),
                    F.round("temperature", R6).alias("temperature"), F.round("threshold", R6).alias("threshold"),
                    F.round("f1", R6).alias("f1"), F.round("value", R6).alias("value"))


@query("fold_summary", f"""WITH {CV_SQL}
SELECT CAST(trial AS INTEGER) AS trial, round(temperature, 6) AS temperature, round(threshold, 6) AS threshold,
       round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1, count(*) AS n_folds
FROM tv GROUP BY trial, temperature, threshold""")
def fold_summary(spark, sf):
    """E25."""
    s = tu.fold_summary(_trials(spark, sf))
    return s.select(F.col("trial").cast("int").alias("trial"), F.round("temperature", R6).alias("temperature"),
                    F.round("threshold", R6).alias("threshold"), F.round("mean_f1", R6).alias("mean_f1"),
                    F.round("std_f1", R6).alias("std_f1"), "n_folds")


@query("best_trial", f"""WITH {CV_SQL},
s AS (SELECT trial, temperature, threshold, avg(f1) AS mean_f1 FROM tv GROUP BY trial, temperature, threshold)
SELECT CAST(trial AS INTEGER) AS trial, round(temperature, 6) AS temperature, round(threshold, 6) AS threshold,
       round(mean_f1, 6) AS mean_f1 FROM s ORDER BY mean_f1 DESC, trial LIMIT 1""")
def best_trial(spark, sf):
    """E26 (+A9: the trials table and best row round-trip through parquet)."""
    from utterscope.session import scratch_table_path
    from utterscope.sources import writers as wr
    path = scratch_table_path(spark, "trials")
    wr.save_trials(_trials(spark, sf), path)
    b = wr.read_best_params(spark, path)
    return b.select(F.col("trial").cast("int").alias("trial"), F.round("temperature", R6).alias("temperature"),
                    F.round("threshold", R6).alias("threshold"), F.round("mean_f1", R6).alias("mean_f1"))


@query("median_pruning", f"""WITH {CV_SQL},
m AS (SELECT *, median(value) OVER (PARTITION BY step ORDER BY trial
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM tv)
SELECT CAST(trial AS INTEGER) AS trial,
       CAST(coalesce(min(CASE WHEN trial >= 5 AND step >= 2 AND value < med THEN step END), -1) AS INTEGER) AS pruned_at_step,
       min(CASE WHEN trial >= 5 AND step >= 2 AND value < med THEN step END) IS NOT NULL AS pruned
FROM m GROUP BY trial""")
def median_pruning(spark, sf):
    """Median-pruning decisions over the trials table."""
    p = tu.median_pruning(_trials(spark, sf))
    return p.select(F.col("trial").cast("int").alias("trial"),
                    F.coalesce("pruned_at_step", F.lit(-1)).cast("int").alias("pruned_at_step"), "pruned")
