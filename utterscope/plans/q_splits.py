"""Split, encoding and weighting queries (D1–D6, E1–E4) over documents ⋈ labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterscope.operators import splits as sp
from utterscope.operators import weights as wt
from utterscope.operators.prep import dense_index
from utterscope.plans import tables as tb
from utterscope.plans.registry import query

SEED = 42
TEST = 0.15
SEEDS = [42, 43, 44, 45, 46]
LANG_DIM = ["de", "en", "es", "fr", "it"]          # 'it' has no rows
LANG_PRIORITY = [("en", 90), ("fr", 40), ("de", 10)]  # 'es' falls back to 50


def labelled(spark, sf):
    return tb.labelled_documents(spark, sf).select("doc_id", "lang", "source", "quality")


LAB = "d AS (SELECT doc_id, lang, source, quality FROM documents JOIN labels USING (doc_id))"


def _split_sql(label: str, frac: float, seeds: list[int]) -> str:
    seed_vals = ", ".join(f"({s})" for s in seeds)
    return f"""{LAB},
seeds(seed) AS (VALUES {seed_vals}),
h AS (SELECT s.seed, d.*, md5(CAST(s.seed AS VARCHAR) || ':' || CAST(d.doc_id AS VARCHAR)) AS hh FROM d, seeds s),
cnt AS (SELECT seed, {label}, count(*) AS n FROM h GROUP BY seed, {label}),
q0 AS (SELECT *, sum(n) OVER (PARTITION BY seed) AS tot,
              CAST(ceil(sum(n) OVER (PARTITION BY seed) * CAST({frac} AS DOUBLE)) AS BIGINT) AS nt FROM cnt),
q1 AS (SELECT *, (n * nt) // tot AS base, n * nt - ((n * nt) // tot) * tot AS rem FROM q0),
q2 AS (SELECT *, nt - sum(base) OVER (PARTITION BY seed) AS lft,
              row_number() OVER (PARTITION BY seed ORDER BY rem DESC, {label}) AS k FROM q1),
quota AS (SELECT seed, {label}, base + CASE WHEN k <= lft THEN 1 ELSE 0 END AS quota FROM q2),
r AS (SELECT h.*, row_number() OVER (PARTITION BY seed, {label} ORDER BY hh, doc_id) AS rn FROM h),
split AS (SELECT r.*, rn <= quota AS is_test FROM r JOIN quota USING (seed, {label}))"""


@query("stratified_split", f"""WITH {_split_sql('quality', TEST, [SEED])}
SELECT doc_id, quality, is_test FROM split""")
def stratified_split(spark, sf):
    """Exact 15 % stratified hold-out on quality, seed 42."""
    s = sp.stratified_split(labelled(spark, sf), "quality", "doc_id", TEST, SEED)
    return s.select("doc_id", "quality", "is_test")


@query("split_sizes", f"""WITH {_split_sql('quality', TEST, [SEED])}
SELECT quality, is_test, count(*) AS n FROM split GROUP BY quality, is_test""")
def split_sizes(spark, sf):
    s = sp.stratified_split(labelled(spark, sf), "quality", "doc_id", TEST, SEED)
    return s.groupBy("quality", "is_test").agg(F.count("*").alias("n"))


@query("stratified_folds", f"""WITH {LAB}
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality
       ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold FROM d""")
def stratified_folds(spark, sf):
    """5 balanced folds per class."""
    return sp.stratified_folds(labelled(spark, sf), "quality", "doc_id", 5, SEED).select("doc_id", "quality", "fold")


@query("seeded_shuffle", f"""WITH {_split_sql('quality', TEST, [SEED])}
SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS position
FROM split WHERE is_test""")
def seeded_shuffle(spark, sf):
    """D3: the test set in seeded order (position = dense index)."""
    s = sp.stratified_split(labelled(spark, sf), "quality", "doc_id", TEST, SEED).where("is_test")
    s = s.withColumn("_h", sp.seeded_hash(SEED, "doc_id"))
    return dense_index(s, ["_h", "doc_id"], "position").select("doc_id", "position")


@query("multi_seed_splits", f"""WITH {_split_sql('lang', TEST, SEEDS)}
SELECT seed, doc_id, lang, is_test FROM split""")
def multi_seed_splits(spark, sf):
    """One stratified split per seed 42..46 in one pass (class = lang)."""
    s = sp.multi_seed_splits(labelled(spark, sf), "lang", "doc_id", TEST, SEEDS)
    return s.select(F.col("seed").cast("int").alias("seed"), "doc_id", "lang", "is_test")


@query("label_index", """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
FROM (SELECT DISTINCT source AS label FROM documents WHERE source IS NOT NULL) t""")
def label_index(spark, sf):
    """Sorted distinct labels -> ids."""
    return sp.label_index(tb.table(spark, sf, "documents"), "source")


@query("map_labels", f"""WITH {_split_sql('quality', TEST, [SEED])},
idx AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
        FROM (SELECT DISTINCT source AS label FROM split WHERE NOT is_test) t)
SELECT s.doc_id, s.source, CAST(coalesce(i.label_id, -1) AS INTEGER) AS label_id
FROM split s LEFT JOIN idx i ON s.source = i.label WHERE s.is_test""")
def map_labels(spark, sf):
    """Label ids fitted on one side, applied to the test side
    (unknown -> -1)."""
    s = sp.stratified_split(labelled(spark, sf), "quality", "doc_id", TEST, SEED)
    idx = sp.label_index(s.where(~F.col("is_test")), "source")
    return sp.map_labels(s.where("is_test"), "source", idx, -1).select("doc_id", "source", "label_id")


@query("class_distribution", """SELECT event_type, n, pct FROM (
  SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
  FROM events GROUP BY event_type) t ORDER BY n DESC, event_type LIMIT 10""")
def class_distribution(spark, sf):
    """Top-10 classes by count (events.event_type)."""
    return wt.class_distribution(tb.table(spark, sf, "events"), "event_type", 10)


def _dim(spark):
    return spark.createDataFrame([(x,) for x in LANG_DIM], "lang string")


W_SQL = f"""{LAB},
dim(lang) AS (VALUES {", ".join(f"('{x}')" for x in LANG_DIM)}),
cnt AS (SELECT dim.lang, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM dim
        LEFT JOIN (SELECT lang, count(*) AS n FROM d GROUP BY lang) c USING (lang)),
w0 AS (SELECT lang, n, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * greatest(n, 1)) AS w FROM cnt),
w1 AS (SELECT *, CASE WHEN max(w) OVER () - min(w) OVER () < 1e-6 THEN 1.25
                 ELSE 0.5 + 1.5 * (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) END AS w_norm FROM w0)"""


@query("class_weights", f"""WITH {W_SQL}
SELECT lang, n, round(w_norm / avg(w_norm) OVER (), 6) AS weight FROM w1""")
def class_weights(spark, sf):
    """Inverse-frequency weights, min-max to [0.5, 2], mean 1; a label in
    the dimension with no rows is included."""
    w = wt.class_weights(labelled(spark, sf), "lang", _dim(spark))
    return w.select("lang", "n", F.round("weight", 6).alias("weight"))


@query("minmax_normalise", """SELECT event_id, round(CASE WHEN hi - lo < 1e-6 THEN 1.25
  ELSE 0.5 + 1.5 * (value - lo) / (hi - lo) END, 6) AS value_norm
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) b""")
def minmax_normalise(spark, sf):
    """E3 on a large column (bounds as scalar subqueries)."""
    e = wt.minmax_normalise(tb.table(spark, sf, "events"), "value", 0.5, 2.0, out="value_norm")
    return e.select("event_id", F.round("value_norm", 6).alias("value_norm"))


CASES = [("both", True, True), ("balance", True, False), ("priority", False, True), ("none", False, False)]


@query("priority_weights", f"""WITH {W_SQL},
pr(lang, priority) AS (VALUES {", ".join(f"('{a}', {b})" for a, b in LANG_PRIORITY)}),
t AS (SELECT w1.lang, w1.n, w1.w_norm, 0.5 + 1.5 * CAST(coalesce(pr.priority, 50) AS DOUBLE) / 100.0 AS prio
      FROM w1 LEFT JOIN pr USING (lang)),
cases(name, ub, up) AS (VALUES {", ".join(f"('{n}', {str(b).lower()}, {str(p).lower()})" for n, b, p in CASES)}),
m AS (SELECT name, lang, n, CASE WHEN ub AND up THEN 0.5 * w_norm + 0.5 * prio WHEN ub THEN w_norm
                                 WHEN up THEN prio ELSE 1.0 END AS mix FROM t, cases)
SELECT name AS case_name, lang, n,
       round(least(greatest(mix / avg(mix) OVER (PARTITION BY name), 0.1), 10.0), 6) AS weight FROM m""")
def priority_weights(spark, sf):
    """Balance / priority mix (alpha 0.5) in its four on/off cases."""
    dim = spark.createDataFrame(
        [(x, dict(LANG_PRIORITY).get(x)) for x in LANG_DIM], "lang string, priority int")
    out = None
    for name, ub, up in CASES:
        w = wt.priority_weights(labelled(spark, sf), "lang", dim, 0.5, ub, up)
        w = w.select(F.lit(name).alias("case_name"), "lang", "n", F.round("weight", 6).alias("weight"))
        out = w if out is None else out.unionByName(w)
    return out
