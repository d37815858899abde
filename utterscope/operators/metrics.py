"""Evaluation aggregates over a scored table.

Inputs carry ``true_label``, ``pred_label`` and ``confidence`` columns.
Every metric is a partial-aggregated ``groupBy`` (per label or per label
pair, i.e. bounded by the class count squared) followed by work on that
small table.  Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterscope.functions import lexicon as lx

def _all():
    return Window.partitionBy()


def share_by(df: DataFrame, col: str) -> DataFrame:
    """(col, n, pct) — count and percentage per value."""
    return (df.groupBy(col).agg(F.count("*").alias("n"))
              .withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(_all()), 6)))


def with_correct(df: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    return df.withColumn("correct", F.coalesce(F.col(true) == F.col(pred), F.lit(False)))


# ---------------------------------------------------------------- E5 ----
def accuracy(df: DataFrame, true="true_label", pred="pred_label") -> DataFrame:
    return with_correct(df, true, pred).agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("n"))


# ------------------------------------------------------- E6–E8, G8 ----
def label_universe(df: DataFrame, true="true_label", pred="pred_label") -> DataFrame:
    """Distinct union of true and predicted labels."""
    return df.select(F.col(true).alias("label")).union(df.select(F.col(pred).alias("label"))).distinct()


def pair_counts(df: DataFrame, true="true_label", pred="pred_label", by: list | None = None) -> DataFrame:
    """(by..., t, p, c): rows per true and predicted label, kept — the one
    pass over the input from which label metrics follow."""
    from utterscope.session import reliable_checkpoint
    return reliable_checkpoint(df.groupBy(*(by or []), F.col(true).alias("t"), F.col(pred).alias("p"))
                               .agg(F.count("*").alias("c")))


def per_label_counts(df: DataFrame, true="true_label", pred="pred_label", by: list | None = None,
                     pairs: DataFrame | None = None) -> DataFrame:
    """(by..., label, tp, fp, fn, support) over the label union (per group)."""
    by = list(by or [])
    pairs = pairs if pairs is not None else pair_counts(df, true, pred, by)
    # every pair gives its count to the true label's support and to the predicted label
    sides = F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("c").alias("support"), F.lit(0).cast("long").alias("n_pred"),
                 F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("c").alias("n_pred"),
                 F.lit(0).cast("long").alias("tp")))).alias("s")
    u = pairs.select(*by, sides).groupBy(*by, F.col("s.label").alias("label")).agg(
        F.sum("s.support").alias("support"), F.sum("s.n_pred").alias("n_pred"), F.sum("s.tp").alias("tp"))
    return u.select(*by, "label", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"),
                    (F.col("support") - F.col("tp")).alias("fn"), "support")


def per_label_prf(df: DataFrame, true="true_label", pred="pred_label", by: list | None = None,
                  pairs: DataFrame | None = None) -> DataFrame:
    """precision/recall/F1 per label, 0 where undefined (zero_division = 0)."""
    c = per_label_counts(df, true, pred, by, pairs)
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = c.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def f1_scores(df: DataFrame, true="true_label", pred="pred_label", by: list | None = None) -> DataFrame:
    """E6 + E7: weighted F1 (by true support) and macro F1 over the label union."""
    prf = per_label_prf(df, true, pred, by)
    return prf.groupBy(*(by or [])).agg(
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"))


def classification_report(df: DataFrame, true="true_label", pred="pred_label") -> DataFrame:
    """Per-label rows plus accuracy, macro avg and weighted avg rows, all
    from one count per pair of labels."""
    pairs = pair_counts(df, true, pred)
    prf = per_label_prf(df, true, pred, pairs=pairs).select(
        "label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    macro = prf.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    weighted = prf.agg(F.lit("weighted avg").alias("label"),
                       (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    acc = pairs.agg(
        F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        F.try_divide(F.sum(F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(F.lit(0))), F.sum("c")).alias("f1"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("support"))
    return prf.unionByName(acc).unionByName(macro).unionByName(weighted)


# ---------------------------------------------------------------- E9 ----
def confusion_matrix(df: DataFrame, true="true_label", pred="pred_label") -> DataFrame:
    """Long form (true_label, pred_label, n) over the sorted label union, zero-filled.

    The label universe is tiny (classes), so the square is built on it,
    not on rows."""
    counts = pair_counts(df, true, pred).withColumnRenamed("c", "n")
    u = label_universe(counts, "t", "p")
    labels = u.agg(F.sort_array(F.collect_list("label")).alias("ls")).scalar()
    grid = u.select(F.col("label").alias("t"), F.explode(labels).alias("p"))
    return grid.join(counts, ["t", "p"], "left").select(
        F.col("t").alias("true_label"), F.col("p").alias("pred_label"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---------------------------------------------------------- E10–E12 ----
def confidence_stats(df: DataFrame, conf="confidence") -> DataFrame:
    """One row; the median is exact and found in bounded memory."""
    stats = df.agg(F.avg(conf).alias("mean"), F.stddev_pop(conf).alias("std"), F.min(conf).alias("min"),
                   F.max(conf).alias("max"), F.count(conf).alias("n"))
    return stats.withColumn("median", exact_median(df, conf).select("median").scalar())


def band_expr(conf="confidence"):
    c = F.col(conf)
    out = None
    for name, lo, hi, lo_inc, hi_inc in lx.CONFIDENCE_BANDS:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & ((c >= lo) if lo_inc else (c > lo))
        if hi is not None:
            cond = cond & ((c <= hi) if hi_inc else (c < hi))
        out = (F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name)))
    return out


def confidence_bands(df: DataFrame, conf="confidence") -> DataFrame:
    """Count and % per band, empty bands included.

    One pass of conditional sums (bands may overlap at 0.90), then unpivot."""
    aggs = [F.count("*").alias("total")]
    for i, (name, lo, hi, lo_inc, hi_inc) in enumerate(lx.CONFIDENCE_BANDS):
        c = F.col(conf)
        cond = F.lit(True)
        if lo is not None:
            cond = cond & ((c >= lo) if lo_inc else (c > lo))
        if hi is not None:
            cond = cond & ((c <= hi) if hi_inc else (c < hi))
        aggs.append(F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(f"b{i}"))
    wide = df.agg(*aggs)
    stack = ", ".join(f"{i}, '{n}', b{i}" for i, (n, *_rest) in enumerate(lx.CONFIDENCE_BANDS))
    long = wide.selectExpr("total", f"stack({len(lx.CONFIDENCE_BANDS)}, {stack}) AS (band_order, band, n)")
    return long.select(F.col("band_order").cast("int").alias("band_order"), "band", "n",
                       F.round(F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")), 6).alias("pct"))


def confidence_by_correctness(df: DataFrame, conf="confidence", true="true_label",
                              pred="pred_label") -> DataFrame:
    """Mean, exact median and rows of correct and wrong predictions."""
    marked = with_correct(df, true, pred)
    stats = marked.groupBy("correct").agg(F.avg(conf).alias("mean"), F.count("*").alias("n"))
    return stats.join(exact_median(marked, conf, ["correct"]), "correct", "left")


# ---------------------------------------------------------------- E13 ----
def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] of the whole column, last bin closed;
    empty bins included (bins table x groups, both tiny)."""
    keys = [by] if by else []
    lo = df.agg(F.min(col)).scalar()
    hi = df.agg(F.max(col)).scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1))).cast("int")
    counted = df.select(*keys, b.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    seq = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    grid = (df.select(by).distinct().select(by, seq) if by
            else df.sparkSession.range(1).select(seq))
    out = grid.join(counted, keys + ["bin"], "left")
    return out.select(*keys, "bin", (lo + F.col("bin") * width).alias("bin_lo"),
                      (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---------------------------------------------------------- E14–E15 ----
def error_patterns(df: DataFrame, top: int = 10, true="true_label", pred="pred_label") -> DataFrame:
    """Errors by (true, predicted), count and % of errors, top ``top``."""
    err = with_correct(df, true, pred).where(~F.col("correct"))
    g = err.groupBy(true, pred).agg(F.count("*").alias("n"))
    g = g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(_all()), 6))
    return g.orderBy(F.desc("n"), true, pred).limit(top)


def error_summary(df: DataFrame, conf="confidence", true="true_label", pred="pred_label",
                  low: float = 0.5, high: float = 0.8) -> DataFrame:
    w = with_correct(df, true, pred)
    err = ~F.col("correct")
    n_err = F.sum(F.when(err, 1).otherwise(0))
    return w.agg(F.count("*").alias("n"), n_err.cast("long").alias("errors"),
                 F.round(F.try_divide(100.0 * n_err, F.count("*")), 6).alias("error_pct"),
                 F.sum(F.when(err & (F.col(conf) < low), 1).otherwise(0)).cast("long").alias("low_conf_errors"),
                 F.sum(F.when(err & (F.col(conf) >= high), 1).otherwise(0)).cast("long").alias("high_conf_errors"))


# ----------------------------------------------------- exact median ----
def exact_median(df: DataFrame, col: str, by: list[str] | None = None, bins: int = 65536) -> DataFrame:
    """Exact median (mean of the two middle values, as NumPy) per group;
    nulls and NaN are left out.

    No group is ever buffered in one task: each pass counts values into
    ``bins`` bins inside the current [lo, hi] window of every target rank (a
    partial-aggregated groupBy), then keeps only the bin that holds the rank,
    bounded by its observed min/max.  A bin holding a single distinct value
    ends the search for that rank.  Bins are even in the logarithm while the
    window spans more than a factor of two, then even in the value, so some
    six passes settle any doubles; the search has no cap on passes.  Only the
    per-group search state (groups x 2 rows) is read back between passes.
    """
    from utterscope.session import reliable_checkpoint, sized_broadcast
    grouped = bool(by)
    by = list(by) if by else ["_g"]
    src = df if grouped else df.withColumn("_g", F.lit(0))
    largest = 1.7976931348623157e308
    x = F.col(col).cast("double")
    base = src.select(*by, F.least(F.greatest(x, F.lit(-largest)), F.lit(largest)).alias("_x")).where(
        x.isNotNull() & ~F.isnan(x))
    stats = base.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("lo"),
                                  F.max("_x").alias("hi"))
    # target ranks (0-based): floor((n-1)/2) and floor(n/2)
    state = stats.select(*by, F.explode(F.array(
        F.struct(F.lit(0).alias("t"), ((F.col("_n") - 1) / 2).cast("long").alias("r")),
        F.struct(F.lit(1).alias("t"), (F.col("_n") / 2).cast("long").alias("r")))).alias("_s"),
        "lo", "hi").select(*by, "_s.t", "_s.r", "lo", "hi")
    state = reliable_checkpoint(state.withColumn("done", F.col("lo") == F.col("hi")))

    def log_place(v):
        """A place on the real line that rises with ``v``: signed logarithm."""
        v = F.col(v)
        return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1080.0))

    lo, hi = F.col("lo"), F.col("hi")
    near = ((lo > 0) & (hi / 2 <= lo)) | ((hi < 0) & (lo / 2 >= hi))
    share = F.when(near, F.try_divide(F.col("_x") - lo, hi - lo)).otherwise(
        F.try_divide(log_place("_x") - log_place("lo"), log_place("hi") - log_place("lo")))
    b = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("long")
    while not state.where(~F.col("done")).isEmpty():
        open_ = state.where(~F.col("done"))
        # the open search state is (groups x 2) rows; broadcast when bounded
        rows = base.join(sized_broadcast(open_, 200000), by, "inner")
        counted = (rows.where((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi")))
                   .groupBy(*by, "t", b.alias("bin"))
                   .agg(F.count("*").alias("c"), F.min("_x").alias("bmin"), F.max("_x").alias("bmax")))
        win = Window.partitionBy(*by, "t").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        cum = counted.withColumn("before", F.coalesce(F.sum("c").over(win), F.lit(0)))
        pick = (cum.join(open_.select(*by, "t", "r"), by + ["t"])
                .where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("c")))
                .select(*by, "t", (F.col("r") - F.col("before")).alias("r"),
                        F.col("bmin").alias("lo"), F.col("bmax").alias("hi"),
                        (F.col("bmin") == F.col("bmax")).alias("done")))
        state = reliable_checkpoint(state.where(F.col("done")).unionByName(pick))
    out = state.groupBy(*by).agg((F.min("lo") / 2 + F.max("lo") / 2).alias("median"))
    return out if grouped else out.drop("_g")
