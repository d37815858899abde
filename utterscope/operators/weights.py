"""Class distribution and class weights.

Counting is one partial-aggregated ``groupBy``; everything after it runs on
the class table (one row per class), where a window over ``()`` is cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _all():
    return Window.partitionBy()


def class_counts(df: DataFrame, label: str, dim: DataFrame | None = None) -> DataFrame:
    """(label, n) — labels of ``dim`` with no rows appear with n = 0."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    if dim is None:
        return counts
    return dim.select(label).distinct().join(counts, label, "left") \
              .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def class_distribution(df: DataFrame, label: str, top: int | None = 10) -> DataFrame:
    """Count and percentage per label, descending (label breaks ties)."""
    c = class_counts(df, label)
    out = c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(_all()), 6)) \
           .orderBy(F.desc("n"), label)
    return out.limit(top) if top else out


def minmax_normalise(df: DataFrame, col: str, lo: float = 0.5, hi: float = 2.0,
                     out: str | None = None, small: bool = False) -> DataFrame:
    """Min-max to [lo, hi]; a range below 1e-6 maps to the midpoint.

    On a small (class) table a window over () is used; on a large table the
    bounds are two scalar subqueries (partial aggregates, no single task)."""
    if small:
        mn, mx = F.min(col).over(_all()), F.max(col).over(_all())
    else:
        mn, mx = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    val = F.when(mx - mn < 1e-6, F.lit((lo + hi) / 2.0)).otherwise(
        F.lit(lo) + F.lit(hi - lo) * (F.col(col) - mn) / (mx - mn))
    return df.withColumn(out or col, val)


def balance_weights(counts: DataFrame, label: str) -> DataFrame:
    """n / (C * max(n_c, 1)), min-max normalised to [0.5, 2.0]  (``w_norm``)."""
    total = F.sum("n").over(_all())
    n_cls = F.count("*").over(_all())
    w = counts.withColumn("w_raw", total.cast("double") / (n_cls * F.greatest("n", F.lit(1))))
    return minmax_normalise(w, "w_raw", 0.5, 2.0, out="w_norm", small=True)


def class_weights(df: DataFrame, label: str, dim: DataFrame | None = None) -> DataFrame:
    """(label, n, weight) with weight = w_norm / mean(w_norm)."""
    b = balance_weights(class_counts(df, label, dim), label)
    return b.select(label, "n", (F.col("w_norm") / F.avg("w_norm").over(_all())).alias("weight"))


def priority_weights(df: DataFrame, label: str, dim: DataFrame, alpha: float = 0.5,
                     use_balance: bool = True, use_priority: bool = True,
                     default_priority: float = 50.0) -> DataFrame:
    """Mix of balance weights and intent priorities.

    ``dim`` has (label, priority 0..100); classes missing from it take
    ``default_priority``.  final = clip(mix / mean(mix), 0.1, 10).
    """
    counts = class_counts(df, label, dim)
    b = balance_weights(counts, label)
    pr = dim.select(label, "priority")
    t = b.join(pr, label, "left").withColumn(
        "prio", 0.5 + 1.5 * F.coalesce(F.col("priority").cast("double"), F.lit(default_priority)) / 100.0)
    if use_balance and use_priority:
        mix = F.lit(alpha) * F.col("w_norm") + F.lit(1.0 - alpha) * F.col("prio")
    elif use_balance:
        mix = F.col("w_norm")
    elif use_priority:
        mix = F.col("prio")
    else:
        mix = F.lit(1.0)
    t = t.withColumn("mix", mix)
    final = F.least(F.greatest(F.col("mix") / F.avg("mix").over(_all()), F.lit(0.1)), F.lit(10.0))
    return t.select(label, "n", "w_norm", "prio", final.alias("weight"))
