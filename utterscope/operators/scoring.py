"""Scoring and decision operators.

Logits are ``ARRAY<DOUBLE>`` indexed by class position; class positions
follow ascending class id.  The class table (centroids) is tiny — one row
per class — and enters the row-wise projection as a scalar subquery after
its size has been checked; beyond the bound the classes are scored in
blocks and the blocks are merged by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.functions import lexicon as lx
from utterscope.functions import text as tx
from utterscope.functions import vectors as vx
from utterscope.session import reliable_checkpoint


# ---------------------------------------------------------------- E20 ----
def group_centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per ``key`` (plain mean, not unit length).

    Long form (key, pos, x) with map-side partial aggregation: the shuffle
    carries keys x dims x partitions rows, never the input rows.
    """
    long = df.select(F.col(key), F.posexplode(vx.as_double(vec)).alias("pos", "x"))
    means = long.groupBy(key, "pos").agg(F.avg("x").alias("m"), F.count("x").alias("n"))
    return (means.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_s"),
                 F.max("n").alias("size"))
            .select(key, F.transform("_s", lambda e: e.m).alias("centroid"), "size"))


def class_table(centroids: DataFrame, key: str, name: Column | None = None) -> DataFrame:
    """(cls, name, centroid, cnorm) — the class dimension of a centroid scorer."""
    name = name if name is not None else F.col(key).cast("string")
    return centroids.select(F.col(key).alias("cls"), name.alias("name"),
                            F.col("centroid"), vx.norm("centroid").alias("cnorm"))


def _packed(classes: DataFrame) -> DataFrame:
    return classes.select(
        F.sort_array(F.collect_list(F.struct("cls", "name", "centroid", "cnorm"))).alias("cl"))


def _logit_expr(v: Column, cl: Column, metric: str, scale: float) -> Column:
    """One logit per class; the row vector (and its norm) enters each class
    lambda through ``with_const`` so it is computed once per row."""
    s = F.lit(float(scale))
    if metric == "cosine":
        row = F.struct(v.alias("v"), vx.norm(v).alias("n"))
        return vx.with_const(cl, row, lambda c, r: F.coalesce(F.try_divide(
            s * vx.dot(r["v"], c["centroid"]), r["n"] * c["cnorm"]), F.lit(0.0)))  # 0 for a zero vector
    if metric == "neg_euclidean":
        return vx.with_const(cl, v, lambda c, r: -s * vx.euclidean(r, c["centroid"]))
    raise ValueError(f"unknown metric {metric}")


def centroid_logits(df: DataFrame, classes: DataFrame, vec: str, key: str,
                    metric: str = "cosine", scale: float = 20.0,
                    max_inline_classes: int = 20000) -> DataFrame:
    """C14: logits = scale * similarity(vec, centroid_c) for every class.

    Adds ``logits`` and ``class_names`` (names in class order).  ``key`` must
    identify rows (used only by the blocked path).
    """
    classes = reliable_checkpoint(classes)
    n_classes = classes.limit(max_inline_classes + 1).count()
    v = vx.as_double(vec)
    if n_classes <= max_inline_classes:
        # the class table enters as a scalar subquery (computed once); it is
        # bound to a column because subqueries may not sit inside lambdas
        out = df.withColumn("_cl", _packed(classes).scalar())
        cl = F.col("_cl")
        return out.withColumn("logits", _logit_expr(v, cl, metric, scale)) \
                  .withColumn("class_names", F.transform(cl, lambda c: c["name"])).drop("_cl")
    # Blocked path: classes are hashed into blocks of bounded expected size,
    # each block is inlined as its own scalar, and the block logits are
    # merged per row key in the order of class ids, as on the inline path.
    n_blocks = -(-n_classes // max_inline_classes) * 2
    blocked = classes.withColumn("blk", F.pmod(F.xxhash64("cls"), F.lit(n_blocks)))
    parts = None
    for b in range(n_blocks):
        sub = _packed(blocked.where(F.col("blk") == b)).scalar()
        cl = F.col("_cl")
        part = df.select(F.col(key), v.alias("_v"), sub.alias("_cl")).select(
            F.col(key), F.arrays_zip(F.transform(cl, lambda c: c["cls"]).alias("cls"),
                                     _logit_expr(F.col("_v"), cl, metric, scale).alias("lg"),
                                     F.transform(cl, lambda c: c["name"]).alias("nm")).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    merged = (parts.groupBy(key)
              .agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("_s"))
              .select(F.col(key),
                      F.transform("_s", lambda e: e.lg).alias("logits"),
                      F.transform("_s", lambda e: e.nm).alias("class_names")))
    return df.join(merged, key)


# ---------------------------------------------------------- C1 / C2 ----
def softmax_temperature(df: DataFrame, logits: str = "logits", temperature: float = 1.0,
                        out: str = "probs") -> DataFrame:
    """C1, staged: every intermediate array is referenced several times by
    the next step, so the optimizer keeps it computed once per row."""
    t = F.lit(float(temperature))
    z = df.withColumn("_z", vx.with_const(logits, t, lambda x, tt: x / tt))
    e = z.withColumn("_e", vx.with_const("_z", F.array_max("_z"), lambda x, m: F.exp(x - m)))
    return e.withColumn(out, vx.with_const("_e", vx.array_sum("_e"), lambda x, s: x / s)).drop("_z", "_e")


def argmax_confidence(df: DataFrame, probs: str = "probs") -> DataFrame:
    return (df.withColumn("pred_idx", vx.argmax(probs))
              .withColumn("confidence", F.array_max(probs)))


# ---------------------------------------------------------- C3 / C4 ----
def decide_status(label: Column, conf: Column, threshold: float,
                  nomatch: str = lx.LABEL_NOMATCH) -> Column:
    """(tool_label, status) struct.  NOMATCH wins whatever the confidence;
    else confidence strictly below the threshold -> UNLISTED; else VALID."""
    return (F.when(label == nomatch, F.struct(F.lit(lx.LABEL_NOMATCH).alias("tool_label"),
                                              F.lit(lx.STATUS_NO_MATCH).alias("status")))
            .when(conf < F.lit(float(threshold)),
                  F.struct(F.lit(lx.LABEL_UNLISTED).alias("tool_label"),
                           F.lit(lx.STATUS_UNLISTED).alias("status")))
            .otherwise(F.struct(label.alias("tool_label"), F.lit(lx.STATUS_VALID).alias("status"))))


def decide_nomatch(label: Column, conf: Column, threshold: float,
                   nomatch: str = lx.LABEL_NOMATCH) -> Column:
    """Notebook rule: confidence below the threshold -> NOMATCH, else label."""
    return F.when(conf < F.lit(float(threshold)), F.lit(nomatch)).otherwise(label)


def classify(df: DataFrame, temperature: float, threshold: float,
             nomatch: str = lx.LABEL_NOMATCH) -> DataFrame:
    """C1 -> C2 -> C3 over ``logits`` / ``class_names``.

    The decision needs no probability array: argmax(p) = argmax(logits) and
    max(p) = 1 / sum_j exp(z_j - z_max), which keeps the decision columns
    small expressions even when a later filter is pushed below them.
    ``probs`` is built separately and pruned when unused.
    """
    t = F.lit(float(temperature))
    acc = F.struct((F.array_max("logits") / t).alias("m"), F.lit(0.0).alias("s"))
    conf = F.aggregate("logits", acc,
                       lambda a, x: F.struct(a["m"].alias("m"), (a["s"] + F.exp(x / t - a["m"])).alias("s")),
                       lambda a: F.lit(1.0) / a["s"])
    out = (df.withColumn("pred_idx", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))
             .withColumn("confidence", conf))
    out = softmax_temperature(out, "logits", temperature)
    out = out.withColumn("pred_label", vx.at("class_names", F.col("pred_idx")))
    d = decide_status(F.col("pred_label"), F.col("confidence"), threshold, nomatch)
    return out.withColumn("_d", d).select("*", "_d.tool_label", "_d.status").drop("_d")


# ---------------------------------------------------------------- C5 ----
def summary_status(status, bot_topic, tool_label) -> Column:
    s, t = tx._c(status), tx._c(tool_label)
    bot = tx.unicode_strip(F.coalesce(tx._c(bot_topic), F.lit("")))
    return (F.when(s != lx.STATUS_VALID, s)
            .when(bot == "", F.lit(lx.SUMMARY_MATCH))
            .when(bot == t, F.lit(lx.SUMMARY_MATCH_BOT))
            .otherwise(F.lit(lx.SUMMARY_MISMATCH)))


# ---------------------------------------------------------- C6 / C7 ----
def scale_confidence(conf) -> Column:
    """Confidence on a 0..10 scale, 2 decimals, half-even."""
    return F.bround(tx._c(conf) * 10.0, 2)


def certainty_tier(conf) -> Column:
    c = tx._c(conf)
    return (F.when(c > 0.8, F.lit("High")).when(c > 0.6, F.lit("Medium"))
            .otherwise(F.lit("Low (Check Manually)")))


# ---------------------------------------------------------------- C8 ----
def top_k_labels(probs, class_names, k: int = 3) -> Column:
    """Array of (label, prob) structs, prob descending, lower id on ties."""
    names = tx._c(class_names)
    return F.transform(vx.top_k(probs, k),
                       lambda e: F.struct(F.element_at(names, e.cls + 1).alias("label"),
                                          e.p.alias("prob")))


# ---------------------------------------------------------------- C9 ----
def ensemble_logits(df: DataFrame, logit_cols: list[str], out: str = "logits") -> DataFrame:
    """Element-wise mean of several models' logits (then C1/C2 as usual)."""
    return df.withColumn(out, vx.elementwise_mean(logit_cols))


# ------------------------------------------------------- C10 / C11 ----
def smoothed_targets(label_idx, n_classes, eps: float) -> Column:
    """q_k = (1 - eps) [k = y] + eps / C  as an array of length C."""
    y = tx._c(label_idx)
    c = tx._c(n_classes) if not isinstance(n_classes, int) else F.lit(n_classes)
    base = F.array_repeat(F.lit(0.0), c.cast("int"))
    return F.transform(base, lambda _, k: F.when(k == y, 1.0 - eps).otherwise(0.0) + F.lit(eps) / c)


def weighted_ce_terms(logits: str, label_idx: str, weights: str, eps: float) -> tuple[Column, Column]:
    """Per-row numerator  sum_k w_k q_k (-log p_k)  and denominator  w_y."""
    logp = vx.log_softmax(logits)
    q = smoothed_targets(label_idx, F.size(logits), eps)
    w = F.col(weights)
    num = vx.array_sum(F.zip_with(F.zip_with(q, logp, lambda a, b: -a * b), w, lambda a, b: a * b))
    den = F.element_at(w, F.col(label_idx) + 1)
    return num, den


def weighted_ce(df: DataFrame, logits: str, label_idx: str, weights: str,
                eps: float = 0.1) -> DataFrame:
    """Class-weighted, label-smoothed cross-entropy (weighted-mean
    reduction) as a one-row audit of a scored table."""
    num, den = weighted_ce_terms(logits, label_idx, weights, eps)
    return df.select(num.alias("num"), den.alias("den")).agg(
        (F.sum("num") / F.sum("den")).alias("weighted_ce"), F.count("*").alias("n_rows"))


def focal_terms(logits: str, label_idx: str, alpha: str | None, gamma: float, eps: float) -> Column:
    logp = vx.log_softmax(logits)
    q = smoothed_targets(label_idx, F.size(logits), eps)
    ce = vx.array_sum(F.zip_with(q, logp, lambda a, b: -a * b))
    p_y = F.exp(F.element_at(logp, F.col(label_idx) + 1))
    term = F.pow(1.0 - p_y, F.lit(float(gamma))) * ce
    if alpha is not None:
        term = term * F.element_at(F.col(alpha), F.col(label_idx) + 1)
    return term


def focal_loss(df: DataFrame, logits: str, label_idx: str, alpha: str | None = None,
               gamma: float = 2.0, eps: float = 0.0, reduction: str = "mean") -> DataFrame:
    """C11: alpha_y (1 - p_y)^gamma CE_eps; mean / sum / none."""
    term = focal_terms(logits, label_idx, alpha, gamma, eps)
    if reduction == "none":
        return df.withColumn("focal_loss", term)
    agg = F.avg if reduction == "mean" else F.sum
    return df.select(term.alias("t")).agg(agg("t").alias("focal_loss"), F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- C12 ----
def kl_divergence(p_log: Column, q_log: Column) -> Column:
    """KL(P || Q) from log-probabilities."""
    return vx.array_sum(F.zip_with(p_log, q_log, lambda a, b: F.exp(a) * (a - b)))


def symmetric_kl(df: DataFrame, logits_a: str, logits_b: str) -> DataFrame:
    """Per-row 0.5 [KL(P2||P1) + KL(P1||P2)] (``sym_kl``)."""
    la, lb = vx.log_softmax(logits_a), vx.log_softmax(logits_b)
    return df.withColumn("kl_ba", kl_divergence(lb, la)).withColumn("kl_ab", kl_divergence(la, lb)) \
             .withColumn("sym_kl", (F.col("kl_ba") + F.col("kl_ab")) / 2.0)


# ---------------------------------------------------------------- C13 ----
def score_batches(df: DataFrame, input_col: str, make_predict_fn, n_classes: int,
                  batch_size: int = 32, out: str = "logits",
                  input_shape: list | None = None) -> DataFrame:
    """Fixed-size batch scoring through a user model, loaded once per worker.

    ``make_predict_fn()`` returns ``fn(np.ndarray) -> np.ndarray[n, C]``.
    Arrow moves the batches; Spark partitions and schedules the work.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()),
                            batch_size=batch_size,
                            input_tensor_shapes=[input_shape] if input_shape else None)
    return df.withColumn(out, udf(F.col(input_col)))
