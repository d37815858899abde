"""Training-pair mining from labelled rows.

Positions inside a label come from ``prep.group_rank`` (distributed, no
per-label task); partners are found by equi-joins on (label, position), so
no pair set beyond the emitted pairs is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterscope.operators.neighbors import knn_join, nearest_other_label
from utterscope.operators.prep import group_rank, null_safe_join
from utterscope.operators.splits import seeded_hash


def _positions(df: DataFrame, label: str, key: str, order_cols: list) -> DataFrame:
    ranked = group_rank(df.select(label, key), [label], order_cols, "_pos")
    sizes = ranked.groupBy(label).agg(F.count("*").alias("_n"))
    return null_safe_join(ranked, sizes, [label])


def contrastive_pairs(df: DataFrame, label: str, key: str, offsets=(1, 2),
                      order_cols: list | None = None) -> DataFrame:
    """Per label with >= 2 rows, (i, i+1 mod n); with > 2 rows also
    (i, i+2 mod n).  Positions follow ``order_cols`` (default: the key)."""
    pos = _positions(df, label, key, order_cols or [key]).where(F.col("_n") >= 2)
    partner = pos.select(label, F.col("_pos").alias("_ppos"), F.col(key).alias("positive_id"))
    out = None
    for off in offsets:
        cand = pos.where(F.col("_n") > off) if off > 1 else pos
        cand = cand.withColumn("_ppos", ((F.col("_pos") - 1 + off) % F.col("_n")) + 1)
        p = null_safe_join(cand, partner, [label, "_ppos"]).select(
            label, F.col(key).alias("anchor_id"), "positive_id", F.lit(off).alias("offset"))
        out = p if out is None else out.unionByName(p)
    return out


def single_positive_pairs(df: DataFrame, label: str, key: str) -> DataFrame:
    """The warm-up stage's (i, i+1) pairs only."""
    return contrastive_pairs(df, label, key, offsets=(1,))


def hard_negative_triplets(df: DataFrame, label: str, key: str, vec: str, k: int = 20,
                           seed: int = 42, n_pivots: int = 64, neighbours: DataFrame | None = None) -> DataFrame:
    """Per anchor whose label has >= 2 rows: a positive of the same label
    (the anchor's successor in seeded-hash order — never itself), and the
    first different-label row among its top-k cosine neighbours; when all k
    share the label, the fallback is the smallest-hash row of another label.
    ``neighbours`` (``neighbor_graph`` with the label as extra column) takes
    the place of the exact join on tables too large for it.
    """
    from utterscope.session import sized_broadcast
    base = df.select(key, label, vec).withColumn("_h", seeded_hash(seed, key))
    pos = _positions(base, label, key, ["_h", key]).where(F.col("_n") >= 2)
    partner = pos.select(label, F.col("_pos").alias("_ppos"), F.col(key).alias("positive_id"))
    anchors = (null_safe_join(pos.withColumn("_ppos", (F.col("_pos") % F.col("_n")) + 1), partner, [label, "_ppos"])
               .select(key, label, "positive_id"))
    knn = neighbours if neighbours is not None else knn_join(
        base.select(key, label, vec), key, vec, k=k, n_pivots=n_pivots, seed=seed, extra=[label])
    hard = nearest_other_label(knn, key, label).select(
        key, F.col(f"nb_{key}").alias("hard_negative_id"), F.col("cos").alias("hard_cos"))
    # fallback: per label, the smallest-hash row among the other labels,
    # from the per-label minima (one row per label)
    mins = base.groupBy(label).agg(F.min(F.struct("_h", key)).alias("_m"))
    packed = mins.select(F.collect_list(F.struct(F.col(label).alias("l"), "_m")).alias("_all"))
    fb = (mins.withColumn("_all", packed.scalar())
              .select(label, F.explode("_all").alias("o")).where(F.col("o")["l"] != F.col(label))
              .groupBy(label).agg(F.min(F.col("o")["_m"]).alias("_f"))
              .select(label, F.col("_f")[key].alias("fallback_id")))
    out = anchors.join(hard, key, "left").join(sized_broadcast(fb, 1 << 20), label, "left")
    return out.select(F.col(key).alias("anchor_id"), label, "positive_id",
                      F.coalesce("hard_negative_id", "fallback_id").alias("negative_id"),
                      F.col("hard_negative_id").isNotNull().alias("is_hard"))
