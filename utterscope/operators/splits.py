"""Exact stratified splits, folds, shuffles and label encoding.

Pseudo-random order = ``md5('{seed}:{id}')`` (deterministic, identical in
any engine).  Per-label ranks come from ``prep.group_rank`` (distributed
sort + partition offsets), so a label holding most rows never lands in a
single task.  Quotas are computed on the label-count table (one row per
label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterscope.operators.prep import group_rank, null_safe_join


def seeded_hash(seed, key) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(s.cast("string"), F.lit(":"), k.cast("string")))


def test_quotas(counts: DataFrame, label: str, frac: float, by: list | None = None) -> DataFrame:
    """Per-label test seats: n_test = ceil(frac * n); floor(n_c n_test / n)
    each, remaining seats to the largest remainders (label ascending on
    ties).  Exact integer arithmetic on the small count table."""
    by = list(by or [])
    g = Window.partitionBy(*by)
    c = (counts.withColumn("_n", F.sum("n").over(g))
               .withColumn("_nt", F.ceil(F.col("_n") * F.lit(frac)).cast("long")))
    prod = F.col("n") * F.col("_nt")
    c = c.withColumn("_base", F.floor(prod / F.col("_n")).cast("long")) \
         .withColumn("_rem", prod - F.col("_base") * F.col("_n"))
    c = c.withColumn("_left", F.col("_nt") - F.sum("_base").over(g))
    order = Window.partitionBy(*by).orderBy(F.desc("_rem"), F.col(label))
    c = c.withColumn("_k", F.row_number().over(order))
    return c.select(*by, label, "n", (F.col("_base") + F.when(F.col("_k") <= F.col("_left"), 1)
                                      .otherwise(0)).cast("long").alias("quota"))


def stratified_split(df: DataFrame, label: str, key: str, frac: float, seed: int = 42,
                     by: list | None = None) -> DataFrame:
    """Adds ``is_test``; exactly ``quota`` rows per label are test rows,
    taken in seeded-hash order; rows without a label are a stratum too."""
    from utterscope.session import sized_broadcast
    by = list(by or [])
    seed_col = F.col("seed") if "seed" in by else F.lit(str(seed))
    h = df.withColumn("_h", seeded_hash(seed_col, key))
    counts = h.groupBy(*by, label).agg(F.count("*").alias("n"))
    quotas = test_quotas(counts, label, frac, by)
    ranked = group_rank(h, by + [label], ["_h", key], "_r")
    out = null_safe_join(ranked, sized_broadcast(quotas.select(*by, label, "quota"), 1 << 20), by + [label])
    return out.withColumn("is_test", F.col("_r") <= F.col("quota")).drop("_h", "_r", "quota")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold id (0..k-1) per row, balanced within every label."""
    h = df.withColumn("_h", seeded_hash(seed, key))
    ranked = group_rank(h, [label], ["_h", key], "_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """D3: a seeded permutation (distributed sort on the seeded hash)."""
    return df.orderBy(seeded_hash(seed, key), key)


def multi_seed_splits(df: DataFrame, label: str, key: str, frac: float, seeds: list[int]) -> DataFrame:
    """One stratified split per seed in one pass (rows x seeds via a
    generator, ranked per (seed, label))."""
    x = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    return stratified_split(x, label, key, frac, by=["seed"])


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels -> 0..n-1 (byte order = code point order)."""
    from utterscope.operators.prep import dense_index
    d = df.select(F.col(label).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    return dense_index(d, ["label"], "_p").select("label", (F.col("_p") - 1).cast("int").alias("label_id"))


def map_labels(df: DataFrame, label: str, index: DataFrame, default: int | None = -1,
               out: str = "label_id") -> DataFrame:
    """Label -> id through a size-checked broadcast join; unknown
    labels -> ``default``."""
    from utterscope.session import sized_broadcast
    idx = index.select(F.col("label").alias("_lab"), F.col("label_id").alias(out))
    j = df.join(sized_broadcast(idx, 1 << 20), F.col(label).cast("string") == F.col("_lab"), "left").drop("_lab")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(default)).cast("int")) if default is not None else j
