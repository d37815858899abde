"""Cluster geometry: centroids, coherence, silhouette, Davies-Bouldin,
membership, assignment and topic maps (E20–E24, H10–H12).

Per-row work is a join of rows with the per-topic table (one row per topic,
size-checked broadcast); per-topic work is a groupBy.  The exact silhouette
is computed blockwise: rows are dealt to blocks, each of which meets all rows
in tiles (``blocks``), and only (row, cluster) distance sums leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.functions import vectors as vx
from utterscope.operators.blocks import ASK_ROWS, blocks_against, blocks_against_all, equal_keys, key_numbers, matrix, n_blocks, runs
from utterscope.operators.scoring import group_centroids
from utterscope.session import sized_broadcast

MAX_TOPICS = 100000


def topic_centroids(df: DataFrame, topic: str, vec: str) -> DataFrame:
    """Mean vector per topic, noise (-1) excluded."""
    return group_centroids(df.where(F.col(topic) != -1), topic, vec)


def with_centroid(df: DataFrame, topic: str, vec: str, cents: DataFrame | None = None) -> DataFrame:
    cents = cents if cents is not None else topic_centroids(df, topic, vec)
    c = cents.select(topic, "centroid")
    return df.where(F.col(topic) != -1).join(sized_broadcast(c, MAX_TOPICS), topic)


def topic_coherence(df: DataFrame, topic: str, vec: str, metric: str = "euclidean",
                    cents: DataFrame | None = None) -> DataFrame:
    """Mean and population std of the similarity of members to their
    centroid — cosine (eps 1e-8) or 1 / (1 + euclidean)."""
    j = with_centroid(df, topic, vec, cents)
    v = vx.as_double(vec)
    if metric == "cosine":
        sim = vx.dot(v, "centroid") / (vx.norm(v) * vx.norm("centroid") + F.lit(1e-8))
    elif metric == "euclidean":
        sim = F.lit(1.0) / (F.lit(1.0) + vx.euclidean(v, "centroid"))
    else:
        raise ValueError(f"Unknown metric: {metric}")
    return (j.withColumn("_sim", sim).groupBy(topic)
             .agg(F.avg("_sim").alias("coherence_score"), F.count("*").alias("size"),
                  F.stddev_pop("_sim").alias("std_coherence")))


def davies_bouldin(df: DataFrame, topic: str, vec: str, cents: DataFrame | None = None) -> DataFrame:
    """Mean over i of max_{j != i} (S_i + S_j) / d(c_i, c_j); pairs of
    centroids come from exploding the packed centroid table (K x K, tiny)."""
    cents = cents if cents is not None else topic_centroids(df, topic, vec)
    j = with_centroid(df, topic, vec, cents)
    s = (j.withColumn("_d", vx.euclidean(vx.as_double(vec), "centroid"))
          .groupBy(topic).agg(F.avg("_d").alias("s")))
    t = cents.join(s, topic).select(F.col(topic).alias("i"), "centroid", "s")
    packed = t.select(F.collect_list(F.struct("i", "centroid", "s")).alias("_all"))
    pairs = (t.withColumn("_all", packed.scalar())
              .select("i", "centroid", "s", F.explode("_all").alias("o"))
              .where(F.col("o")["i"] != F.col("i")))
    # coinciding centroids count 0, as if infinitely far apart
    r = pairs.select("i", F.coalesce(F.try_divide(F.col("s") + F.col("o")["s"], vx.euclidean("centroid", F.col("o")["centroid"])),
                                     F.lit(0.0)).alias("_r"))
    return r.groupBy("i").agg(F.max("_r").alias("_m")).agg(F.avg("_m").alias("davies_bouldin"))


def _sample(df: DataFrame, key: str, max_rows: int, seed: int) -> DataFrame:
    """Deterministic sample of at most ``max_rows`` rows (smallest seeded
    hash) — the silhouette's documented sample cap."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(max_rows).drop("_h")


def centroid_silhouette(df: DataFrame, topic: str, vec: str, cents: DataFrame | None = None) -> DataFrame:
    """The silhouette with distances to centroids in place of mean distances
    to members: linear in the rows.  Noise excluded; 0 when fewer than 2
    clusters.  One row: ``centroid_silhouette``, ``n``."""
    cents = cents if cents is not None else topic_centroids(df, topic, vec)
    # one row per topic, size-checked by with_centroid below
    packed = cents.agg(F.collect_list(F.struct(F.col(topic).alias("t"), "centroid")).alias("_all"))
    j = with_centroid(df, topic, vec, cents).withColumn("_all", packed.scalar())
    own = F.struct(vx.as_double(vec).alias("v"), F.col(topic).alias("t"))
    others = vx.with_const("_all", own, lambda c, r: F.when(c["t"] != r["t"], vx.euclidean(r["v"], c["centroid"])))
    d = j.select(vx.euclidean(vx.as_double(vec), "centroid").alias("a"), F.array_min(others).alias("b"))
    s = F.when(F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return d.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("centroid_silhouette"), F.count("*").alias("n"))


def clustering_metrics(df: DataFrame, key: str, topic: str, vec: str, silhouette_rows: int | None = None) -> DataFrame:
    """One row — silhouette, Davies-Bouldin, mean coherence, number of
    clusters, coverage — over one kept table and one set of centroids."""
    from utterscope.session import reliable_checkpoint
    rows = reliable_checkpoint(df.select(key, topic, vx.as_double(vec).alias("_vec")))
    cents = reliable_checkpoint(topic_centroids(rows, topic, "_vec"))
    noise = F.col(topic) == -1
    base = rows.agg(F.countDistinct(F.when(~noise, F.col(topic))).alias("num_clusters"),
                    F.avg(F.when(noise, 0.0).otherwise(1.0)).alias("coverage"))
    return base.select(
        silhouette(rows, key, topic, "_vec", silhouette_rows).select("silhouette").scalar().alias("silhouette_score"),
        davies_bouldin(rows, topic, "_vec", cents).select("davies_bouldin").scalar().alias("davies_bouldin_score"),
        topic_coherence(rows, topic, "_vec", "euclidean", cents).agg(F.avg("coherence_score")).scalar().alias("avg_coherence_score"),
        "num_clusters", "coverage")


def _distance_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each asking row the sum of its distances to the rows of each topic
    and their number, rows of its own key left out, for blocks of
    ``blocks_against_all``; the rows that are met arrive by topic."""
    for asking, met in runs(batches):
        asking = asking.take(pa.array(np.argsort(key_numbers(asking["_id"]), kind="stable"))).combine_chunks()
        ids, v = key_numbers(asking["_id"]), matrix(asking["_v"])
        squares = (v * v).sum(1)
        now, total, count = None, np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)

        def told():
            return pa.RecordBatch.from_arrays([asking["_id"].combine_chunks(), asking["_t"].combine_chunks(), pa.array(
                np.full(len(ids), now, dtype=np.int64)), pa.array(total), pa.array(count)], names=["id", "t", "other", "dsum", "cnt"])

        for tile in met:
            topics = tile["_t"].to_numpy()
            edges = np.r_[0, np.flatnonzero(topics[1:] != topics[:-1]) + 1, len(topics)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if now is not None and topics[lo] != now:
                    yield told()
                    total, count = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
                now = topics[lo]
                part = tile.slice(lo, hi - lo)
                w = matrix(part["_v"])
                i, j = equal_keys(ids, key_numbers(part["_id"]))
                count += hi - lo - np.bincount(i, minlength=len(ids))
                _add_distances(total, v, squares, w, i, j)
        if now is not None:
            yield told()


def _add_distances(total: np.ndarray, v: np.ndarray, squares: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Adds to ``total`` the distances of the rows of ``v`` to those of ``w``;
    the pairs (i, j) count nothing."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    others = (w * w).sum(1)
    for at in range(0, len(v), ASK_ROWS):
        rows = slice(at, at + ASK_ROWS)
        d = v[rows] @ w.T
        d *= -2.0
        d += squares[rows, None]
        d += others
        np.maximum(d, 0.0, out=d)
        np.sqrt(d, out=d)
        own = slice(*np.searchsorted(i, [at, at + ASK_ROWS]))
        d[i[own] - at, j[own]] = 0.0
        total[rows] += d.sum(1)


def silhouette(df: DataFrame, key: str, topic: str, vec: str, max_rows: int | None = None,
               block_rows: int = 1024, seed: int = 42) -> DataFrame:
    """Exact Euclidean silhouette on raw vectors, noise excluded; 0 when
    fewer than 2 clusters.  One row.

    Compares all rows with all rows in blocks.  ``max_rows`` makes it the
    sampling operator instead (rows of smallest seeded hash); for large
    tables ``centroid_silhouette`` reads every row once.
    """
    from utterscope.session import reliable_checkpoint
    pts = df.where((F.col(topic) != -1) & F.col(vec).isNotNull()).select(key, topic, vx.as_double(vec).alias("_v"))
    pts = reliable_checkpoint(pts if max_rows is None else _sample(pts, key, max_rows, seed))
    points = pts.select(F.col(key).cast("long").alias("_id"), F.col(topic).cast("long").alias("_t"), "_v")
    sums = blocks_against_all(points, "_id", ["_t"], n_blocks(points, "_v", block_rows), _distance_sums,
                              "id long, t long, other long, dsum double, cnt long").select(
        F.col("id").alias(key), F.col("t").alias(topic), "other", "dsum", "cnt")
    per = sums.groupBy(key, topic, "other").agg(F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt"))
    per = per.withColumn("mean_d", F.when(F.col("cnt") > 0, F.col("dsum") / F.col("cnt")))
    a = per.where(F.col("other") == F.col(topic)).select(key, F.col("mean_d").alias("a"), F.col("cnt").alias("na"))
    b = per.where(F.col("other") != F.col(topic)).groupBy(key).agg(F.min("mean_d").alias("b"))
    s = a.join(b, key, "left").withColumn(
        "s", F.when((F.col("na") == 0) | F.col("b").isNull(), F.lit(0.0))
              .otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))))
    k = pts.select(topic).distinct().count()
    if k < 2:
        return df.sparkSession.createDataFrame([(0.0,)], "silhouette double")
    return s.agg(F.avg("s").alias("silhouette"))


def membership(df: DataFrame, key: str, topic: str, vec: str, temperature: float = 1.0) -> DataFrame:
    """Probability of each topic per row = softmax(-distance to the
    topic centroids) (declared replacement of the density model's
    membership vectors).  Adds ``topic_ids`` and ``probs``."""
    from utterscope.operators.scoring import centroid_logits, class_table, softmax_temperature
    cents = topic_centroids(df, topic, vec)
    classes = class_table(cents, topic, F.col(topic).cast("string"))
    s = centroid_logits(df, classes, vec, key, metric="neg_euclidean", scale=1.0)
    s = softmax_temperature(s, "logits", temperature)
    return s.withColumn("topic_ids", F.transform("class_names", lambda x: x.cast("int")))


def _distances(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``v`` to those of ``w``, from one
    product of matrices; the few that it gives too few digits of, or no number
    for, are summed one by one."""
    with np.errstate(all="ignore"):
        size = (v * v).sum(1)[:, None] + (w * w).sum(1)
        squares = size - 2.0 * (v @ w.T)
        i, j = np.nonzero(~(squares > NEAR_SHARE * size) | ~np.isfinite(squares))
        for at in range(0, len(i), ASK_ROWS):
            part = slice(at, at + ASK_ROWS)
            d = v[i[part]] - w[j[part]]
            squares[i[part], j[part]] = (d * d).sum(1)
        return np.sqrt(squares)


NEAR_SHARE = 1e-4  # of both squared lengths: a square below it has lost four digits or more


def _own_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each asking row the softmax of minus the distances to all centroids,
    at its own topic's, for blocks of ``blocks_against``."""
    for asking, met in runs(batches):
        lengths = pa.compute.list_value_length(asking["_v"]).fill_null(-1).to_numpy()
        values = asking["_v"].combine_chunks()
        holes = np.r_[0, np.cumsum(values.flatten().is_null().to_numpy(zero_copy_only=False))]
        ends = np.cumsum(np.maximum(lengths, 0))
        whole = (lengths >= 0) & (holes[ends] == holes[ends - np.maximum(lengths, 0)])
        topic = asking["_t"].to_numpy(zero_copy_only=False)
        known = asking["_t"].is_valid().to_numpy(zero_copy_only=False)
        most, total = np.full(len(lengths), -np.inf), np.zeros(len(lengths))
        own = np.full(len(lengths), np.nan)
        found = np.zeros(len(lengths), dtype=bool)
        dims: set[int] = set()
        parts = {}
        for tile in met:
            dims |= set(pa.compute.list_value_length(tile["_v"]).to_pylist())
            if tile["_v"].combine_chunks().flatten().null_count:
                dims.add(-1)
            if len(dims) > 1 or -1 in dims:  # no row has a distance to all
                continue
            dim = next(iter(dims))
            if dim not in parts:
                at = np.flatnonzero(whole & (lengths == dim))
                parts[dim] = at, matrix(pa.chunked_array([values.take(pa.array(at))])) if len(at) else np.zeros((0, dim))
            at, v = parts[dim]
            c, names = matrix(tile["_v"]), tile["_t"].to_numpy()
            for lo in range(0, len(at), ASK_ROWS):
                rows = at[lo:lo + ASK_ROWS]
                logits = -_distances(v[lo:lo + ASK_ROWS], c)
                with np.errstate(all="ignore"):
                    new = np.maximum(most[rows], logits.max(1))
                    before = np.where(total[rows] == 0, 0.0, total[rows] * np.exp(most[rows] - new))
                    total[rows] = before + np.exp(logits - new[:, None]).sum(1)
                most[rows] = new
                i, j = np.nonzero((topic[rows][:, None] == names[None, :]) & known[rows][:, None])
                own[rows[i]], found[rows[i]] = logits[i, j], True
        with np.errstate(all="ignore"):
            share = np.exp(own - most) / total
        told = found & (len(dims) == 1)
        for dim in dims:
            told &= whole & (lengths == dim)
        yield pa.RecordBatch.from_arrays([asking["_k"].combine_chunks(), asking["_t"].combine_chunks(), pa.array(share, mask=~told, from_pandas=False)],
                                         names=["key", "topic", "p"])


def own_probability(df: DataFrame, key: str, topic: str, vec: str, out: str = "p") -> DataFrame:
    """(key, ``out``): the probability that H10 gives each row's own topic;
    0 for noise.

    The rows, dealt to blocks, meet the centroids in tiles; of the distances
    only their running softmax is kept, whatever the number of topics.
    """
    from utterscope.session import reliable_checkpoint
    cents = reliable_checkpoint(topic_centroids(df, topic, vec).select(F.col(topic).alias("_t"), F.col("centroid").alias("_v")))
    known = F.coalesce(F.col(topic) != -1, F.lit(True))
    rows = df.select(F.col(key).alias("_k"), F.col(topic).alias("_t"), vx.as_double(vec).alias("_v"))
    asking = rows.where(F.coalesce(F.col("_t") != -1, F.lit(True)))
    kinds = dict(rows.dtypes)
    shares = blocks_against(asking, cents.select(F.lit(None).cast(kinds["_k"]).alias("_k"), "_t", "_v"), "_k", ["_t"],
                            n_blocks(asking, "_v", OWN_ROWS), _own_shares, f"key {kinds['_k']}, topic {kinds['_t']}, p double")
    return shares.select(F.col("key").alias(key), F.col("p").alias(out)).union(
        df.where(~known).select(F.col(key), F.lit(0.0).alias(out)))


OWN_ROWS = 1024  # rows of a block that meets the centroids


def topic_radii(fit: DataFrame, topic: str, vec: str) -> DataFrame:
    """(t, centroid, radius): topics with the largest distance of a member."""
    cents = topic_centroids(fit, topic, vec)
    j = with_centroid(fit, topic, vec, cents)
    radius = j.groupBy(topic).agg(F.max(vx.euclidean(vx.as_double(vec), "centroid")).alias("radius"))
    return cents.join(radius, topic).select(F.col(topic).alias("t"), "centroid", "radius")


def nearest_topic(new: DataFrame, topics: Column, vec: str) -> DataFrame:
    """``new`` with ``assigned_topic`` and ``distance`` by an array of topics
    (t, centroid, radius); row-wise."""
    out = new.withColumn("_cs", topics)
    out = out.withColumn("_d", vx.with_const("_cs", vx.as_double(vec), lambda c, x: vx.euclidean(x, c["centroid"])))
    out = out.withColumn("_i", vx.argmax(F.transform("_d", lambda d: -d)) + 1)
    near = F.element_at("_cs", F.col("_i"))
    dist = F.element_at("_d", F.col("_i"))
    return (out.withColumn("assigned_topic", F.when(dist <= near["radius"], near["t"]).otherwise(F.lit(-1)))
               .withColumn("distance", dist).drop("_cs", "_d", "_i"))


def assign_topics(fit: DataFrame, new: DataFrame, key: str, topic: str, vec: str) -> DataFrame:
    """Nearest centroid, or -1 when farther than that topic's radius
    (largest member distance seen at fit time).  Row-wise with the topics in
    one array, so it also runs on a streaming DataFrame."""
    packed = topic_radii(fit, topic, vec).agg(F.sort_array(F.collect_list(F.struct("t", "centroid", "radius"))).alias("_cs"))
    return nearest_topic(new, packed.scalar(), vec)


def topic_distances(df: DataFrame, topic: str, vec: str) -> DataFrame:
    """Pairwise distances between topic centroids (K x K by explode)."""
    cents = topic_centroids(df, topic, vec).select(F.col(topic).alias("i"), "centroid")
    packed = cents.select(F.collect_list(F.struct("i", "centroid")).alias("_all"))
    pairs = cents.withColumn("_all", packed.scalar()).select("i", "centroid", F.explode("_all").alias("o"))
    return pairs.select(F.col("i").alias("topic_a"), F.col("o")["i"].alias("topic_b"),
                        vx.euclidean("centroid", F.col("o")["centroid"]).alias("distance"))


def row_coordinates(df: DataFrame, key: str, vec: str, k: int = 2) -> DataFrame:
    """2-D row coordinates (PCA) for the document map."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    x = df.select(key, array_to_vector(vx.as_double(vec)).alias("_f"))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(x)
    return model.transform(x).select(key, vector_to_array("_p").alias("coords"))
