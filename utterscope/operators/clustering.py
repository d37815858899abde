"""Embedding, reduction and clustering for intent discovery.

* H6 text vectors: hashing TF-IDF (the sentence-transformer is not built;
  a precomputed embedding column can be used instead).
* H7 reduction: L2 normalise + PCA (linear; the reference uses UMAP).
* H8 density clusters: a flat cut of the mutual-reachability graph —
  exact kNN graph (F6) -> core distance (min_samples-th neighbour) ->
  edges with max(core_i, core_j, d_ij) <= eps (default: twice the median
  core distance) -> connected components (alternating star steps until
  converged, checkpointed every round) -> components smaller
  than min_cluster_size become noise (-1); ids by size desc.  Excess-of-mass
  selection over the whole hierarchy, which the discovery job uses, is in
  ``stability``.
* H9 centroid clusters: KMeans + a distance-quantile noise cut.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer, PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.functions import text as tx
from utterscope.functions import vectors as vx
from utterscope.operators.components import connected_components
from utterscope.operators.prep import dense_index
from utterscope.operators.stability import stability_cluster
from utterscope.session import reliable_checkpoint


def embed_text(df: DataFrame, text: str, num_features: int = 1024, out: str = "embedding") -> DataFrame:
    """H6: hashing TF-IDF vector of the cleaned tokens, L2-normalised."""
    x = df.withColumn("_tok", tx.tokens(text))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features).transform(x)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf)
    n = Normalizer(inputCol="_idf", outputCol="_n", p=2.0).transform(idf)
    return n.withColumn(out, vector_to_array("_n")).drop("_tok", "_tf", "_idf", "_n")


def reduce_dims(df: DataFrame, vec: str, k: int = 15, out: str = "reduced") -> DataFrame:
    """H7: PCA to k dimensions, re-normalised to unit length."""
    x = df.withColumn("_f", array_to_vector(vx.as_double(vec)))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(x)
    y = model.transform(x).withColumn("_r", vector_to_array("_p"))
    return y.withColumn(out, vx.unit("_r")).drop("_f", "_p", "_r")


def vertex_components(vertices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component = smallest key reachable) for every vertex; runs until
    converged."""
    found = connected_components(edges).withColumnRenamed("id", key)
    return vertices.select(key).join(found, key, "left").select(key, F.coalesce("component", key).alias("component"))


def density_cluster(df: DataFrame, key: str, vec: str, min_cluster_size: int = 30, min_samples: int = 3,
                    eps: float | None = None, k: int = 15) -> DataFrame:
    """H8: (key, topic_id) with -1 for noise."""
    from utterscope.operators.metrics import exact_median
    from utterscope.operators.neighbors import knn_join
    kk = max(k, min_samples + 1)
    knn = knn_join(df.select(key, vec), key, vec, k=kk)
    knn = knn.withColumn("d", F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("cos"))))
    knn = reliable_checkpoint(knn)
    # core distance: distance to the min_samples-th other row (rank 1 = self)
    core = knn.where(F.col("rank") == min_samples + 1).select(key, F.col("d").alias("core"))
    if eps is None:
        # default cut: twice the (exact) median core distance
        med = exact_median(core, "core").select("median").scalar()
        eps = 2.0 * core.sparkSession.range(1).select(med).first()[0]
    e = (knn.where(F.col(key) != F.col(f"nb_{key}")).select(F.col(key).alias("src"), F.col(f"nb_{key}").alias("dst"), "d")
            .join(core.select(F.col(key).alias("src"), F.col("core").alias("c1")), "src")
            .join(core.select(F.col(key).alias("dst"), F.col("core").alias("c2")), "dst")
            .where(F.greatest("c1", "c2", "d") <= F.lit(float(eps))).select("src", "dst"))
    comp = vertex_components(df, e, key)
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    big = sizes.where(F.col("size") >= min_cluster_size)
    ids = dense_index(big, [F.desc("size"), "component"], "_pos").withColumn("topic_id", (F.col("_pos") - 1).cast("int"))
    out = comp.join(ids.select("component", "topic_id"), "component", "left")
    return out.select(key, F.coalesce("topic_id", F.lit(-1)).alias("topic_id"))


def centroid_cluster(df: DataFrame, key: str, vec: str, k: int = 10, noise_quantile: float = 0.9,
                     seed: int = 42) -> DataFrame:
    """H9: KMeans; rows farther from their centre than the cluster's
    ``noise_quantile`` distance become noise (-1)."""
    x = df.select(key, array_to_vector(vx.as_double(vec)).alias("_f"))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="_c").fit(x)
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    y = model.transform(x).withColumn("_v", vector_to_array("_f"))
    cen = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centers])
    y = y.withColumn("_d", vx.euclidean("_v", F.element_at(cen, F.col("_c") + 1)))
    q = y.groupBy("_c").agg(F.percentile_approx("_d", noise_quantile, 10000).alias("_q"))
    y = y.join(q, "_c")
    return y.select(key, F.when(F.col("_d") <= F.col("_q"), F.col("_c")).otherwise(F.lit(-1)).cast("int")
                    .alias("topic_id"), F.col("_d").alias("distance"))


def discover_intents(df: DataFrame, key: str, text: str, settings) -> dict:
    """Filter -> clean -> size gates -> embed -> reduce -> cluster ->
    keywords -> labels -> metrics, representatives and report tables.
    Returns a dict of DataFrames."""
    from utterscope.operators import geometry as ge
    from utterscope.operators import prep as pp
    from utterscope.operators import topics as tp
    n_in = df.count()
    if n_in < settings.min_sentences_for_discovery:
        raise ValueError(f"only {n_in} sentences; at least {settings.min_sentences_for_discovery} needed")
    x = tx.computed_once(df, "cleaned", tx.clean_for_discovery(text))
    x = reliable_checkpoint(pp.filter_min_words(x, "cleaned", settings.min_words_after_cleaning))
    n_clean = x.count()
    if n_clean < settings.min_cluster_size:
        raise ValueError(f"{n_clean} texts are left after cleaning, but a cluster has "
                         f"{settings.min_cluster_size} or more")
    emb = embed_text(x, "cleaned")
    red = reliable_checkpoint(reduce_dims(emb, "embedding", settings.n_components))
    topics = stability_cluster(red, key, "reduced", settings.min_cluster_size, settings.min_samples,
                               k=settings.n_neighbors)
    rows = reliable_checkpoint(red.join(topics, key))
    info = tp.topic_info(rows, "cleaned", "topic_id", settings.top_n_words, pre_cleaned=True)
    labels = info.select("topic_id", tx.topic_label_output("topic_id", "name").alias("discovered_intent"))
    out = tp.attach_topic_label(rows.select(key, text, "cleaned", "topic_id"), labels, "topic_id")
    linear = ge.centroid_silhouette(rows, "topic_id", "embedding")
    metrics = ge.clustering_metrics(rows, key, "topic_id", "embedding", settings.silhouette_max_rows).withColumns({
        "silhouette_rows": F.least(F.lit(settings.silhouette_max_rows).cast("long"), linear.select("n").scalar()),
        "centroid_silhouette": linear.select("centroid_silhouette").scalar(), "clustered_rows": linear.select("n").scalar()})
    likely = reliable_checkpoint(rows.join(ge.own_probability(rows, key, "topic_id", "embedding", "probability"), key).select(
        key, "topic_id", "cleaned", "probability"))
    coherence = ge.topic_coherence(rows, "topic_id", "embedding", "euclidean").join(
        info.select("topic_id", "name"), "topic_id", "left").orderBy(F.desc("coherence_score"), "topic_id")
    return {"assignments": out, "topic_info": info, "metrics": metrics, "coherence": coherence,
            "overview": tp.discovery_overview(rows, "topic_id"), "sizes": tp.topic_sizes(rows, "topic_id"),
            "representatives": tp.representative_rows(likely, "topic_id", key, "probability", "cleaned", 5),
            "report": tp.discovery_report(likely, "topic_id", key, "probability", "cleaned", info)}
