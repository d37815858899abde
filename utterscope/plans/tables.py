"""Loaders for the driver tables and the adapters that give them the
logical schemas of the jobs (utterances, labelled rows, scored rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.functions import lexicon as lx
from utterscope.functions import vectors as vx
from utterscope.operators import scoring as sc

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Flagship scoring parameters (inference YAML: T = 1.2, threshold = 0.65).
TEMPERATURE = 1.2
THRESHOLD = 0.65
LOGIT_SCALE = 20.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def intent_name(label) -> Column:
    """Class id -> intent name; class 0 plays the NOMATCH intent."""
    lab = F.col(label) if isinstance(label, str) else label
    return F.when(lab == 0, F.lit(lx.LABEL_NOMATCH)).otherwise(
        F.concat(F.lit("intent_"), lab.cast("string")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v ARRAY<DOUBLE>)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", vx.as_double("embedding").alias("v"))


def scored(spark: SparkSession, sf_dir: str, metric: str = "cosine") -> DataFrame:
    """Embeddings scored against their label centroids (C14 + E20):
    (vec_id, label, true_label, v, logits, class_names)."""
    emb = vectors(spark, sf_dir)
    cents = sc.group_centroids(emb, "label", "v")
    classes = sc.class_table(cents, "label", intent_name("label"))
    out = sc.centroid_logits(emb, classes, "v", "vec_id", metric=metric, scale=LOGIT_SCALE)
    return out.withColumn("true_label", intent_name("label"))


def classified(spark: SparkSession, sf_dir: str, temperature: float = TEMPERATURE,
               threshold: float = THRESHOLD) -> DataFrame:
    return sc.classify(scored(spark, sf_dir), temperature, threshold)


def bot_topic(vec_id: str = "vec_id", label: str = "label") -> Column:
    """The upstream bot's topic for a flagship row: the row's own intent,
    left empty on every fifth id so that the MATCH branch occurs."""
    return F.when(F.col(vec_id) % 5 == 0, F.lit("")).otherwise(intent_name(label))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as utterances, keyed by (conv_id, turn)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined with labels: (doc_id, text, lang, source, quality, toxic)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id")


NOISE_LABEL_VALUE = 9


def topic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a clustered table: label = topic id, label 9 plays the
    noise topic (-1).  (vec_id, topic_id, label, v)."""
    e = vectors(spark, sf_dir)
    return e.withColumn("topic_id", F.when(F.col("label") == NOISE_LABEL_VALUE, F.lit(-1))
                        .otherwise(F.col("label")))


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` dealt to ``parts`` tasks (default: the session's cores) if its
    scan has fewer splits, as a file of one row group has; select the columns
    that are needed before."""
    parts = parts or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def cleaned_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """All documents with the discovery-cleaned text: (doc_id, columns, cleaned)."""
    from utterscope.functions import text as tx
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))
    out = tx.computed_once(d, "cleaned", tx.clean_for_discovery("text"))
    return out if "text" in columns else out.drop("text")


def topic_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, topic_id, v): every document with the topic and vector of the
    embedding whose vec_id is its id modulo the number of embeddings."""
    t = topic_vectors(spark, sf_dir).select("vec_id", "topic_id", "v")
    n = table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    # the count stands in a column, not in the join's condition: a shuffle by
    # an expression that holds a subquery doesn't wait for it
    d = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", n).alias("vec_id"))
    return d.join(t, "vec_id").select("doc_id", "topic_id", "v")


def topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as clustered utterances for the discovery reports:
    (doc_id, topic_id, v, cleaned)."""
    return cleaned_documents(spark, sf_dir).join(topic_of_documents(spark, sf_dir), "doc_id")
