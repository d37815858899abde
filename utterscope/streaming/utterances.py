"""Utterance streams: cleaning and enrichment (B6 to B9, B13, F2), repeated
interactions, ensembles (C9) and topic assignment (H11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.functions import text as tx
from utterscope.functions import vectors as vx
from utterscope.operators import geometry as ge
from utterscope.operators import scoring as sc


def once_per_interaction(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each ``key``; rows that repeat it within ``delay`` of
    its event time are dropped, and its state after that.  The same call on a
    table drops all repeats."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else \
        stream.dropDuplicates([key])


def cleaned_utterances(rows: DataFrame, phrase: str, intents: DataFrame, intent: str, max_length: int = 512) -> DataFrame:
    """``rows`` with ``text`` (validated), ``normalised`` (rules), ``cleaned``
    (for discovery) and the ``description`` of the row's intent: a join of
    the stream with a table, which every micro-batch reads anew."""
    described = intents.select(F.col("intent").alias("_intent"), "description")
    out = rows.withColumn("text", tx.validate_text(phrase, max_length))
    out = out.withColumn("normalised", tx.normalise_rule_based("text")).withColumn("cleaned", tx.clean_for_discovery("text"))
    return out.join(described, F.col(intent) == F.col("_intent"), "left").drop("_intent")


def score_ensemble(rows: DataFrame, frozen: list[Column], vec: str, temperature: float, threshold: float,
                   scale: float = 20.0) -> DataFrame:
    """The mean of the logits that several frozen class tables (of
    the same classes) give, and the decision."""
    logits = [sc._logit_expr(vx.as_double(vec), f, "cosine", scale) for f in frozen]
    named = rows.withColumns({f"_lg{i}": x for i, x in enumerate(logits)})
    mean = vx.elementwise_mean([f"_lg{i}" for i in range(len(frozen))])
    out = named.withColumn("logits", mean).drop(*[f"_lg{i}" for i in range(len(frozen))])
    return sc.classify(out.withColumn("class_names", F.transform(frozen[0], lambda c: c["name"])), temperature, threshold)


def freeze_topics(fit: DataFrame, topic: str, vec: str, max_topics: int = 20_000) -> Column:
    """The topics of a clustered table (id, centroid, radius) as a literal,
    for streams; more than ``max_topics`` are an error."""
    rows = ge.topic_radii(fit, topic, vec).orderBy("t").limit(max_topics + 1).collect()
    if len(rows) > max_topics:
        raise ValueError(f"more than {max_topics} topics cannot be frozen into a stream")
    return F.array(*[F.struct(F.lit(r["t"]).alias("t"), F.array(*[F.lit(float(x)) for x in r["centroid"]]).alias("centroid"),
                              F.lit(float(r["radius"])).alias("radius")) for r in rows])


def assign_topics_stream(stream: DataFrame, frozen: Column, vec: str) -> DataFrame:
    """H11 on a stream: ``geometry.assign_topics`` with frozen topics."""
    return ge.nearest_topic(stream, frozen, vec)
