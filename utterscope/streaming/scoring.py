"""Streaming scoring: the row-wise operators (C1–C5, H11) on a streaming
DataFrame.

A fitted class table (one row per class) is frozen into a literal so every
micro-batch scores against the same model with no join and no state.
``Trigger.AvailableNow`` processes whatever is present and stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from utterscope.functions import vectors as vx
from utterscope.operators import scoring as sc

EMBEDDING_SCHEMA = StructType([StructField("vec_id", LongType()),
                               StructField("embedding", ArrayType(FloatType())),
                               StructField("label", IntegerType())])


def freeze_classes(classes: DataFrame, max_classes: int = 20000) -> Column:
    """Class table (cls, name, centroid, cnorm) -> an array literal.  The
    table is bounded by the class count, checked here."""
    rows = classes.orderBy("cls").limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes cannot be frozen into a streaming model")
    return F.array(*[F.struct(F.lit(int(r["cls"])).alias("cls"), F.lit(r["name"]).alias("name"),
                              F.array(*[F.lit(float(x)) for x in r["centroid"]]).alias("centroid"),
                              F.lit(float(r["cnorm"])).alias("cnorm")) for r in rows])


def score_stream(stream: DataFrame, frozen: Column, vec: str, temperature: float, threshold: float,
                 scale: float = 20.0) -> DataFrame:
    """C14 -> C1 -> C2 -> C3 on a streaming frame."""
    s = stream.withColumn("logits", sc._logit_expr(vx.as_double(vec), frozen, "cosine", scale)) \
              .withColumn("class_names", F.transform(frozen, lambda c: c["name"]))
    return sc.classify(s, temperature, threshold)


def read_embeddings_stream(spark: SparkSession, folder: str, file_glob: str = "embeddings.parquet") -> DataFrame:
    return (spark.readStream.schema(EMBEDDING_SCHEMA).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", 1).parquet(folder))


def run_available_now(df: DataFrame, sink_dir: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything available, write to ``sink_dir``, stop."""
    q = (df.writeStream.format(fmt).option("path", sink_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
