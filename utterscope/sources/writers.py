"""Sinks and persisted artefacts.

CSV output has no UTF-8 BOM (a documented difference from ``utf-8-sig``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.sources.readers import path_exists


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write a report; CSV with a header, one folder of part files."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
    return path


def save_model(model, path: str, label_index: DataFrame | None = None, settings: dict | None = None) -> str:
    """Persist a fitted Spark ML model with its label map and settings."""
    model.write().overwrite().save(f"{path}/model")
    if label_index is not None:
        label_index.write.mode("overwrite").parquet(f"{path}/labels")
    if settings is not None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(settings, default=str),)], "settings string") \
             .write.mode("overwrite").json(f"{path}/settings")
    return path


def load_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel
    model = PipelineModel.load(f"{path}/model")
    labels = spark.read.parquet(f"{path}/labels") if path_exists(spark, f"{path}/labels") else None
    return model, labels


def save_calibration(spark: SparkSession, temperature: float, path: str, nll: float | None = None) -> str:
    """Fitted temperature as a one-row parquet (no pickle)."""
    spark.createDataFrame([(float(temperature), nll)], "temperature double, nll double") \
         .coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_calibration(spark: SparkSession, path: str) -> float:
    """Absent calibration -> 1.0 (uncalibrated); an unreadable one raises."""
    if not path_exists(spark, path):
        return 1.0
    row = spark.read.parquet(path).select("temperature").limit(1).collect()
    return float(row[0][0]) if row else 1.0


def save_trials(trials: DataFrame, path: str) -> str:
    """Trials table + best-params row."""
    trials.write.mode("overwrite").parquet(f"{path}/trials")
    from utterscope.operators.tuning import best_trial
    best_trial(trials).write.mode("overwrite").parquet(f"{path}/best")
    return path


def read_best_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/best").select(F.col("*"))
