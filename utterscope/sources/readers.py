"""Readers (A1–A5).  Explicit schemas, never ``inferSchema``."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

INTENT_DIM_SCHEMA = StructType([StructField("intent", StringType()),
                                StructField("description", StringType()),
                                StructField("priority", IntegerType())])
EXAMPLES_SCHEMA = StructType([StructField("input", StringType()),
                              StructField("output", StringType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Comma unless the header line holds more semicolons than commas (only
    the first line is read)."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return ","
    header = first[0][0] or ""
    return ";" if header.count(";") > header.count(",") else ","


def read_csv_strings(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV with a header, every column a string (schema from the header)."""
    sep = sep or detect_delimiter(spark, path)
    header = spark.read.text(path).limit(1).collect()[0][0]
    names = [h.strip().strip('"') for h in header.split(sep)]
    schema = StructType([StructField(n, StringType()) for n in names])
    return (spark.read.schema(schema)
            .option("header", True).option("sep", sep).option("multiLine", True)
            .option("escape", '"').option("mode", "FAILFAST").csv(path))


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """A1: utterance CSV (comma or semicolon)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Input file not found: {path}")
    return read_csv_strings(spark, path)


def read_labelled(spark: SparkSession, path: str, text: str = "text",
                  label: str = "intent", keep: list[str] | None = None) -> DataFrame:
    """A2: labelled utterances (parquet, or CSV when the path ends in .csv)."""
    df = read_csv_strings(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    return df.select(*(keep or []), F.col(text).cast("string").alias(text),
                     F.col(label).cast("string").alias(label))


def read_intent_dim(spark: SparkSession, path: str | None) -> DataFrame:
    """A3: JSON array of {intent, description, priority}; missing -> empty."""
    if not path or not path_exists(spark, path):
        return spark.createDataFrame([], INTENT_DIM_SCHEMA)
    return spark.read.schema(INTENT_DIM_SCHEMA).option("multiLine", True).json(path)


def read_examples(spark: SparkSession, path: str | None, max_examples: int = 1000) -> list[tuple[str, str]]:
    """A4: few-shot examples (tiny, become literals); missing, empty or
    invalid -> [] (zero-shot)."""
    if not path or not path_exists(spark, path):
        return []
    try:
        df = spark.read.schema(EXAMPLES_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
        rows = df.limit(max_examples + 1).collect()
    except PySparkException as e:
        if "MALFORMED_RECORD" in str(e) or "BAD_RECORD" in str(e):  # not the expected JSON: zero-shot
            return []
        raise
    if len(rows) > max_examples:
        raise ValueError(f"more than {max_examples} few-shot examples")
    return [(r["input"], r["output"]) for r in rows if r["input"] is not None]


def read_predictions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A5: a prediction report (CSV or parquet) as discovery input."""
    if fmt == "csv" or (fmt is None and path.endswith(".csv")):
        return read_csv_strings(spark, path)
    return spark.read.parquet(path)
