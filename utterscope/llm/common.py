"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that travel to a Python worker together.  Texts may be very long, so
# the batch is small; the result of no operator depends on it.
BATCH_ROWS = 400
# Characters of text that an operator works on at a time, beyond one text.
BATCH_CHARS = 1_000_000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session, so that a worker holds few
    texts at a time whatever the partition size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id LONG, text STRING): null texts become empty, other columns go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_texts(docs: DataFrame, fn: Callable[[list, list], dict], schema: str) -> DataFrame:
    """Apply ``fn(ids, texts) -> {column: values}`` to batches of
    (doc_id, text); ``schema`` is the DDL of the returned columns."""
    arrow_schema = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in stretches(values):
                out = fn(ids[lo:hi], values[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [_array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    def _array(v, kind):
        return v.cast(kind) if isinstance(v, pa.Array) else pa.array(v, type=kind)

    return docs.mapInArrow(run, schema)


def stretches(values: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``BATCH_CHARS`` characters, one text
    at least."""
    at, size = 0, 0
    for i, v in enumerate(values):
        size += len(v)
        if size >= BATCH_CHARS or i == len(values) - 1:
            yield at, i + 1
            at, size = i + 1, 0


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
          "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def to_arrow(schema: str) -> pa.Schema:
    """Arrow schema of a flat DDL string."""
    return pa.schema([(n, _ARROW[t.strip()]) for n, t in
                      (c.strip().split(" ", 1) for c in schema.split(","))])
