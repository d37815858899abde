"""Vector rows that may be compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id LONG, v ARRAY<DOUBLE>): rows with an id and a vector that is not
    null, not zero and free of null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; all have ``dim`` components."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
