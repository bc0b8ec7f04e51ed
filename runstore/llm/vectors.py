"""What the operators on embeddings share: usable vectors, and numpy matrices of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import one_row_per_key


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): one row per id with a vector that isn't null, empty or zero and has finite components only."""
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("v"))
    rows = one_row_per_key(rows, "vec_id")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def by_length(rows: DataFrame) -> list[DataFrame]:
    """``rows`` (vec_id, v) apart by the number of components, the commonest first: each is a space of its own."""
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").collect()  # a row for each length
    return [rows] if len(lengths) <= 1 else [rows.where(F.size("v") == r.n) for r in lengths]


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
