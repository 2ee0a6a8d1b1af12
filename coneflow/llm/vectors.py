"""Vectors as Arrow columns: validity, blocks, and merging of per-block nearest rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vector: Column) -> Column:
    """True for vectors that are there and whose components are all finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def one_row_per_id(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, dim) of usable vectors with an id; of rows that repeat an id, the smallest vector."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull()).filter(usable(F.col("vec")))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    whole = column.combine_chunks()
    n = len(whole)
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n) if n else np.empty((0, 0))


def first_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of equal vectors the ``most`` smallest ids; each task keeps no more before rows are shuffled."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    return rows.withColumn("copy", F.row_number().over(w)).filter(F.col("copy") <= most).drop("copy")


def best(scores: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all finite scores that are at most ``slack`` below the k-th largest of their row."""
    if not scores.size:
        return np.empty(0, int), np.empty(0, int)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    return np.nonzero((scores >= kth[:, None] - slack) & (scores > -np.inf))


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query from all blocks."""
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return distinct.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
