"""Assembly of a stream of matrix entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.sparse import compress, insert


def running_matrix(entries: DataFrame, rows: int | None = None, cols: int | None = None, symmetric: bool = False) -> DataFrame:
    """The matrix so far from a stream of (ia, ja, val): a stateful sum, for output modes complete and update."""
    return compress(insert(entries, rows, cols, symmetric=symmetric))


def windowed_matrix(entries: DataFrame, at: str, length: str, late: str, rows: int | None = None, cols: int | None = None, symmetric: bool = False) -> DataFrame:
    """(start, ia, ja, val): one matrix for each window of event time ``at``. A window is final, and its state goes,
    when the stream has passed its end by ``late``; later entries are dropped. For output modes append and update."""
    kept = insert(entries.withWatermark(at, late), rows, cols, symmetric=symmetric)
    sums = kept.groupBy(F.window(at, length).alias("w"), "ia", "ja").agg(F.sum("val").alias("val"))
    return sums.select(F.col("w.start").alias("start"), "ia", "ja", "val")
