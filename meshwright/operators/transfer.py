"""Values of unknowns carried from one mesh to the next."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.elements import coarsening, refinement


def product(rows: np.ndarray, values: Column) -> Column:
    """A small matrix, as literals, times an array column."""
    line = lambda r: sum((float(c) * F.get(values, j) for j, c in enumerate(r) if abs(c) > 1e-15), F.lit(0.0))
    return F.array(*(line(r) for r in rows))


def refined(cells: DataFrame, order: int, dims: int) -> DataFrame:
    """(cell_id, child, vals): the nodal values of every child of cells (cell_id, vals); children with x fastest, from 0."""
    tables = refinement(order, dims)
    kids = F.array(*(F.struct(F.lit(k).alias("child"), product(t, F.col("vals")).alias("vals")) for k, t in enumerate(tables)))
    return cells.select("cell_id", F.explode(kids).alias("c")).select("cell_id", "c.child", "c.vals")


def coarsened(children: DataFrame, order: int, dims: int) -> DataFrame:
    """(cell_id, vals): a parent's nodal values from those of its children (cell_id, child, vals), by least squares."""
    tables = coarsening(order, dims)
    size = (order + 1) ** dims
    share = F.lit(None).cast("array<double>")
    for k, t in enumerate(tables):
        share = F.when(F.col("child") == k, product(t, F.col("vals"))).otherwise(share)
    rows = children.select("cell_id", share.alias("s"))
    sums = rows.groupBy("cell_id").agg(*(F.sum(F.get("s", a)).alias(f"v{a}") for a in range(size)))
    return sums.select("cell_id", F.array(*(F.col(f"v{a}") for a in range(size))).alias("vals"))
