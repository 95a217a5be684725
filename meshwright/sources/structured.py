"""Structured grids of quadrilaterals or hexahedra, generated from ``spark.range``."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linear(ijk: list[Column], sizes: list[int]) -> Column:
    """0-based number of (i, j, k); i runs fastest."""
    out, stride = F.lit(0).cast("long"), 1
    for c, n in zip(ijk, sizes, strict=True):
        out, stride = out + c * stride, stride * n
    return out


def spatial(number: Column, sizes: list[int]) -> list[Column]:
    """(i, j, k) of a 0-based number."""
    out, stride = [], 1
    for n in sizes:
        out.append(F.floor(number / stride) % n)
        stride *= n
    return out


def cells(spark: SparkSession, sizes: list[int], periodic: tuple[bool, ...] = ()) -> DataFrame:
    """cell_id (from 1), i, j, k, and its vertices' ids, x fastest."""
    dims = len(sizes)
    total = 1
    for n in sizes:
        total *= n
    wrap = [d < len(periodic) and periodic[d] for d in range(dims)]
    points = [n if w else n + 1 for n, w in zip(sizes, wrap, strict=True)]
    base = spark.range(total)
    at = spatial(F.col("id"), sizes)
    nodes = [linear([F.pmod(c + ((a >> d) & 1), F.lit(points[d])) for d, c in enumerate(at)], points) + 1 for a in range(2**dims)]
    names = "ijk"[:dims]
    return base.select((F.col("id") + 1).alias("cell_id"), *(c.cast("long").alias(n) for c, n in zip(at, names, strict=True)), F.array(*nodes).alias("nodes"))


def vertices(spark: SparkSession, sizes: list[int], limits: list[tuple[float, float]]) -> DataFrame:
    """vertex_id (from 1), coordinates (z = 0 in the plane), and whether it lies on the boundary."""
    points = [n + 1 for n in sizes]
    total = 1
    for n in points:
        total *= n
    at = spatial(F.col("id"), points)
    xyz = [F.lit(lo) + c * ((hi - lo) / n) for c, (lo, hi), n in zip(at, limits, sizes, strict=True)]
    xyz += [F.lit(0.0)] * (3 - len(xyz))
    edge = F.lit(False)
    for c, n in zip(at, sizes, strict=True):
        edge = edge | (c == 0) | (c == n)
    return spark.range(total).select((F.col("id") + 1).alias("vertex_id"), *(v.cast("double").alias(a) for v, a in zip(xyz, "xyz", strict=True)), edge.alias("boundary"))


def parts(grid: DataFrame, sizes: list[int], blocks: list[int]) -> DataFrame:
    """(cell_id, part): blocks of the grid, parts from 1."""
    at = [F.floor(F.col(n) * b / s) for n, b, s in zip("ijk", blocks, sizes, strict=False)]
    return grid.select("cell_id", (linear(at, blocks) + 1).cast("long").alias("part"))


def dofs(grid: DataFrame, sizes: list[int], order: int) -> DataFrame:
    """``grid`` with ``dofs``: the unknowns of continuous elements of ``order``, the points of the lattice that is
    ``order`` times as fine, numbered from 1 with x fastest; x fastest inside a cell, too."""
    points = [n * order + 1 for n in sizes]
    at = [F.col(n) * order for n in "ijk"[: len(sizes)]]
    steps = [list(reversed(m)) for m in itertools.product(range(order + 1), repeat=len(sizes))]
    return grid.withColumn("dofs", F.array(*((linear([c + s for c, s in zip(at, m, strict=True)], points) + 1).cast("long") for m in steps)))


def broken_dofs(grid: DataFrame, order: int, dims: int) -> DataFrame:
    """``grid`` with ``dofs`` of discontinuous elements: each cell has its own."""
    size = (order + 1) ** dims
    return grid.withColumn("dofs", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda a: (F.col("cell_id") - 1) * size + a))
