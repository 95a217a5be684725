"""Poisson on a structured grid: assembly, Dirichlet elimination, conjugate gradients, error norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators.norms import norm
from meshwright.plans import assembly
from meshwright.plans.lineage import Tables
from meshwright.plans.solvers import conjugate_gradients, solution
from meshwright.sources import structured


def solve(spark: SparkSession, sizes: list[int], source: Column, exact: Column, tolerance: float = 1e-11, order: int = 1) -> tuple[DataFrame, DataFrame]:
    """(solution (idx, val), quadrature points) of -div grad u = source with u = exact on the boundary of the unit box, by
    elements of ``order``; NotConverged if the solver stops above ``tolerance``."""
    cut, dims = Tables(spark).cut, len(sizes)
    box = [(0.0, 1.0)] * dims
    cells = structured.dofs(structured.cells(spark, sizes), sizes, order)
    points = cut(assembly.quadrature_points(assembly.cell_points(cells, structured.vertices(spark, sizes, box)), dims, order + 1, order), "points")
    nodes = structured.vertices(spark, [n * order for n in sizes], box)
    fixed = cut(assembly.interpolated(nodes.where("boundary"), exact), "fixed")
    matrix, rhs = assembly.eliminated(assembly.laplacian(points, dims), assembly.load(points, source, dims), fixed)
    inner = solution(conjugate_gradients(matrix, rhs, tolerance, cut=cut))
    return cut(inner.unionByName(fixed), "solution"), points


def solve_square(spark: SparkSession, n: int) -> DataFrame:
    exact = 1 + 2 * F.col("x") - 3 * F.col("y")
    u, _ = solve(spark, [n, n], F.lit(0.0), exact)
    return u.select("idx", F.round("val", 8).alias("val"))


def error_norms(points: DataFrame, u: DataFrame, exact: Column, gradient: list[Column], dims: int) -> dict[str, float]:
    e = assembly.errors(points, u, exact, gradient, dims)
    names = tuple(f"e{d}" for d in range(dims))
    row = e.agg(*(norm(k, gradient=names).alias(k) for k in ("mean", "l1", "l2", "linfty", "h1_seminorm", "h1", "w1infty"))).first()
    return row.asDict()
