"""Finite elements on structured or file meshes: shape tables, cell maps, assembly and errors.

Shape tables are tiny (points x functions) and are joined as literal arrays, so assembly is one
explode per cell and one sum: nothing is gathered, and element matrices combine before the
shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.elements import cube_shapes
from meshwright.functions.quadrature import cube
from meshwright.operators.sparse import compress


def cell_points(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """cells with ``xyz``, the coordinates of their nodes in order."""
    at = cells.select("cell_id", F.posexplode("nodes").alias("pos", "vertex_id")).join(vertices.select("vertex_id", F.array("x", "y", "z").alias("p")), "vertex_id")
    points = at.groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("xyz"))
    return cells.join(points, "cell_id")


def literal(values) -> Column:
    return F.array(*(literal(v) if isinstance(v, (list, tuple)) else F.lit(float(v)) for v in values))


def tables(order: int, dims: int, points: list[tuple[list[float], float]]) -> list[Column]:
    """One struct for each point: weight, corner functions M with slopes D, and functions N of ``order`` with slopes S."""
    at = np.array([p for p, _ in points])
    corner, slope, _ = cube_shapes(1, at)
    value, grad, _ = (corner, slope, None) if order == 1 else cube_shapes(order, at)
    return [
        F.struct(F.lit(q).alias("q"), F.lit(float(w)).alias("w"), literal(corner[q].tolist()).alias("M"), literal(slope[q].tolist()).alias("D"), literal(value[q].tolist()).alias("N"), literal(grad[q].tolist()).alias("S"))
        for q, (_, w) in enumerate(points)
    ]


def mapped(at: DataFrame, dims: int, *keep: str) -> DataFrame:
    """Rows with a point ``s`` of ``tables`` and corners ``xyz``: place, Jacobian J, its inverse K, |det|, and physical gradients G."""
    from meshwright.functions.fields import determinant, inverse

    corners = range(2**dims)
    x = lambda a, d: F.get(F.get("xyz", a), d)
    jac = [[sum((F.get(F.get("s.D", a), i) * x(a, j) for a in corners), F.lit(0.0)) for j in range(dims)] for i in range(dims)]
    place = [sum((F.get("s.M", a) * x(a, d) for a in corners), F.lit(0.0)) for d in range(3)]
    at = at.select(*keep, "s", *(p.alias(n) for p, n in zip(place, "xyz", strict=True)), F.array(*(F.array(*row) for row in jac)).alias("J"))
    at = at.withColumns({"det": F.abs(determinant(F.col("J"), dims)), "K": inverse(F.col("J"), dims)})
    inv = lambda i, j: F.get(F.get("K", i), j)
    grads = F.transform("s.S", lambda g: F.array(*(sum((inv(i, j) * F.get(g, j) for j in range(dims)), F.lit(0.0)) for i in range(dims))))
    return at.withColumn("G", grads)


def quadrature_points(located: DataFrame, dims: int, n: int, order: int = 1) -> DataFrame:
    """(cell_id, nodes, q, w, x, y, z, N, G): every quadrature point with weight times |det J|, the shape values and
    their physical gradients. Cells are mapped by their corners ``xyz`` (x fastest); the functions are of
    ``order``, their unknowns in ``dofs`` if there is such a column, else in ``nodes``."""
    keep = F.col("dofs") if "dofs" in located.columns else F.col("nodes")
    at = located.select("cell_id", keep.alias("nodes"), "xyz", F.explode(F.array(*tables(order, dims, cube(n, dims)))).alias("s"))
    out = mapped(at, dims, "cell_id", "nodes")
    return out.select("cell_id", "nodes", F.col("s.q").alias("q"), (F.col("s.w") * F.col("det")).alias("w"), "x", "y", "z", F.col("s.N").alias("N"), "G")


def pairs(value) -> Column:
    """array<struct<ia, ja, val>> of all pairs of a row's functions; ``value`` maps two places to a column."""
    places = F.sequence(F.lit(0), F.size("nodes") - 1)
    one = lambda a: F.transform(places, lambda b: F.struct(F.get("nodes", a).alias("ia"), F.get("nodes", b).alias("ja"), value(a, b).alias("val")))
    return F.flatten(F.transform(places, one))


def assembled(points: DataFrame, value) -> DataFrame:
    return compress(points.select(F.explode(pairs(value)).alias("e")).select("e.ia", "e.ja", "e.val"))


def laplacian(points: DataFrame, dims: int) -> DataFrame:
    """The stiffness matrix (ia, ja, val)."""
    return assembled(points, lambda a, b: F.col("w") * sum((F.get(F.get("G", a), d) * F.get(F.get("G", b), d) for d in range(dims)), F.lit(0.0)))


def mass(points: DataFrame, dims: int) -> DataFrame:
    return assembled(points, lambda a, b: F.col("w") * F.get("N", a) * F.get("N", b))


def load(points: DataFrame, source: Column, dims: int) -> DataFrame:
    """The load vector (idx, val) of a source over x, y, z."""
    rows = F.zip_with("nodes", "N", lambda i, v: F.struct(i.alias("idx"), (F.col("w") * v * source).alias("val")))
    return points.select(F.explode(rows).alias("e")).select("e.idx", "e.val").groupBy("idx").agg(F.sum("val").alias("val"))


#: A user's weak form: it gets the quadrature points and gives entries (ia, ja, val) and right sides (idx, val), not yet summed.
WeakForm = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def integrated(points: DataFrame, form: WeakForm) -> tuple[DataFrame, DataFrame]:
    """Matrix and right side of a weak form."""
    matrix, rhs = form(points)
    return compress(matrix), rhs.groupBy("idx").agg(F.sum("val").alias("val"))


def interpolated(vertices: DataFrame, field: Column) -> DataFrame:
    """(idx, val): the nodal interpolant of a function of x, y, z; vertices are the nodes of the element's order."""
    return vertices.select(F.col("vertex_id").alias("idx"), field.cast("double").alias("val"))


def eliminated(matrix: DataFrame, rhs: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matrix and right side of the free unknowns; ``fixed`` is (idx, val)."""
    f = fixed.select(F.col("idx").alias("ja"), F.col("val").alias("g"))
    free_rows = matrix.join(fixed.select(F.col("idx").alias("ia")), "ia", "left_anti")
    moved = free_rows.join(f, "ja").groupBy(F.col("ia").alias("idx")).agg((-F.sum(F.col("val") * F.col("g"))).alias("val"))
    inner = free_rows.join(f.select("ja"), "ja", "left_anti").select("ia", "ja", "val")
    own = rhs.join(fixed.select("idx"), "idx", "left_anti").select("idx", "val")
    return inner, own.unionByName(moved).groupBy("idx").agg(F.sum("val").alias("val"))


def errors(points: DataFrame, solution: DataFrame, exact: Column, gradient: list[Column], dims: int) -> DataFrame:
    """(cell_id, w, e, e0, ...): the error and its gradient at every quadrature point."""
    at = points.select("cell_id", "q", "w", "x", "y", "z", F.posexplode(F.arrays_zip(F.col("nodes").alias("n"), F.col("N").alias("v"), F.col("G").alias("g"))).alias("a", "s"))
    joined = at.join(solution.select(F.col("idx").alias("n"), "val"), F.col("s.n") == F.col("n"))
    sums = [F.sum(F.col("val") * F.col("s.v")).alias("u"), *(F.sum(F.col("val") * F.get("s.g", d)).alias(f"u{d}") for d in range(dims))]
    u = joined.groupBy("cell_id", "q", "w", "x", "y", "z").agg(*sums)
    return u.select("cell_id", "w", (exact - F.col("u")).alias("e"), *((g - F.col(f"u{d}")).alias(f"e{d}") for d, g in enumerate(gradient)))
