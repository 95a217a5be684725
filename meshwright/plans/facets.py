"""Terms on facets: discontinuous elements in the plane, coupled by jumps and averages across edges.

Both cells of an edge evaluate their functions at the same points: points run from the edge's lesser to its
greater vertex, so the two sides meet by (edge, point)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.geometry import facet_measure, facet_normal, outward
from meshwright.functions.quadrature import gauss_legendre
from meshwright.operators.vefs import cube_faces
from meshwright.plans.assembly import assembled, mapped, tables


def edge_points(located: DataFrame, order: int, n: int) -> DataFrame:
    """(edge, q, cell_id, nodes, w, x, y, z, h, normal, N, G): the points of every edge of every cell; the normal points out
    of the cell, h is the edge's length."""
    x, w = gauss_legendre(n)
    corners = np.array([[-1.0, -1.0], [1.0, -1.0], [-1.0, 1.0], [1.0, 1.0]])
    sides = []
    for a, b in cube_faces(2, 1):
        rule = [((corners[a] * (1 - t) / 2 + corners[b] * (1 + t) / 2).tolist(), float(v) / 2) for t, v in zip(x, w, strict=True)]
        sides.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.array(*tables(order, 2, rule)).alias("points")))
    keep = F.col("dofs") if "dofs" in located.columns else F.col("nodes")
    at = located.select("cell_id", keep.alias("nodes"), F.col("nodes").alias("corners"), "xyz", F.explode(F.array(*sides)).alias("side"))
    va, vb = F.get("corners", F.col("side.a")), F.get("corners", F.col("side.b"))
    pa, pb = F.get("xyz", F.col("side.a")), F.get("xyz", F.col("side.b"))
    tangent = F.zip_with(pb, pa, lambda p, q: p - q)
    middle = F.zip_with(pa, pb, lambda p, q: (p + q) / 2)
    centre = F.array(*(sum((F.get(F.get("xyz", c), d) for c in range(4)), F.lit(0.0)) / 4 for d in range(3)))
    at = at.select(
        "cell_id", "nodes", "xyz", F.array_sort(F.array(va, vb)).alias("edge"), (va > vb).alias("back"), facet_measure(tangent).alias("h"),
        outward(facet_normal(tangent), middle, centre).alias("normal"), F.explode("side.points").alias("s"),
    )
    out = mapped(at, 2, "cell_id", "nodes", "edge", "back", "h", "normal")
    q = F.when(F.col("back"), n - 1 - F.col("s.q")).otherwise(F.col("s.q"))
    return out.select("edge", q.alias("q"), "cell_id", "nodes", (F.col("s.w") * F.col("h")).alias("w"), "x", "y", "z", "h", "normal", F.col("s.N").alias("N"), "G")


def across(points: DataFrame) -> DataFrame:
    """(nodes, w, x, y, z, h, boundary, jump, flux): for each point of each edge the functions of both cells in one row;
    ``jump`` has their jumps, ``flux`` the averages of their normal derivatives. The side with the lesser cell gives the normal."""
    slope = F.transform("G", lambda g: F.get(g, 0) * F.get("normal", 0) + F.get(g, 1) * F.get("normal", 1))
    own = points.select("edge", "q", "cell_id", "nodes", "w", "x", "y", "z", "h", F.col("N").alias("v"), slope.alias("d"))
    first = own.groupBy("edge").agg(F.min("cell_id").alias("lo"), F.max("cell_id").alias("hi"))
    rows = own.join(first, "edge")
    mine = rows.where("cell_id = lo")
    theirs = rows.where("cell_id = hi AND lo < hi").select("edge", "q", F.col("nodes").alias("nodes2"), F.col("v").alias("v2"), F.col("d").alias("d2"))
    both = mine.join(theirs, ["edge", "q"], "left")
    none = F.col("nodes2").isNull()
    merged = lambda a, b: F.when(none, a).otherwise(F.concat(a, b))
    # The other side's outward slope is the negative of the slope along this normal.
    half = lambda c, s: F.transform(c, lambda x: x * s)
    return both.select(
        merged(F.col("nodes"), F.col("nodes2")).alias("nodes"), "w", "x", "y", "z", "h", none.alias("boundary"),
        merged(F.col("v"), half(F.col("v2"), F.lit(-1.0))).alias("jump"), F.when(none, F.col("d")).otherwise(F.concat(half(F.col("d"), F.lit(0.5)), half(F.col("d2"), F.lit(-0.5)))).alias("flux"),
    )


def interior_penalty(edges: DataFrame, penalty: float) -> DataFrame:
    """(ia, ja, val): the edge terms of the symmetric interior penalty method, boundary values imposed weakly."""
    j, f = (lambda a: F.get("jump", a)), (lambda a: F.get("flux", a))
    return assembled(edges, lambda a, b: F.col("w") * (penalty / F.col("h") * j(a) * j(b) - f(a) * j(b) - j(a) * f(b)))


def weak_boundary(edges: DataFrame, value: Column, penalty: float) -> DataFrame:
    """(idx, val): the right side of boundary values over x, y, z."""
    on = edges.where("boundary")
    both = F.zip_with("jump", "flux", lambda j, f: penalty / F.col("h") * j - f)
    rows = F.zip_with("nodes", both, lambda i, v: F.struct(i.alias("idx"), (F.col("w") * v * value).alias("val")))
    return on.select(F.explode(rows).alias("e")).select("e.idx", "e.val").groupBy("idx").agg(F.sum("val").alias("val"))


def boundary_mass(points: DataFrame) -> DataFrame:
    """(ia, ja, val): products of the functions over edges with one cell around."""
    alone = points.groupBy("edge").agg(F.countDistinct("cell_id").alias("n")).where("n = 1").select("edge")
    return assembled(points.join(alone, "edge", "left_semi"), lambda a, b: F.col("w") * F.get("N", a) * F.get("N", b))


def solve_broken(spark, sizes: list[int], source: Column, exact: Column, order: int = 1, penalty: float | None = None) -> DataFrame:
    """(idx, val) of -div grad u = source on the unit square by discontinuous elements, solved directly (so for small grids)."""
    from meshwright.operators.sparse import add
    from meshwright.plans import assembly, direct
    from meshwright.plans.lineage import checkpointed
    from meshwright.sources import structured

    penalty = penalty or 10.0 * order * order
    cells = structured.broken_dofs(structured.cells(spark, sizes), order, 2)
    located = checkpointed(assembly.cell_points(cells, structured.vertices(spark, sizes, [(0.0, 1.0)] * 2)), "located")
    inner = assembly.quadrature_points(located, 2, order + 1, order)
    edges = checkpointed(across(edge_points(located, order, order + 1)), "edges")
    matrix = add(assembly.laplacian(inner, 2), interior_penalty(edges, penalty))
    rhs = assembly.load(inner, source, 2).unionByName(weak_boundary(edges, exact, penalty)).groupBy("idx").agg(F.sum("val").alias("val"))
    return direct.solve_one(matrix, rhs)
