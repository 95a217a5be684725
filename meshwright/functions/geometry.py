"""Lengths, facets and edges of mapped cells, as columns over Jacobians (arrays of rows).

J[i][j] is the derivative of coordinate j by reference direction i, K = J^-1 likewise [coordinate][reference]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwright.functions.fields import cross, norm, times


def row_lengths(inverse: Column, dims: int) -> list[Column]:
    """The lengths of the gradients of the reference coordinates: of the columns of K."""
    at = lambda i, j: F.get(F.get(inverse, i), j)
    return [F.sqrt(sum((at(i, j) * at(i, j) for i in range(dims)), F.lit(0.0))) for j in range(dims)]


def characteristic_length(inverse: Column, dims: int, reference: float = 2.0) -> Column:
    """The reference length over the geometric mean of the rows' lengths."""
    product = F.lit(1.0)
    for r in row_lengths(inverse, dims):
        product = product * r
    return reference * F.pow(product, F.lit(-1.0 / dims))


def directional_lengths(inverse: Column, dims: int, reference: float = 2.0) -> Column:
    return F.array(*(reference / r for r in row_lengths(inverse, dims)))


def shortest(inverse: Column, dims: int, reference: float = 2.0) -> Column:
    return F.array_min(directional_lengths(inverse, dims, reference))


def longest(inverse: Column, dims: int, reference: float = 2.0) -> Column:
    return F.array_max(directional_lengths(inverse, dims, reference))


def facet_normal(*tangents: Column) -> Column:
    """The unit normal: of a curve the tangent turned clockwise in the plane, of a surface the cross product of its two tangents."""
    if len(tangents) == 1:
        t = tangents[0]
        n = F.array(F.get(t, 1), -F.get(t, 0), F.lit(0.0))
    else:
        n = cross(*tangents)
    return times(1 / F.nullif(norm(n), F.lit(0.0)), n)


def facet_measure(*tangents: Column) -> Column:
    """The factor between reference and physical facets."""
    return norm(tangents[0]) if len(tangents) == 1 else norm(cross(*tangents))


def outward(normal: Column, facet_centre: Column, cell_centre: Column) -> Column:
    """The normal that points away from the cell."""
    side = F.aggregate(F.zip_with(normal, F.zip_with(facet_centre, cell_centre, lambda a, b: a - b), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(side < 0, times(F.lit(-1.0), normal)).otherwise(normal)


def unit_tangent(a: Column, b: Column) -> Column:
    """Of the edge from a to b."""
    t = F.zip_with(b, a, lambda x, y: x - y)
    return times(1 / F.nullif(norm(t), F.lit(0.0)), t)
