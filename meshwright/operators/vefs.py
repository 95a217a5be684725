"""Vertices, edges and faces of cells, found once each, with their sets and their cells around.

Cells are (cell_id, nodes), nodes with x fastest on squares and cubes, any order on simplices. A face
of a cell is known by its sorted vertices, so neighbours find each other by equality."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators.ranks import ranked
from meshwright.plans.lineage import Cut, checkpointed


def cube_faces(dims: int, of: int) -> list[tuple[int, ...]]:
    """Corner numbers of the faces of dimension ``of`` of a cube: some directions run, the others are fixed."""
    out = []
    for run in itertools.combinations(range(dims), of):
        still = [d for d in range(dims) if d not in run]
        for fixed in itertools.product((0, 1), repeat=len(still)):
            base = sum(v << d for v, d in zip(fixed, still, strict=True))
            out.append(tuple(base + sum(v << d for v, d in zip(reversed(m), run, strict=True)) for m in itertools.product((0, 1), repeat=of)))
    return out


def simplex_faces(dims: int, of: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(dims + 1), of + 1))


def occurrences(cells: DataFrame, dims: int, of: int, simplex: bool = False) -> DataFrame:
    """(cell_id, pos, corners, key): every face of every cell; ``key`` are its sorted vertices, ``corners`` those in the cell's order."""
    faces = (simplex_faces if simplex else cube_faces)(dims, of)
    each = [F.struct(F.lit(k).alias("pos"), F.array(*(F.get("nodes", c) for c in f)).alias("corners")) for k, f in enumerate(faces)]
    out = cells.select("cell_id", F.explode(F.array(*each)).alias("f"))
    return out.select("cell_id", "f.pos", "f.corners", F.array_sort("f.corners").alias("key"))


def unique(cells: DataFrame, dims: int, of: int, simplex: bool = False, cut: Cut = checkpointed) -> DataFrame:
    """(vef_id, key, n_cells): each face once, numbered in the order of its vertices."""
    found = occurrences(cells, dims, of, simplex).groupBy("key").agg(F.count("*").alias("n_cells"))
    return ranked(found, [F.col("key")], "vef_id", cut).select("vef_id", "key", "n_cells")


def cells_around(cells: DataFrame, vefs: DataFrame, dims: int, of: int, simplex: bool = False) -> DataFrame:
    """(vef_id, cell_id, pos)."""
    return occurrences(cells, dims, of, simplex).join(vefs.select("vef_id", "key"), "key").select("vef_id", "cell_id", "pos")


def with_sets(vefs: DataFrame, boundary: DataFrame) -> DataFrame:
    """vefs with set_id and geo_id of the boundary table (nodes, set_id, geo_id); 0 where it has none, the greatest where it has several."""
    sets = boundary.groupBy(F.array_sort("nodes").alias("key")).agg(F.max("set_id").alias("set_id"), F.max("geo_id").alias("geo_id"))
    return vefs.join(sets, "key", "left").select(*vefs.columns, F.coalesce("set_id", F.lit(0)).alias("set_id"), F.coalesce("geo_id", F.lit(0)).alias("geo_id"))


def on_boundary(facets: DataFrame) -> DataFrame:
    """(vef_id, key): facets with one cell around."""
    return facets.where("n_cells = 1").select("vef_id", "key")


def boundary_faces(cells: DataFrame, dims: int, of: int, simplex: bool = False) -> DataFrame:
    """(key): faces of any dimension that lie in a facet with one cell around."""
    facets = occurrences(cells, dims, dims - 1, simplex).groupBy("key").agg(F.count("*").alias("n"), F.first("corners").alias("corners")).where("n = 1")
    inside = (simplex_faces if simplex else cube_faces)(dims - 1, of)
    return facets.select(F.explode(F.array(*(F.array_sort(F.array(*(F.get("corners", c) for c in f))) for f in inside))).alias("key")).distinct()


def orientation(corners: Column) -> Column:
    """Of an edge, whether it runs from its greater to its lesser vertex."""
    return F.get(corners, 0) > F.get(corners, 1)


def matched(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(vef_id, other_id): equal faces of local and of ghost cells, by their vertices' global ids."""
    return mine.select("vef_id", "key").join(theirs.select(F.col("vef_id").alias("other_id"), "key"), "key").select("vef_id", "other_id")


def euler_number(cells: DataFrame, dims: int, simplex: bool = False) -> DataFrame:
    """(dim, n) of the unique faces of each dimension."""
    out = None
    for of in range(dims):
        part = occurrences(cells, dims, of, simplex).agg(F.countDistinct("key").alias("n")).select(F.lit(of).alias("dim"), "n")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(cells.agg(F.count("*").alias("n")).select(F.lit(dims).alias("dim"), "n"))


def dofs(cells: DataFrame, dims: int, per: dict[int, int], simplex: bool = False, cut: Cut = checkpointed) -> DataFrame:
    """(cell_id, pos, dof_id): unknowns of a space with ``per[d]`` of them on each face of dimension d, shared by
    the cells around; vertices first, then edges, and so on. Unknowns of an edge follow its direction from the lesser vertex."""
    start, place, out = 0, 0, None
    for of in range(dims + 1):
        n = per.get(of, 0)
        if not n:
            continue
        occ = occurrences(cells, dims, of, simplex)
        ids = cut(unique(cells, dims, of, simplex, cut), f"vefs{of}")
        at = occ.join(ids.select("vef_id", "key"), "key")
        inner = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k)
        turned = F.when(orientation(F.col("corners")), F.reverse(inner)).otherwise(inner) if of == 1 else inner
        part = at.select("cell_id", "pos", F.col("vef_id"), F.posexplode(turned).alias("k", "local"))
        part = part.select("cell_id", (F.col("pos") * n + F.col("k") + place).cast("int").alias("pos"), ((F.col("vef_id") - 1) * n + F.col("local") + 1 + start).cast("long").alias("dof_id"))
        out = part if out is None else out.unionByName(part)
        place += n * len((simplex_faces if simplex else cube_faces)(dims, of))
        start += n * ids.count()
    return out
