"""Cut cells: status of cells under a level set, cut areas by simplices, aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.plans.lineage import Cut, checkpointed


def status(phi: Column | str) -> Column:
    """Of an array of nodal values: cut (some < 0 and some > 0), interior (none > 0) or exterior."""
    low, high = F.array_min(phi), F.array_max(phi)
    return F.when((low < 0) & (high > 0), "cut").when(high <= 0, "interior").otherwise("exterior")


def case_number(phi: Column) -> Column:
    """1 + the sum of 2^i over negative nodes i from 0; the last number where none is positive."""
    n = F.size(phi)
    bits = F.aggregate(F.transform(phi, lambda x, i: F.when(x < 0, F.pow(F.lit(2.0), i)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.array_max(phi) <= 0, F.pow(F.lit(2.0), n)).otherwise(bits + 1).cast("int")


def nodal(cells: DataFrame, values: DataFrame) -> DataFrame:
    """cells with ``phi``, the values (vertex_id, phi) of their nodes in order."""
    at = cells.select("cell_id", F.posexplode("nodes").alias("pos", "vertex_id")).join(values, "vertex_id")
    return cells.join(at.groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "phi"))), lambda s: s["phi"]).alias("phi")), "cell_id")


def negative_area(cells: DataFrame) -> DataFrame:
    """(cell_id, area): the area of phi < 0 in quadrilaterals (xyz, phi; x fastest), each split into two
    triangles on which phi is linear."""
    p = lambda a, d: F.get(F.get("xyz", a), d)
    total = F.lit(0.0)
    for a, b, c in ((0, 1, 3), (0, 3, 2)):
        area = F.abs((p(b, 0) - p(a, 0)) * (p(c, 1) - p(a, 1)) - (p(c, 0) - p(a, 0)) * (p(b, 1) - p(a, 1))) / 2
        f = F.sort_array(F.array(*(F.get("phi", k) for k in (a, b, c))))
        lo, mid, hi = (F.get(f, k) for k in range(3))
        one = F.try_divide(lo * lo, (lo - mid) * (lo - hi))
        two = 1 - F.try_divide(hi * hi, (hi - lo) * (hi - mid))
        share = F.when(hi <= 0, F.lit(1.0)).when(lo >= 0, F.lit(0.0)).when(mid >= 0, one).otherwise(two)
        total = total + area * share
    return cells.select("cell_id", total.alias("area"))


def aggregates(states: DataFrame, facets: DataFrame, cut: Cut = checkpointed) -> DataFrame:
    """(cell_id, root): cut cells join, sweep by sweep, the aggregate of a touched facet neighbour (the one
    with the least root); interior cells are their own roots. Sweeps go on until none joins a
    cell, so only cut cells that no chain of facets ties to an interior cell have no root. ``facets`` is
    (cell_id, neighbour)."""
    both = cut(facets.select("cell_id", "neighbour").unionByName(facets.select(F.col("neighbour").alias("cell_id"), F.col("cell_id").alias("neighbour"))).distinct(), "facets")
    state = states.where("status != 'exterior'").select("cell_id", F.when(F.col("status") == "interior", F.col("cell_id")).alias("root"))
    k = 0
    while True:
        state = cut(state, f"sweep{k}")
        near = both.join(state.where("root IS NOT NULL").select(F.col("cell_id").alias("neighbour"), F.col("root").alias("r")), "neighbour").groupBy("cell_id").agg(F.min("r").alias("r"))
        new = state.where("root IS NULL").select("cell_id").join(near, "cell_id")
        if new.isEmpty():
            return state
        state = state.join(near, "cell_id", "left").select("cell_id", F.coalesce("root", "r").alias("root"))
        k += 1


def snapped(nodes: DataFrame, edges: DataFrame, tolerance: float) -> DataFrame:
    """(vertex_id, phi): values of ends nearer to an edge's crossing than ``tolerance`` of it become 0."""
    v = nodes.select("vertex_id", "phi")
    e = edges.join(v.select(F.col("vertex_id").alias("a"), F.col("phi").alias("pa")), "a").join(v.select(F.col("vertex_id").alias("b"), F.col("phi").alias("pb")), "b").where("pa * pb < 0")
    at = F.abs(F.col("pa")) / (F.abs(F.col("pa")) + F.abs(F.col("pb")))
    hit = e.where(at < tolerance).select(F.col("a").alias("vertex_id")).unionByName(e.where(at > 1 - tolerance).select(F.col("b").alias("vertex_id"))).distinct().withColumn("hit", F.lit(True))
    return v.join(hit, "vertex_id", "left").select("vertex_id", F.when(F.col("hit"), F.lit(0.0)).otherwise(F.col("phi")).alias("phi"))


def facet_is_cut(phi: Column) -> Column:
    """Whether a facet with these nodal values is crossed: values on both sides."""
    return (F.array_min(phi) < 0) & (F.array_max(phi) > 0)


def counts(states: DataFrame) -> DataFrame:
    """(status, n)."""
    return states.groupBy("status").agg(F.count("*").alias("n"))


def subcells(cells: DataFrame) -> DataFrame:
    """(cell_id, side, xy): the triangles of cut quadrilaterals (xyz, phi; x fastest). Each is halved along its diagonal; a
    triangle that phi = 0 crosses is cut into one triangle at the lone corner and two at the others. ``side`` is
    -1 inside (phi < 0) and 1 outside."""
    p = lambda a: F.get("xyz", a)
    halves = [F.array(*(F.struct(F.get("phi", k).alias("phi"), F.slice(p(k), 1, 2).alias("xy")) for k in t)) for t in ((0, 1, 3), (0, 3, 2))]
    rows = cells.select("cell_id", F.explode(F.array(*halves)).alias("t"))
    inside, outside = F.filter("t", lambda c: c["phi"] < 0), F.filter("t", lambda c: c["phi"] >= 0)
    rows = rows.select("cell_id", "t", inside.alias("neg"), outside.alias("pos"))
    lone = F.when(F.size("neg") == 1, F.get("neg", 0)).otherwise(F.get("pos", 0))
    others = F.when(F.size("neg") == 1, F.col("pos")).otherwise(F.col("neg"))
    side = F.when(F.size("neg") == 1, F.lit(-1)).otherwise(F.lit(1))
    rows = rows.withColumns({"lone": lone, "others": others, "side": side})
    crossing = lambda a, b: F.zip_with(a["xy"], b["xy"], lambda x, y: x + (y - x) * (a["phi"] / (a["phi"] - b["phi"])))
    a, b = F.get("others", 0), F.get("others", 1)
    m, n = crossing(F.col("lone"), a), crossing(F.col("lone"), b)
    whole = F.array(F.struct(F.when(F.size("neg") == 3, -1).otherwise(1).alias("side"), F.transform("t", lambda c: c["xy"]).alias("xy")))
    three = F.array(
        F.struct(F.col("side").alias("side"), F.array(F.col("lone.xy"), m, n).alias("xy")), F.struct((-F.col("side")).alias("side"), F.array(m, a["xy"], b["xy"]).alias("xy")),
        F.struct((-F.col("side")).alias("side"), F.array(m, b["xy"], n).alias("xy")),
    )
    pieces = F.when((F.size("neg") == 0) | (F.size("neg") == 3), whole).otherwise(three)
    return rows.select("cell_id", F.explode(pieces).alias("s")).select("cell_id", "s.side", "s.xy")


def triangle_area(xy: Column) -> Column:
    at = lambda k, d: F.get(F.get(xy, k), d)
    return F.abs((at(1, 0) - at(0, 0)) * (at(2, 1) - at(0, 1)) - (at(2, 0) - at(0, 0)) * (at(1, 1) - at(0, 1))) / 2


def cut_lines(cells: DataFrame) -> DataFrame:
    """(cell_id, xy): the pieces of phi = 0 in cut quadrilaterals: in each crossed triangle the side that both parts share."""
    inner = subcells(cells).where("side = -1").select("cell_id", F.explode(F.array(*(F.array_sort(F.array(F.get("xy", a), F.get("xy", b))) for a, b in ((0, 1), (1, 2), (0, 2))))).alias("xy"))
    outer = subcells(cells).where("side = 1").select("cell_id", F.explode(F.array(*(F.array_sort(F.array(F.get("xy", a), F.get("xy", b))) for a, b in ((0, 1), (1, 2), (0, 2))))).alias("xy"))
    return inner.distinct().join(outer.distinct(), ["cell_id", "xy"])


def dense_ids(df: DataFrame, column: str, out: str, cut: Cut = checkpointed) -> DataFrame:
    """``df`` with gapless numbers from 1 for the values of a column, in their order."""
    from meshwright.operators.ranks import ranked

    values = ranked(df.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], out, cut)
    return df.join(values, column, "left").select(*df.columns, out)


def aggregate_sizes(members: DataFrame, points: DataFrame) -> DataFrame:
    """(cell_id, size): the longest side of the box around a cell's aggregate, from (cell_id, root) and corners (cell_id, x, y, z)."""
    sides = [F.max(c) - F.min(c) for c in "xyz"]
    boxes = members.join(points, "cell_id").groupBy("root").agg(F.greatest(*sides).alias("size"))
    return members.join(boxes, "root").select("cell_id", "size")


def aggregate_edges(members: DataFrame, facets: DataFrame) -> DataFrame:
    """(root, neighbour_root): aggregates that a facet (cell_id, neighbour) ties."""
    a = facets.join(members.select("cell_id", "root"), "cell_id").join(members.select(F.col("cell_id").alias("neighbour"), F.col("root").alias("neighbour_root")), "neighbour")
    return a.where("root != neighbour_root").select("root", "neighbour_root").distinct()


def too_large(sizes: DataFrame, states: DataFrame, most: float) -> DataFrame:
    """(cell_id, flag): 1 for cut cells whose aggregate is larger than ``most``: refining them makes it smaller."""
    return sizes.join(states, "cell_id").select("cell_id", F.when((F.col("status") == "cut") & (F.col("size") > most), 1).otherwise(0).alias("flag"))


def extrapolated(cut_dofs: DataFrame, roots: DataFrame) -> DataFrame:
    """(dof_id, master_id, coeff): unknowns (dof_id, cell_id, root, x, y) that lie in cut cells only follow the bilinear functions of
    their aggregate's root cell (cell_id, nodes, xyz of an upright rectangle; x fastest), evaluated outside of it."""
    r = roots.select(F.col("cell_id").alias("root"), "nodes", "xyz")
    at = cut_dofs.join(r, "root")
    low, high = F.get("xyz", 0), F.get("xyz", 3)
    u = (F.col("x") - F.get(low, 0)) / (F.get(high, 0) - F.get(low, 0))
    v = (F.col("y") - F.get(low, 1)) / (F.get(high, 1) - F.get(low, 1))
    terms = F.array(*(F.struct(F.get("nodes", k).alias("master_id"), ((u if k & 1 else 1 - u) * (v if k & 2 else 1 - v)).alias("coeff")) for k in range(4)))
    return at.select("dof_id", F.explode(terms).alias("t")).select("dof_id", "t.master_id", "t.coeff")
