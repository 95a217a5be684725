"""Operators on graphs: components by label exchange, kept in tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.ranks import ranked
from meshwright.operators.ranks import strips as ranked_strips
from meshwright.plans.lineage import Cut, checkpointed


def connected_components(edges: DataFrame, cut: Cut = checkpointed, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every end of an edge; the component is its smallest id.

    Each round a vertex takes the least label among its neighbours' and then the label of
    that label, so chains shorten by half or more. All work is joins and minimum
    aggregations, which combine before the shuffle; only a count reaches the driver.
    Null ends are ignored; loops and repeated edges do no harm.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        step = cut(step, f"step{k}")
        up = step.select(F.col("id").alias("new"), F.col("new").alias("up"))
        labels = cut(step.join(up, "new").select("id", "old", F.least("new", "up").alias("component")), f"labels{k}")
        if labels.where("old != component").limit(1).count() == 0:
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def dual_mesh(cells: DataFrame) -> DataFrame:
    """(vertex, cell): the cells around each vertex, from cells (cell_id, nodes)."""
    return cells.select("cell_id", F.explode("nodes").alias("vertex")).select("vertex", "cell_id").distinct()


def dual_graph(incidence: DataFrame, least: int, include_self: bool = False) -> DataFrame:
    """(cell, neighbour, shared): cells that share at least ``least`` vertices.

    Each pair is made once, by the smaller cell, and mirrored after the count. A vertex with c cells makes
    c*(c-1)/2 pairs, as many as a cell graph needs for ``least`` = 1; joins that such a vertex
    skews are split by adaptive execution, and counts combine before their shuffle.
    """
    other = incidence.select("vertex", F.col("cell_id").alias("neighbour"))
    pairs = incidence.join(other, "vertex").where("cell_id <= neighbour" if include_self else "cell_id < neighbour")
    counted = pairs.groupBy("cell_id", "neighbour").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    sides = F.array(F.struct("cell_id", "neighbour"), F.struct(F.col("neighbour").alias("cell_id"), F.col("cell_id").alias("neighbour")))
    one = F.when(F.col("cell_id") == F.col("neighbour"), F.slice(sides, 1, 1)).otherwise(sides)
    return counted.select(F.explode(one).alias("p"), "shared").select("p.cell_id", "p.neighbour", "shared")


def quotient_graph(graph: DataFrame, parts: DataFrame, include_self: bool = False) -> DataFrame:
    """(part, neighbour_part, links) of a cell graph under parts (cell_id, part)."""
    a = graph.join(parts, "cell_id").join(parts.select(F.col("cell_id").alias("neighbour"), F.col("part").alias("neighbour_part")), "neighbour")
    a = a if include_self else a.where("part != neighbour_part")
    return a.groupBy("part", "neighbour_part").agg(F.count("*").alias("links"))


def masked_degree(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, degree): neighbours inside a cell's own part, of cells that have one."""
    a = graph.join(parts, "cell_id").join(parts.select(F.col("cell_id").alias("neighbour"), F.col("part").alias("other")), "neighbour")
    return a.where("part = other").groupBy(F.col("cell_id").alias("id")).agg(F.count("*").alias("degree"))


def parts_around(incidence: DataFrame, parts: DataFrame) -> DataFrame:
    """(vertex, parts): the sorted parts around each vertex."""
    return incidence.join(parts, "cell_id").groupBy("vertex").agg(F.sort_array(F.collect_set("part")).alias("parts"))


def interface(incidence: DataFrame, parts: DataFrame) -> DataFrame:
    """Vertices that several parts touch."""
    return parts_around(incidence, parts).where(F.size("parts") > 1)


def interface_objects(incidence: DataFrame, parts: DataFrame, cut: Cut = checkpointed) -> DataFrame:
    """(parts, vertices, object_id): interface vertices with equal part lists, numbered in the order of the lists."""
    objects = interface(incidence, parts).groupBy("parts").agg(F.count("*").alias("vertices"))
    return ranked(objects, [F.col("parts")], "object_id", cut)


def boundary_facets(facets: DataFrame) -> DataFrame:
    """Facets with exactly one cell around, from (facet, cell_id)."""
    return facets.groupBy("facet").agg(F.count("*").alias("n"), F.min("cell_id").alias("cell_id")).where("n = 1").select("facet", "cell_id")


def strips(ids: DataFrame, key: str, parts: int, cut: Cut = checkpointed) -> DataFrame:
    """Contiguous strips of nearly equal size in the order of ``key``; part ids from 1."""
    return ranked_strips(ids.select(key), [F.col(key)], parts, "part", cut)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def levels_from(both: DataFrame, seen: DataFrame, cut: Cut) -> DataFrame:
    """(id, level) of all vertices that can be reached from ``seen`` (id, level 0) over edges in both directions."""
    front, k = seen, 0
    while True:
        k += 1
        near = both.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = cut(near.join(seen.select("id"), "id", "left_anti").select("id", F.lit(k).alias("level")), f"front{k}")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def bfs_levels(edges: DataFrame, root: int, cut: Cut = checkpointed) -> DataFrame:
    """(id, level) of all vertices that can be reached from ``root`` over edges (src, dst) in both directions."""
    e = cut(both_ways(edges), "edges")
    return levels_from(e, e.sparkSession.createDataFrame([(root, 0)], "id long, level int"), cut)


def levels_of_components(both: DataFrame, degree: DataFrame, cut: Cut) -> DataFrame:
    """(id, level, component) of all vertices. The root of each component is pseudo-peripheral: from its least
    id on, the vertex of least degree in the last level becomes the root as long as the levels get more."""
    component = cut(connected_components(both, cut), "components")
    best = cut(levels_from(both, component.where("id = component").select("id", F.lit(0).alias("level")), cut).join(component, "id"), "levels")
    while True:
        depth = best.groupBy("component").agg(F.max("level").alias("depth"))
        ends = best.join(depth, "component").where("level = depth").join(degree, "id")
        roots = cut(ends.groupBy("component", "depth").agg(F.min_by("id", F.struct("degree", "id")).alias("id")), "roots")
        new = cut(levels_from(both, roots.select("id", F.lit(0).alias("level")), cut).join(component, "id"), "levels")
        more = new.groupBy("component").agg(F.max("level").alias("depth")).join(roots.select("component", F.col("depth").alias("old")), "component").where("depth > old").select("component")
        more = cut(more, "more")
        if more.isEmpty():
            return best
        best = cut(new.join(more, "component", "left_semi").unionByName(best.join(more, "component", "left_anti").select(*new.columns)), "best")


def reverse_cuthill_mckee(edges: DataFrame, root: int | None = None, cut: Cut = checkpointed) -> DataFrame:
    """(id, rank): vertices by level from the root, then degree, then id, all turned round. Without ``root``
    every component is ordered, one after the other by their least ids; with it, the root's component only.

    The classic order visits neighbours of each vertex in turn; within a level this one orders by
    degree, which gives the same bandwidth bound, the width of two levels."""
    both = cut(both_ways(edges.where("src IS NOT NULL AND dst IS NOT NULL")), "edges")
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    if root is None:
        placed, first = levels_of_components(both, degree, cut).join(degree, "id"), ["component"]
    else:
        placed, first = bfs_levels(edges, root, cut).join(degree, "id", "left"), []
    order = [*map(F.col, first), F.desc("level"), F.desc("degree"), F.desc("id")]
    return ranked(placed, order, "rank", cut).select("id", F.col("rank").cast("int").alias("rank"))


def colouring(edges: DataFrame, cut: Cut = checkpointed) -> DataFrame:
    """(id, colour): in each round the uncoloured vertices whose hash is greatest among their uncoloured
    neighbours take the least colour that no neighbour has. Every round colours one vertex or more, and
    rounds go on until all are coloured; a clique takes as many as it has vertices."""
    both = cut(both_ways(edges).where("src != dst"), "edges")
    state = both.select(F.col("src").alias("id")).distinct().withColumn("colour", F.lit(None).cast("int"))
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    k = 0
    while True:
        state = cut(state, f"state{k}")
        if state.where("colour IS NULL").isEmpty():
            return state
        near = both.join(state.select(F.col("id").alias("dst"), F.col("colour").alias("c")), "dst").groupBy("src").agg(F.collect_set("c").alias("taken"), F.max(F.when(F.col("c").isNull(), rank("dst"))).alias("top"))
        joined = state.join(near, state.id == near.src)
        wins = F.col("colour").isNull() & (F.col("top").isNull() | (rank("id") > F.col("top")))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
        state = joined.select("id", F.when(wins, free).otherwise(F.col("colour")).alias("colour"))
        k += 1
