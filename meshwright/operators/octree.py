"""Quad- and octrees as rows (level, i, j[, k]): refinement, coarsening, 2:1 balance, Morton order."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators.ranks import prefix_sums
from meshwright.plans.lineage import Cut, checkpointed

AXES = "ijk"


def axes_of(df: DataFrame) -> list[str]:
    return [a for a in AXES if a in df.columns]


def morton(df: DataFrame, top: int = 20) -> Column:
    """The place on the space-filling curve at level ``top``: bits of the coordinates, interleaved."""
    axes = axes_of(df)
    out = F.lit(0).cast("long")
    for bit in range(top):
        for d, a in enumerate(axes):
            at = F.shiftright(F.expr(f"cast(shiftleft(cast({a} as bigint), cast({top} - level as int)) as bigint)"), bit).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(at, bit * len(axes) + d))
    return out


def refine(cells: DataFrame, flag: str = "flag") -> DataFrame:
    """Cells flagged +1 are replaced by their children; one level only."""
    axes = axes_of(cells)
    kids = [F.struct((F.col("level") + 1).alias("level"), *((F.col(a) * 2 + o).alias(a) for a, o in zip(axes, off, strict=True))) for off in itertools.product((0, 1), repeat=len(axes))]
    same = F.array(F.struct("level", *axes))
    return cells.select(F.explode(F.when(F.col(flag) == 1, F.array(*kids)).otherwise(same)).alias("c")).select("c.level", *(f"c.{a}" for a in axes))


def coarsen(cells: DataFrame, flag: str = "flag") -> DataFrame:
    """Families of which every sibling is a leaf flagged -1 become their parent."""
    axes = axes_of(cells)
    parent = [F.floor(F.col(a) / 2).cast("long").alias(f"p{a}") for a in axes]
    marked = cells.select("level", *axes, flag, *parent)
    keys = ["level", *(f"p{a}" for a in axes)]
    whole = marked.where(F.col(flag) == -1).where("level > 0").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") == 2 ** len(axes)).select(*keys)
    up = whole.select((F.col("level") - 1).alias("level"), *(F.col(f"p{a}").alias(a) for a in axes))
    return marked.join(whole, keys, "left_anti").select("level", *axes).unionByName(up)


def neighbours(cells: DataFrame, corners: bool = True) -> DataFrame:
    """Each leaf with the cells of its own size around it, inside the root."""
    axes = axes_of(cells)
    steps = [o for o in itertools.product((-1, 0, 1), repeat=len(axes)) if any(o) and (corners or sum(map(abs, o)) == 1)]
    around = F.array(*(F.struct(*((F.col(a) + s).alias(f"n{a}") for a, s in zip(axes, o, strict=True))) for o in steps))
    out = cells.select("level", *axes, F.explode(around).alias("n")).select("level", *axes, *(f"n.n{a}" for a in axes))
    side = F.pow(F.lit(2.0), F.col("level"))
    inside = F.lit(True)
    for a in axes:
        inside = inside & (F.col(f"n{a}") >= 0) & (F.col(f"n{a}") < side)
    return out.where(inside)


def parents(cells: DataFrame) -> DataFrame:
    axes = axes_of(cells)
    return cells.where("level > 0").select((F.col("level") - 1).alias("level"), *(F.floor(F.col(a) / 2).cast("long").alias(a) for a in axes)).distinct()


def balance(cells: DataFrame, cut: Cut = checkpointed, corners: bool = True) -> DataFrame:
    """2:1 balance: the least refinement in which no leaf is two or more levels above a neighbour.

    A cell with children asks that the cells of its size around it exist, so their parents have
    children too. That is settled level by level, from the deepest one up: one pass for each level."""
    axes = axes_of(cells)
    leaves = cut(cells.select("level", *axes), "leaves")
    deep = int(leaves.agg(F.max("level")).first()[0] or 0)
    # Cells with children by level; leaves of a level and split cells of it ask for split parents.
    split: list[DataFrame | None] = [None] * (deep + 1)
    for level in range(deep, 0, -1):
        here = leaves.where(F.col("level") == level)
        asked = parents(here)
        if split[level] is not None:
            asked = asked.unionByName(parents(split[level])).unionByName(parents(neighbours(split[level], corners).select("level", *(F.col(f"n{a}").alias(a) for a in axes))))
        split[level - 1] = cut(asked.distinct(), f"split{level - 1}")
    kids = [F.struct((F.col("level") + 1).alias("level"), *((F.col(a) * 2 + o).alias(a) for a, o in zip(axes, off, strict=True))) for off in itertools.product((0, 1), repeat=len(axes))]
    out = leaves.where("level = 0") if deep == 0 else None
    for level in range(deep):
        children = split[level].select(F.explode(F.array(*kids)).alias("c")).select("c.level", *(f"c.{a}" for a in axes))
        own = children if split[level + 1] is None else children.join(split[level + 1], ["level", *axes], "left_anti")
        out = own if out is None else out.unionByName(own)
    return cut(out.select("level", *axes), "balanced")


def from_points(points: DataFrame, most: int, deepest: int, cut: Cut = checkpointed) -> DataFrame:
    """Leaves of the tree over points (x, y[, z] in [0, 1)) in which a cell of more than ``most`` points has children, down to level ``deepest``."""
    axes = [a for a, c in zip(AXES, "xyz", strict=True) if c in points.columns]
    at = cut(points.select(*(F.least(F.floor(F.col(c) * 2**deepest), F.lit(2**deepest - 1)).cast("long").alias(a) for a, c in zip(axes, "xyz", strict=False))).groupBy(*axes).agg(F.count("*").alias("n")), "points")
    # Counts of every level, from the deepest one up; each is at most as large as the one below.
    counts, out = [at.withColumn("level", F.lit(deepest))], None
    for level in range(deepest - 1, -1, -1):
        counts.append(cut(counts[-1].groupBy(*(F.floor(F.col(a) / 2).cast("long").alias(a) for a in axes)).agg(F.sum("n").alias("n")).withColumn("level", F.lit(level)), f"count{level}"))
    kids = [F.struct((F.col("level") + 1).alias("level"), *((F.col(a) * 2 + o).alias(a) for a, o in zip(axes, off, strict=True))) for off in itertools.product((0, 1), repeat=len(axes))]
    split = {c: counts[deepest - c].where(F.col("n") > most) for c in range(deepest)}
    root = points.sparkSession.range(1).select(F.lit(0).alias("level"), *(F.lit(0).cast("long").alias(a) for a in axes))
    if deepest == 0 or split[0].isEmpty():
        return root
    for level in range(deepest):
        children = split[level].select(F.explode(F.array(*kids)).alias("c")).select("c.level", *(f"c.{a}" for a in axes))
        own = children if level + 1 >= deepest else children.join(split[level + 1].select("level", *axes), ["level", *axes], "left_anti")
        out = own if out is None else out.unionByName(own)
    return cut(out.select("level", *axes), "tree")


def partition(cells: DataFrame, parts: int, weight: str | None = None, cut: Cut = checkpointed) -> DataFrame:
    """Leaves with a part from 1: equal shares of the weight along the curve."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = cut(prefix_sums(cells.withColumns({"_m": morton(cells), "_w": w}), [F.col("_m"), F.col("level")], "_w", "_s", cut), "curve")
    total = rows.agg(F.sum("_w")).first()[0] or 1.0
    part = F.least(F.floor((F.col("_s") + F.col("_w") / 2) * parts / total).cast("int"), F.lit(parts - 1)) + 1
    return rows.select(*cells.columns, part.alias("part"))
