"""Numbering: every rank has a total order, so ids are the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwright.operators.ranks import prefix_sums, ranked_in, small
from meshwright.plans.lineage import Cut, checkpointed


def offsets(lengths: DataFrame, key: str, length: str, cut: Cut = checkpointed) -> DataFrame:
    """(key, start): the 1-based exclusive prefix sum of the lengths in the order of ``key``."""
    return prefix_sums(lengths.select(key, length), [F.col(key)], length, "_s", cut).select(key, (F.col("_s") + 1).alias("start"))


def local_to_global(owned: DataFrame, part: str, gid: str, cut: Cut = checkpointed) -> DataFrame:
    """(part, lid, gid): local ids from 1 in ascending global order."""
    return ranked_in(owned.select(part, gid), part, [F.col(gid)], "lid", cut).select(part, "lid", gid)


def first_touch(cells: DataFrame, cut: Cut = checkpointed) -> DataFrame:
    """(part, vertex, lid): vertices numbered in the order in which cells (part, cell_id, nodes) first name them."""
    touched = cells.select("part", "cell_id", F.posexplode("nodes").alias("pos", "vertex"))
    first = touched.groupBy("part", "vertex").agg(F.min(F.struct("cell_id", "pos")).alias("at"))
    return ranked_in(first, "part", [F.col("at"), F.col("vertex")], "lid", cut).select("part", "vertex", "lid")


def interior_first(dofs: DataFrame, part: str, dof: str, on_interface: str, cut: Cut = checkpointed) -> DataFrame:
    """(part, dof, new_id): interior dofs first, then those of the interface, each ascending."""
    rows = dofs.select(part, dof, F.col(on_interface).cast("int").alias("_edge"))
    return ranked_in(rows, part, [F.col("_edge"), F.col(dof)], "new_id", cut).select(part, dof, "new_id")


def global_ids(local: DataFrame, part: str, lid: str) -> DataFrame:
    """(part, lid, gid): local ids plus the number of ids in smaller parts."""
    counts = local.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select(part, (F.sum("_n").over(W.orderBy(part)) - F.col("_n")).alias("_o"))
    return local.join(small(before), part).select(part, lid, (F.col(lid) + F.col("_o")).alias("gid"))


def dof_counts(dofs: DataFrame) -> DataFrame:
    """Numbers of free, Dirichlet and hanging dofs, from (dof_id, kind)."""
    return dofs.groupBy("kind").agg(F.countDistinct("dof_id").alias("n"))
