"""Values that several parts share: who owns them, who sends what to whom, and sums over all copies.

``held`` is (part, gid): what each part has. The owner of a gid is the least part that has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def owners(held: DataFrame) -> DataFrame:
    """(gid, owner, copies)."""
    return held.distinct().groupBy("gid").agg(F.min("part").alias("owner"), F.count("*").alias("copies"))


def import_plan(held: DataFrame) -> DataFrame:
    """(part, gid, owner, copies, weight): weight is one over the number of copies, so weighted sums count every gid once."""
    return held.distinct().join(owners(held), "gid").select("part", "gid", "owner", "copies", (1.0 / F.col("copies")).alias("weight"))


def send_lists(held: DataFrame) -> DataFrame:
    """(sender, receiver, gid): every owner sends its shared values to the parts that hold copies."""
    return import_plan(held).where("part != owner").select(F.col("owner").alias("sender"), F.col("part").alias("receiver"), "gid")


def neighbours(held: DataFrame) -> DataFrame:
    """(part, neighbour, shared): parts that hold common gids, in both directions."""
    h = held.distinct()
    pairs = h.join(h.select(F.col("part").alias("neighbour"), "gid"), "gid").where("part < neighbour")
    counted = pairs.groupBy("part", "neighbour").agg(F.count("*").alias("shared"))
    return counted.unionByName(counted.select(F.col("neighbour").alias("part"), F.col("part").alias("neighbour"), "shared"))


def is_local(owner: Column, part: Column) -> Column:
    return owner == part


def is_ghost(owner: Column, part: Column) -> Column:
    return owner != part


def assembled(values: DataFrame) -> DataFrame:
    """(part, gid, val): every copy gets the sum of all parts' contributions."""
    sums = values.groupBy("gid").agg(F.sum("val").alias("total"))
    return values.select("part", "gid").distinct().join(sums, "gid").select("part", "gid", F.col("total").alias("val"))


def refreshed(values: DataFrame) -> DataFrame:
    """(part, gid, val): every copy gets its owner's value."""
    own = values.groupBy("gid").agg(F.min_by("val", "part").alias("own"))
    return values.join(own, "gid").select("part", "gid", F.col("own").alias("val"))


def zero_ghosts(values: DataFrame) -> DataFrame:
    """(part, gid, val): 0 where the part does not own the gid."""
    who = values.groupBy("gid").agg(F.min("part").alias("owner"))
    return values.join(who, "gid").select("part", "gid", F.when(F.col("owner") == F.col("part"), F.col("val")).otherwise(F.lit(0.0)).alias("val"))


def parted_dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """The product of two vectors whose shared entries are held by several parts, each counted once."""
    w = import_plan(x.select("part", "gid")).select("part", "gid", "weight")
    both = x.join(y.select("part", "gid", F.col("val").alias("y")), ["part", "gid"]).join(w, ["part", "gid"])
    return both.agg(F.coalesce(F.sum(F.col("val") * F.col("y") * F.col("weight")), F.lit(0.0)).alias("val"))


def diagonal_weights(parted: DataFrame) -> DataFrame:
    """(part, gid, weight): a part's share of the assembled diagonal, from sub-assembled entries (part, ia, ja, val)."""
    d = parted.where("ia = ja").groupBy("part", F.col("ia").alias("gid")).agg(F.sum("val").alias("own"))
    total = d.groupBy("gid").agg(F.sum("own").alias("total"))
    return d.join(total, "gid").select("part", "gid", F.try_divide("own", "total").alias("weight"))


def parted_spmv(parted: DataFrame, x: DataFrame) -> DataFrame:
    """(gid, val) of a sub-assembled matrix (part, ia, ja, val): local products, then the sum over parts."""
    v = x.select(F.col("gid").alias("ja"), F.col("val").alias("x"))
    local = parted.join(v, "ja").groupBy("part", "ia").agg(F.sum(F.col("val") * F.col("x")).alias("y"))
    return local.groupBy(F.col("ia").alias("gid")).agg(F.sum("y").alias("val"))


def submesh(cells: DataFrame, parts: DataFrame, part: int, cut=None) -> dict[str, DataFrame]:
    """``cells`` (cell_id, gid, nodes) of one part with local ids, and ``vertices`` (vertex_id, gid)."""
    from meshwright.operators.ranks import ranked
    from meshwright.plans.lineage import checkpointed

    cut = cut or checkpointed
    own = cells.join(parts.where(F.col("part") == part).select("cell_id"), "cell_id", "left_semi").select(F.col("cell_id").alias("gid"), "nodes")
    local = cut(ranked(own, [F.col("gid")], "cell_id", cut), "cells")
    at = local.select("cell_id", F.posexplode("nodes").alias("pos", "gid"))
    vertices = cut(ranked(at.select("gid").distinct(), [F.col("gid")], "vertex_id", cut), "vertices")
    nodes = at.join(vertices, "gid").groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "vertex_id"))), lambda s: s["vertex_id"]).alias("nodes"))
    return {"cells": local.select("cell_id", "gid").join(nodes, "cell_id"), "vertices": vertices.select("vertex_id", "gid")}
