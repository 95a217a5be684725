"""Hanging unknowns: constraint tables (dof_id, master_id, coeff) and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hanging_values(constraints: DataFrame, values: DataFrame, rhs: DataFrame | None = None) -> DataFrame:
    """(dof_id, value): the combination of the masters' values, plus ``rhs`` (dof_id, value) where there is one."""
    m = values.select(F.col("dof_id").alias("master_id"), "value")
    out = constraints.join(m, "master_id").groupBy("dof_id").agg(F.sum(F.col("coeff") * F.col("value")).alias("value"))
    if rhs is None:
        return out
    return out.unionByName(rhs.select("dof_id", "value")).groupBy("dof_id").agg(F.sum("value").alias("value"))


def expansion(free: DataFrame, constraints: DataFrame) -> DataFrame:
    """K as a matrix (ia, ja, val): the identity on free unknowns and the combinations of hanging ones."""
    eye = free.select(F.col("dof_id").alias("ia"), F.col("dof_id").alias("ja"), F.lit(1.0).alias("val"))
    return eye.unionByName(constraints.select(F.col("dof_id").alias("ia"), F.col("master_id").alias("ja"), F.col("coeff").alias("val")))


def constrained(matrix: DataFrame, rhs: DataFrame, k: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K^T A K and K^T b."""
    from meshwright.operators.sparse import spmv, triple_product

    return triple_product(matrix, k), spmv(k, rhs, transposed=True)


def gathered(cells: DataFrame, values: DataFrame) -> DataFrame:
    """(cell_id, values): a cell's values in the order of its unknowns; free and fixed ones are told apart by kind."""
    at = cells.select("cell_id", F.posexplode("dofs").alias("pos", "dof_id")).join(values.select("dof_id", "value"), "dof_id", "left")
    return at.groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("values"))


def fixed_by_boundary(vefs: DataFrame, conditions: DataFrame) -> DataFrame:
    """(dof_id, component, function): unknowns on boundary sets; of repeated conditions the last (greatest seq) holds."""
    last = conditions.groupBy("set_id", "component").agg(F.max_by("function", "seq").alias("function"))
    return vefs.join(last, "set_id").select("dof_id", "component", "function").distinct()
