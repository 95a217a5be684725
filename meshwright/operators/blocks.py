"""Block vectors (b, idx, val) and block matrices (bi, bj, ia, ja, val): fields are gathered into blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Solve = Callable[[DataFrame], DataFrame]


def field_blocks(spark, blocks: Sequence[int]) -> DataFrame:
    """(field, block), both from 1; ``blocks`` has the block of each field."""
    return spark.createDataFrame([(f, int(b)) for f, b in enumerate(blocks, 1)], "field int, block int")


def insert_fields(entries: DataFrame, layout: DataFrame, coupled: DataFrame | None = None) -> DataFrame:
    """(bi, bj, ia, ja, val): entries (fi, fj, ia, ja, val) summed in their blocks; only pairs of fields in
    ``coupled`` (fi, fj) are inserted, all if not given. The layout has one row for each field."""
    if coupled is not None:
        entries = entries.join(F.broadcast(coupled.select("fi", "fj").distinct()), ["fi", "fj"], "left_semi")
    row = layout.select(F.col("field").alias("fi"), F.col("block").alias("bi"))
    col = layout.select(F.col("field").alias("fj"), F.col("block").alias("bj"))
    placed = entries.join(F.broadcast(row), "fi").join(F.broadcast(col), "fj")
    return placed.groupBy("bi", "bj", "ia", "ja").agg(F.sum("val").alias("val"))


def insert_vector(entries: DataFrame, layout: DataFrame) -> DataFrame:
    """(b, idx, val) from (field, idx, val)."""
    return entries.join(F.broadcast(layout), "field").groupBy(F.col("block").alias("b"), "idx").agg(F.sum("val").alias("val"))


def apply(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """A*x by blocks; absent blocks are 0."""
    v = x.select(F.col("b").alias("bj"), F.col("idx").alias("ja"), F.col("val").alias("x"))
    return matrix.join(v, ["bj", "ja"]).groupBy(F.col("bi").alias("b"), F.col("ia").alias("idx")).agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def axpby(alpha: float, x: DataFrame, beta: float, y: DataFrame) -> DataFrame:
    scaled = lambda s, v: v.select("b", "idx", (F.col("val") * s).alias("val"))
    return scaled(alpha, x).unionByName(scaled(beta, y)).groupBy("b", "idx").agg(F.sum("val").alias("val"))


def gather(x: DataFrame, ids: DataFrame) -> DataFrame:
    """(idx, val) of the wanted ids; absent entries are 0."""
    return ids.select("idx").join(x, "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val"))


def sweep(matrix: DataFrame, rhs: DataFrame, order: Sequence[int], solve: dict[int, Solve], cut) -> DataFrame:
    """One block after the other: solve with its diagonal block for the right side less what earlier blocks of
    the sweep contribute. Ascending order: forward (block lower) sweep; descending: backward (block upper)."""
    done: DataFrame | None = None
    for b in order:
        own = rhs.where(F.col("b") == b).select("idx", "val")
        if done is not None:
            got = apply(matrix.where(F.col("bi") == b), done).select("idx", (-F.col("val")).alias("val"))
            own = own.unionByName(got).groupBy("idx").agg(F.sum("val").alias("val"))
        part = cut(solve[b](own).select(F.lit(b).alias("b"), "idx", "val"), f"block{b}")
        done = part if done is None else done.unionByName(part)
    return done


def lower_upper(matrix: DataFrame, rhs: DataFrame, order: Sequence[int], solve: dict[int, Solve], cut) -> DataFrame:
    """U^-1 D L^-1 applied: a forward sweep, the diagonal blocks, a backward sweep."""
    low = sweep(matrix, rhs, order, solve, cut)
    middle = apply(matrix.where("bi = bj"), low)
    return sweep(matrix, cut(middle, "middle"), list(reversed(order)), solve, cut)


def diagonal_solver(matrix: DataFrame, b: int) -> Solve:
    """Division by the block's diagonal."""
    d = matrix.where((F.col("bi") == b) & (F.col("bj") == b) & (F.col("ia") == F.col("ja"))).select(F.col("ia").alias("idx"), F.col("val").alias("d"))
    return lambda r: r.join(d, "idx").select("idx", (F.col("val") / F.col("d")).alias("val"))
