"""Vectors as rows (idx, val), multi-vectors as (k, idx, val), block vectors as (b, idx, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("idx", F.col("val").alias("y")), "idx").agg(F.coalesce(F.sum(F.col("val") * F.col("y")), F.lit(0.0)).alias("val"))


def block_dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("b", "idx", F.col("val").alias("y")), ["b", "idx"]).agg(F.coalesce(F.sum(F.col("val") * F.col("y")), F.lit(0.0)).alias("val"))


def weighted_dot(x: DataFrame, y: DataFrame, weights: DataFrame) -> DataFrame:
    """Each shared entry counts by its weight (one over the number of its owners)."""
    return dot(x.join(weights.select("idx", F.col("val").alias("w")), "idx").select("idx", (F.col("val") * F.col("w")).alias("val")), y)


def nrm2(x: DataFrame) -> DataFrame:
    return x.agg(F.sqrt(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0))).alias("val"))


def axpby(alpha: float, x: DataFrame, beta: float, y: DataFrame) -> DataFrame:
    """alpha*x + beta*y; an absent entry is 0."""
    return scale(alpha, x).unionByName(scale(beta, y)).groupBy("idx").agg(F.sum("val").alias("val"))


def scale(alpha: float, x: DataFrame) -> DataFrame:
    return x.select("idx", (F.col("val") * alpha).alias("val"))


def hadamard(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("idx", F.col("val").alias("y")), "idx").select("idx", (F.col("val") * F.col("y")).alias("val"))


def invert(x: DataFrame) -> DataFrame:
    """1/x; a zero raises an error, as dividing by it would hide a singular diagonal."""
    return x.select("idx", F.when(F.col("val") == 0, F.raise_error(F.lit("zero entry in a vector to invert"))).otherwise(1 / F.col("val")).alias("val"))


def scatter(x: DataFrame, values: DataFrame, add: bool) -> DataFrame:
    """Put or add (idx, val) rows into x; of repeated rows to put, the one with the greatest ``seq``."""
    if add:
        return axpby(1.0, x, 1.0, values)
    new = values.groupBy("idx").agg(F.max_by("val", "seq").alias("new"))
    return x.join(new, "idx", "full").select("idx", F.coalesce("new", "val").alias("val"))


def multidot(multi: DataFrame, x: DataFrame) -> DataFrame:
    """(k, val): the product of every member with x, in one pass."""
    return multi.join(x.select("idx", F.col("val").alias("x")), "idx").groupBy("k").agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def multiaxpy(y: DataFrame, alpha: float, multi: DataFrame, factors: DataFrame) -> DataFrame:
    """y + alpha * sum of factor_k * v_k, for factors (k, s)."""
    terms = multi.join(factors, "k").select("idx", (F.col("val") * F.col("s") * alpha).alias("val"))
    return y.select("idx", "val").unionByName(terms).groupBy("idx").agg(F.sum("val").alias("val"))
