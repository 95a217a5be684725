"""Linear operators that are written down first and applied later: sums, products and multiples of matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from meshwright.operators.sparse import spmv
from meshwright.operators.vector import axpby, scale


class Operator:
    """``apply`` maps a vector (idx, val) to one; nothing runs until its result is asked for."""

    def __init__(self, apply: Callable[[DataFrame], DataFrame], name: str):
        self.apply, self.name = apply, name

    def __call__(self, x: DataFrame) -> DataFrame:
        return self.apply(x)

    def __add__(self, other: Operator) -> Operator:
        return Operator(lambda x: axpby(1.0, self(x), 1.0, other(x)), f"({self.name} + {other.name})")

    def __sub__(self, other: Operator) -> Operator:
        return Operator(lambda x: axpby(1.0, self(x), -1.0, other(x)), f"({self.name} - {other.name})")

    def __matmul__(self, other: Operator) -> Operator:
        return Operator(lambda x: self(other(x)), f"{self.name} {other.name}")

    def __rmul__(self, factor: float) -> Operator:
        return Operator(lambda x: scale(factor, self(x)), f"{factor:g} {self.name}")

    def __neg__(self) -> Operator:
        return Operator(lambda x: scale(-1.0, self(x)), f"-{self.name}")

    def residual(self, x: DataFrame, rhs: DataFrame) -> DataFrame:
        """A*x - b."""
        return axpby(1.0, self(x), -1.0, rhs)


def of_matrix(matrix: DataFrame, name: str = "A", transposed: bool = False, symmetric: bool = False) -> Operator:
    return Operator(lambda x: spmv(matrix, x, transposed, symmetric), name)


def identity() -> Operator:
    return Operator(lambda x: x.select("idx", "val"), "I")
