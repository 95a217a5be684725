"""Diagonally implicit Runge-Kutta steps for M u' + A u = f, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.plans.lineage import Cut, checkpointed
from meshwright.operators.sparse import add, spmv
from meshwright.operators.vector import axpby
from meshwright.plans.solvers import conjugate_gradients, solution

G = 1 - 0.5**0.5
#: The constants of the IMEX pairs of two stages and of order three.
I2, I3 = 1 + 0.5**0.5, (3 + 3**0.5) / 6
D21, D22 = -2 * 2**0.5 / 3, 1 - 1 / (2 * I2)
#: Name -> (A, b, c) of each scheme.
SCHEMES = {
    "backward_euler": ([[1.0]], [1.0], [1.0]),
    "forward_euler": ([[0.0]], [1.0], [0.0]),
    "trapezoidal": ([[0.0, 0.0], [0.5, 0.5]], [0.5, 0.5], [0.0, 1.0]),
    "midpoint": ([[0.5]], [1.0], [0.5]),
    "sdirk_2": ([[G, 0.0], [1 - G, G]], [1 - G, G], [G, 1.0]),
    "runge_kutta_4": ([[0.0] * 4, [0.5, 0, 0, 0], [0, 0.5, 0, 0], [0, 0, 1.0, 0]], [1 / 6, 1 / 3, 1 / 3, 1 / 6], [0.0, 0.5, 0.5, 1.0]),
    "midpoint_explicit": ([[0.0, 0.0], [0.5, 0.0]], [0.0, 1.0], [0.0, 0.5]),
    "runge_kutta_3": ([[0.0] * 3, [0.5, 0, 0], [-1.0, 2.0, 0]], [1 / 6, 2 / 3, 1 / 6], [0.0, 0.5, 1.0]),
    "runge_kutta_4_3_8": ([[0.0] * 4, [1 / 3, 0, 0, 0], [-1 / 3, 1.0, 0, 0], [1.0, -1.0, 1.0, 0]], [1 / 8, 3 / 8, 3 / 8, 1 / 8], [0.0, 1 / 3, 2 / 3, 1.0]),
    "imex_rk_2_2_1_implicit": ([[I2, 0.0], [1 - I2, I2]], [1 - I2, I2], [I2, 1.0]),
    "imex_rk_2_2_1_explicit": ([[0.0] * 3, [I2, 0, 0], [D21, 1 - D21, 0]], [0.0, 1 - I2, I2], [0.0, I2, 1.0]),
    "imex_rk_2_2_2_implicit": ([[I2, 0.0], [1 - I2, I2]], [1 - I2, I2], [I2, 1.0]),
    "imex_rk_2_2_2_explicit": ([[0.0] * 3, [I2, 0, 0], [D22, 1 - D22, 0]], [0.0, 1 - I2, I2], [0.0, I2, 1.0]),
    "imex_rk_2_3_implicit": ([[I3, 0.0], [1 - 2 * I3, I3]], [0.5, 0.5], [I3, 1 - I3]),
    "imex_rk_2_3_explicit": ([[0.0] * 3, [I3, 0, 0], [I3 - 1, 2 * (1 - I3), 0]], [0.0, 0.5, 0.5], [0.0, I3, 1 - I3]),
    "imex_rk_4_3_implicit": ([[0.5, 0, 0, 0], [1 / 6, 0.5, 0, 0], [-0.5, 0.5, 0.5, 0], [1.5, -1.5, 0.5, 0.5]], [1.5, -1.5, 0.5, 0.5], [0.5, 2 / 3, 0.5, 1.0]),
    "imex_rk_4_3_explicit": (
        [[0.0] * 5, [0.5, 0, 0, 0, 0], [11 / 18, 1 / 18, 0, 0, 0], [5 / 6, -5 / 6, 0.5, 0, 0], [0.25, 1.75, 0.75, -1.75, 0]], [0.25, 1.75, 0.75, -1.75, 0.0], [0.0, 0.5, 2 / 3, 0.5, 1.0],
    ),
}


def finished(now: float, end: float, dt: float) -> bool:
    return end - now <= dt * 1e-8


def step(mass: DataFrame, stiffness: DataFrame, u: DataFrame, dt: float, scheme: str, cut: Cut = checkpointed, tolerance: float = 1e-12) -> DataFrame:
    """One step: each stage solves (M + dt*a_ii*A) v_i = -A (u + dt * sum a_ij v_j); NotConverged if one stops above ``tolerance``."""
    a, b, _ = SCHEMES[scheme]
    stages: list[DataFrame] = []
    for i, row in enumerate(a):
        base = u
        for j in range(i):
            if row[j]:
                base = axpby(1.0, base, dt * row[j], stages[j])
        right = spmv(stiffness, base).select("idx", (-F.col("val")).alias("val"))
        right = u.select("idx").join(right, "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val"))
        matrix = add(mass, stiffness, 1.0, dt * row[i]) if row[i] else mass
        stages.append(cut(solution(conjugate_gradients(matrix, cut(right, f"right{i}"), tolerance, cut=cut)), f"stage{i}"))
    out = u
    for w, v in zip(b, stages, strict=True):
        out = axpby(1.0, out, dt * w, v)
    return cut(out, "state")


def integrate(mass: DataFrame, stiffness: DataFrame, u: DataFrame, start: float, end: float, dt: float, scheme: str, cut: Cut = checkpointed) -> DataFrame:
    now = start
    while not finished(now, end, dt):
        h = min(dt, end - now)
        u, now = step(mass, stiffness, u, h, scheme, cut), now + h
    return u
