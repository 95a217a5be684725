"""Iterative solvers: the driver holds the recurrences' scalars, vectors stay in DataFrames.

One row per unknown carries all work vectors of a method, so an iteration is one product with
the matrix and one pass over the vectors. Each iteration is cut by a reliable checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.plans.lineage import Cut, checkpointed
from meshwright.operators.sparse import spmv


@dataclass
class Report:
    iterations: int
    residual: float
    converged: bool


class NotConverged(ArithmeticError):
    """A solver stopped above its tolerance, so its vector is not the solution."""


def solution(solved: tuple[DataFrame, Report]) -> DataFrame:
    """The vector of a solver's result; an error if it did not converge."""
    x, report = solved
    if not report.converged:
        raise NotConverged(f"no convergence: residual {report.residual:g} after {report.iterations} iterations")
    return x


def step_limit(unknowns: float) -> int:
    """Conjugate gradients end after as many steps as there are unknowns, but for rounding, which may cost several times as many."""
    return max(500, 10 * int(unknowns))


def scalars(df: DataFrame, **sums) -> list[float]:
    return [float(x or 0.0) for x in df.agg(*(F.sum(e).alias(k) for k, e in sums.items())).first()]


def inverse_diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.where("ia = ja").select(F.col("ia").alias("idx"), F.try_divide(F.lit(1.0), F.col("val")).alias("d"))


#: What the norm of the residual (res) or of the step (delta) is compared with, by name of the criterion.
CRITERIA = (
    "res_nrmgiven_rhs_nrmgiven", "res_nrmgiven_res_nrmgiven", "delta_rhs", "delta_delta", "res_res", "res_rhs", "delta_rhs_and_res_res", "delta_rhs_and_res_rhs",
    "delta_delta_and_res_res", "delta_delta_and_res_rhs",
)


@dataclass
class Norms:
    """What a criterion may look at; ``given`` is the norm of the preconditioned residual, first ones are those of step 0 and 1."""

    rhs: float
    residual: float
    first_residual: float
    given: float
    first_given: float
    given_rhs: float
    step: float | None = None
    first_step: float | None = None


def met(criterion: str, n: Norms, relative: float, absolute: float) -> bool:
    """Whether an iteration may stop. A step has no norm before the first one is made, so it is not small yet."""
    if criterion not in CRITERIA:
        raise ValueError(f"no criterion is called {criterion}; there are {CRITERIA}")
    single = {
        "res_nrmgiven_rhs_nrmgiven": lambda: n.given <= relative * n.given_rhs + absolute,
        "res_nrmgiven_res_nrmgiven": lambda: n.given <= relative * n.first_given + absolute,
        "delta_rhs": lambda: n.step is not None and n.step <= relative * n.rhs + absolute,
        "delta_delta": lambda: n.step is not None and n.first_step is not None and n.step <= relative * n.first_step + absolute,
        "res_res": lambda: n.residual <= relative * n.first_residual + absolute,
        "res_rhs": lambda: n.residual <= relative * n.rhs + absolute,
    }
    return all(single[c]() for c in criterion.split("_and_"))


def conjugate_gradients(
    matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-10, most: int | None = None, jacobi: bool = True, cut: Cut = checkpointed,
    criterion: str = "res_rhs", absolute: float = 0.0, inexact: bool = False,
) -> tuple[DataFrame, Report]:
    """(idx, val) for a symmetric positive matrix. Stops by ``criterion`` (at once if the right side is 0), or after
    ``most`` steps, which follow the number of unknowns if not given; ``solution`` refuses what did
    not converge. A breakdown (p, A p) = 0 takes a step of 0. ``inexact``: the direction's factor takes the change
    of the residual, which allows a preconditioner that is not quite the same in each step."""
    matrix = cut(matrix, "matrix")
    d = inverse_diagonal(matrix)
    w = rhs.join(d, "idx", "left").select("idx", F.lit(0.0).alias("x"), F.col("val").alias("r"), (F.coalesce("d", F.lit(1.0)) if jacobi else F.lit(1.0)).alias("d"))
    w = cut(w.withColumn("p", F.col("r") * F.col("d")), "start")
    sums = {"r": F.col("r") * F.col("r"), "z": F.col("r") * F.col("r") * F.col("d"), "g": F.col("r") * F.col("r") * F.col("d") * F.col("d")}
    r2, rz, g2, unknowns = scalars(w, **sums, n=F.lit(1))
    norms = Norms(r2**0.5, r2**0.5, r2**0.5, g2**0.5, g2**0.5, g2**0.5)
    most = step_limit(unknowns) if most is None else most
    k, done = 0, r2 == 0 or met(criterion, norms, tolerance, absolute)
    while k < most and not done:
        k += 1
        ap = spmv(matrix, w.select("idx", F.col("p").alias("val"))).select("idx", F.col("val").alias("ap"))
        w = cut(w.drop("ap").join(ap, "idx", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))), f"product{k}")
        pap, p2 = scalars(w, a=F.col("p") * F.col("ap"), p=F.col("p") * F.col("p"))
        alpha = rz / pap if pap else 0.0
        w = w.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("ap"), "old": F.col("r")})
        r2, new, g2, cross = scalars(w, **sums, c=F.col("old") * F.col("r") * F.col("d"))
        norms.residual, norms.given, norms.step = r2**0.5, g2**0.5, abs(alpha) * p2**0.5
        norms.first_step = norms.step if norms.first_step is None else norms.first_step
        beta = ((new - cross) if inexact else new) / rz if rz else 0.0
        w = w.drop("old").withColumn("p", F.col("r") * F.col("d") + beta * F.col("p"))
        rz = new
        done = r2 == 0 or met(criterion, norms, tolerance, absolute)
    return w.select("idx", F.col("x").alias("val")), Report(k, r2**0.5, done)


def inexact_conjugate_gradients(matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-10, most: int | None = None, cut: Cut = checkpointed) -> tuple[DataFrame, Report]:
    return conjugate_gradients(matrix, rhs, tolerance, most, cut=cut, inexact=True)


def richardson(matrix: DataFrame, rhs: DataFrame, relaxation: float = 1.0, tolerance: float = 1e-8, most: int = 200, cut: Cut = checkpointed) -> tuple[DataFrame, Report]:
    """Relaxed Richardson with the inverse diagonal."""
    matrix = cut(matrix, "matrix")
    w = cut(rhs.join(inverse_diagonal(matrix), "idx", "left").select("idx", F.lit(0.0).alias("x"), F.col("val").alias("b"), F.coalesce("d", F.lit(1.0)).alias("d"), F.col("val").alias("r")), "start")
    (norm0,) = scalars(w, b=F.col("b") * F.col("b"))
    residual, k = norm0, 0
    while k < most and residual > (tolerance**2) * norm0:
        k += 1
        w = w.withColumn("x", F.col("x") + relaxation * F.col("d") * F.col("r"))
        ax = spmv(matrix, w.select("idx", F.col("x").alias("val"))).select("idx", F.col("val").alias("ax"))
        w = cut(w.drop("ax").join(ax, "idx", "left").withColumn("r", F.col("b") - F.coalesce("ax", F.lit(0.0))).drop("ax"), f"step{k}")
        (residual,) = scalars(w, r=F.col("r") * F.col("r"))
    return w.select("idx", F.col("x").alias("val")), Report(k, residual**0.5, residual <= (tolerance**2) * norm0)


Precondition = Callable[[DataFrame], DataFrame]


def jacobi(matrix: DataFrame) -> Precondition:
    """Division by the diagonal; entries without one stay as they are."""
    d = inverse_diagonal(matrix)
    return lambda v: v.join(d, "idx", "left").select("idx", (F.col("val") * F.coalesce("d", F.lit(1.0))).alias("val"))


def arnoldi(matrix: DataFrame, rhs: DataFrame, restart: int, tolerance: float, most: int, cut: Cut, precondition: Precondition | None, side: str, orthogonal: bool) -> tuple[DataFrame, Report]:
    """Restarted Krylov methods on one basis. The basis is a column array, so all products with a new vector
    are one aggregation; the small problem is the driver's. ``side``: left, right or flexible (the
    preconditioned vectors are kept, so it may change from step to step); ``orthogonal``: the residual
    is orthogonal to the basis (FOM) instead of least (GMRES)."""
    import numpy as np

    matrix = cut(matrix, "matrix")
    m = precondition or jacobi(matrix)
    base = cut(rhs.select("idx", F.lit(0.0).alias("x"), F.col("val").alias("b")), "start")

    def joined(w: DataFrame, v: DataFrame, name: str) -> DataFrame:
        return w.join(v.select("idx", F.col("val").alias(name)), "idx", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))

    def prepared(v: DataFrame) -> DataFrame:
        return m(v) if side == "left" else v

    first = cut(prepared(rhs.select("idx", "val")), "first")
    (norm0,) = scalars(first, b=F.col("val") * F.col("val"))
    total, residual, goal = 0, norm0**0.5, tolerance * norm0**0.5
    while total < most and residual > goal:
        ax = spmv(matrix, base.select("idx", F.col("x").alias("val")))
        r = joined(base, ax, "ax").select("idx", (F.col("b") - F.col("ax")).alias("val"))
        w = cut(joined(base, prepared(r), "v"), f"restart{total}")
        beta = scalars(w, r=F.col("v") * F.col("v"))[0] ** 0.5
        if beta <= goal:
            residual = beta
            break
        w = w.select("idx", "x", "b", F.array(F.col("v") / beta).alias("basis"), F.array().cast("array<double>").alias("moves"))
        h, y = np.zeros((restart + 1, restart)), np.zeros(0)
        for j in range(restart):
            total += 1
            v = w.select("idx", F.get("basis", j).alias("val"))
            z = v if side == "left" else cut(m(v), f"prepared{total}")
            av = prepared(spmv(matrix, z))
            w = joined(w, av, "av")
            w = cut((joined(w, z, "z").withColumn("moves", F.array_append("moves", F.col("z"))).drop("z") if side == "flexible" else w), f"product{total}")
            h[: j + 1, j] = scalars(w, **{f"h{i}": F.get("basis", i) * F.col("av") for i in range(j + 1)})
            left = F.col("av")
            for i in range(j + 1):
                left = left - float(h[i, j]) * F.get("basis", i)
            w = cut(w.withColumn("av", left), f"orthogonal{total}")
            h[j + 1, j] = scalars(w, n=F.col("av") * F.col("av"))[0] ** 0.5
            e = np.zeros(j + 2)
            e[0] = beta
            if orthogonal:
                y = np.linalg.lstsq(h[: j + 1, : j + 1], e[: j + 1], rcond=None)[0]
                residual = float(abs(h[j + 1, j] * y[j]))
            else:
                y = np.linalg.lstsq(h[: j + 2, : j + 1], e, rcond=None)[0]
                residual = float(np.linalg.norm(e - h[: j + 2, : j + 1] @ y))
            if residual <= goal or total >= most or h[j + 1, j] < 1e-14 * beta:
                break
            w = w.select("idx", "x", "b", F.array_append("basis", F.col("av") / float(h[j + 1, j])).alias("basis"), "moves")
        name = "moves" if side == "flexible" else "basis"
        step = w.select("idx", sum((float(c) * F.get(name, i) for i, c in enumerate(y)), F.lit(0.0)).alias("val"))
        step = m(step) if side == "right" else step
        base = cut(joined(w, step, "s").select("idx", (F.col("x") + F.col("s")).alias("x"), "b"), f"updated{total}")
    return base.select("idx", F.col("x").alias("val")), Report(total, residual, residual <= goal)


def gmres(matrix: DataFrame, rhs: DataFrame, restart: int = 30, tolerance: float = 1e-8, most: int = 300, cut: Cut = checkpointed, precondition: Precondition | None = None) -> tuple[DataFrame, Report]:
    """Restarted GMRES, preconditioned from the right, by the inverse diagonal unless given."""
    return arnoldi(matrix, rhs, restart, tolerance, most, cut, precondition, "right", False)


def left_gmres(matrix: DataFrame, rhs: DataFrame, restart: int = 30, tolerance: float = 1e-8, most: int = 300, cut: Cut = checkpointed, precondition: Precondition | None = None) -> tuple[DataFrame, Report]:
    """Restarted GMRES, preconditioned from the left: the preconditioned residual is made small."""
    return arnoldi(matrix, rhs, restart, tolerance, most, cut, precondition, "left", False)


def flexible_gmres(matrix: DataFrame, rhs: DataFrame, restart: int = 30, tolerance: float = 1e-8, most: int = 300, cut: Cut = checkpointed, precondition: Precondition | None = None) -> tuple[DataFrame, Report]:
    """Restarted GMRES that allows another preconditioner in each step."""
    return arnoldi(matrix, rhs, restart, tolerance, most, cut, precondition, "flexible", False)


def full_orthogonalization(matrix: DataFrame, rhs: DataFrame, restart: int = 30, tolerance: float = 1e-8, most: int = 300, cut: Cut = checkpointed, precondition: Precondition | None = None) -> tuple[DataFrame, Report]:
    """Restarted FOM, preconditioned from the left."""
    return arnoldi(matrix, rhs, restart, tolerance, most, cut, precondition, "left", True)


def minres(matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-8, most: int = 300, cut: Cut = checkpointed) -> tuple[DataFrame, Report]:
    """MINRES for symmetric, also indefinite, matrices: a three-term recurrence, so two old vectors each are kept."""
    matrix = cut(matrix, "matrix")
    (b2,) = scalars(rhs, b=F.col("val") * F.col("val"))
    beta = norm0 = b2**0.5
    zero = [F.lit(0.0).alias(c) for c in ("x", "v1", "w", "w1")]
    if not norm0:
        return rhs.select("idx", F.lit(0.0).alias("val")), Report(0, 0.0, True)
    w = cut(rhs.select("idx", (F.col("val") / norm0).alias("v"), *zero), "start")
    c = c1 = 1.0
    s = s1 = 0.0
    eta, k = beta, 0
    while k < most and abs(eta) > tolerance * norm0:
        k += 1
        av = spmv(matrix, w.select("idx", F.col("v").alias("val"))).select("idx", F.col("val").alias("av"))
        w = cut(w.join(av, "idx", "left").withColumn("av", F.coalesce("av", F.lit(0.0))), f"product{k}")
        (alpha,) = scalars(w, a=F.col("v") * F.col("av"))
        new = F.col("av") - alpha * F.col("v") - (beta if k > 1 else 0.0) * F.col("v1")
        (n2,) = scalars(w, n=new * new)
        beta1, old = n2**0.5, beta if k > 1 else 0.0
        delta = c * alpha - c1 * s * old
        rho1 = (delta * delta + n2) ** 0.5
        rho2, rho3 = s * alpha + c1 * c * old, s1 * old
        if not rho1:
            break
        c1, s1, c, s = c, s, delta / rho1, beta1 / rho1
        step = (F.col("v") - rho3 * F.col("w1") - rho2 * F.col("w")) / rho1
        w = w.select("idx", (F.col("x") + c * eta * step).alias("x"), (new / beta1 if beta1 else F.lit(0.0)).alias("v"), F.col("v").alias("v1"), step.alias("w"), F.col("w").alias("w1"))
        eta, beta = -s * eta, beta1
    return w.select("idx", F.col("x").alias("val")), Report(k, abs(eta), abs(eta) <= tolerance * norm0)


#: When Newton stops: the residual's norm, the step against the solution, the residual against the first one, or both of these.
NEWTON_CRITERIA = ("abs_res", "rel_inc", "rel_res", "rel_inc_and_rel_res")


def newton(residual, tangent_solve, start: DataFrame, tolerance: float = 1e-10, most: int = 20, cut: Cut = checkpointed, criterion: str = "abs_res") -> tuple[DataFrame, Report]:
    """Newton: ``residual(u)`` gives (idx, val), ``tangent_solve(u, r)`` the correction (idx, val) for the right side r."""
    if criterion not in NEWTON_CRITERIA:
        raise ValueError(f"no criterion is called {criterion}; there are {NEWTON_CRITERIA}")
    u, k, first, moved = cut(start, "newton0"), 0, None, False
    while True:
        r = cut(residual(u), f"residual{k}")
        now = scalars(r, n=F.col("val") * F.col("val"))[0] ** 0.5
        first = now if first is None else first
        small = {"abs_res": now <= tolerance, "rel_inc": moved, "rel_res": now <= tolerance * first, "rel_inc_and_rel_res": moved and now <= tolerance * first}[criterion]
        if now == 0 or small or k >= most:
            return u, Report(k, now, now == 0 or small)
        k += 1
        step = cut(tangent_solve(u, r.select("idx", (-F.col("val")).alias("val"))), f"step{k}")
        (s2,), (u2,) = scalars(step, n=F.col("val") * F.col("val")), scalars(u, n=F.col("val") * F.col("val"))
        moved = s2**0.5 <= tolerance * u2**0.5
        u = cut(u.select("idx", "val").unionByName(step.select("idx", "val")).groupBy("idx").agg(F.sum("val").alias("val")), f"newton{k}")


Solver = Callable[..., tuple[DataFrame, Report]]
#: Solvers by name; ``register`` adds a user's own.
SOLVERS: dict[str, Solver] = {
    "cg": conjugate_gradients, "icg": inexact_conjugate_gradients, "richardson": richardson, "rgmres": gmres, "lgmres": left_gmres, "fgmres": flexible_gmres,
    "lfom": full_orthogonalization, "minres": minres,
}


def register(name: str, solver: Solver) -> None:
    SOLVERS[name] = solver


def solve(name: str, matrix: DataFrame, rhs: DataFrame, **options) -> tuple[DataFrame, Report]:
    if name not in SOLVERS:
        raise ValueError(f"no solver is called {name}; there are {sorted(SOLVERS)}")
    return SOLVERS[name](matrix, rhs, **options)
