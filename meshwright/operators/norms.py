"""Error norms, marking for refinement and effectivities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAMES = ("mean", "l1", "l2", "lp", "linfty", "h1_seminorm", "h1", "w1p_seminorm", "w1p", "w1infty_seminorm", "w1infty", "hdiv_seminorm", "hcurl_seminorm")


def norm(name: str, weight: str = "w", value: str = "e", gradient: tuple[str, ...] = (), p: float = 2.0, compat: bool = False) -> Column:
    """An aggregate over quadrature points: weight (with the determinant), error and its gradient's columns.

    The mean is a signed integral; W1-infinity adds the two maxima. ``compat`` raises p-norms to
    the power p again instead of taking the root."""
    w, e = F.col(weight), F.col(value)
    root = (lambda s: F.pow(s, F.lit(p))) if compat else (lambda s: F.pow(s, F.lit(1.0 / p)))
    grads = [F.col(g) for g in gradient]
    square = sum((g * g for g in grads), F.lit(0.0))
    power = sum((F.pow(F.abs(g), F.lit(p)) for g in grads), F.lit(0.0))
    top = F.max(F.greatest(*(F.abs(g) for g in grads)) if len(grads) > 1 else F.abs(grads[0])) if grads else F.lit(0.0)
    return {
        "mean": lambda: F.sum(w * e), "l1": lambda: F.sum(w * F.abs(e)), "l2": lambda: F.sqrt(F.sum(w * e * e)), "lp": lambda: root(F.sum(w * F.pow(F.abs(e), F.lit(p)))),
        "linfty": lambda: F.max(F.abs(e)), "h1_seminorm": lambda: F.sqrt(F.sum(w * square)), "h1": lambda: F.sqrt(F.sum(w * (e * e + square))),
        "w1p_seminorm": lambda: root(F.sum(w * power)), "w1p": lambda: root(F.sum(w * (F.pow(F.abs(e), F.lit(p)) + power))),
        "w1infty_seminorm": lambda: top, "w1infty": lambda: F.max(F.abs(e)) + top,
        "hdiv_seminorm": lambda: F.sqrt(F.sum(w * sum(grads, F.lit(0.0)) * sum(grads, F.lit(0.0)))), "hcurl_seminorm": lambda: F.sqrt(F.sum(w * square)),
    }[name]()


def fixed_fraction(estimates: DataFrame, refine: float, coarsen: float, cell: str = "cell_id", estimate: str = "est") -> DataFrame:
    """(cell, flag): +1 for the ``refine`` share of cells with the greatest estimates, -1 for the ``coarsen`` share with the least.

    Exact: cells are ranked by (estimate, cell). Ranks come from counts by value range and a
    window inside each range."""
    n = estimates.count()
    cuts = sorted(set(estimates.approxQuantile(estimate, [k / 16 for k in range(1, 16)], 0.01))) if n else []
    b = sum(((F.col(estimate) > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    marked = estimates.select(cell, estimate, b.alias("_b"))
    before = marked.groupBy("_b").agg(F.count("*").alias("_t")).select("_b", (F.sum("_t").over(W.orderBy("_b")) - F.col("_t")).alias("_o"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy(estimate, cell))
    ranked = marked.withColumn("_r", rank).join(F.broadcast(before), "_b").withColumn("_r", F.col("_r") + F.col("_o"))
    flag = F.when(F.col("_r") > n - int(n * refine), 1).when(F.col("_r") <= int(n * coarsen), -1).otherwise(0)
    return ranked.select(cell, flag.alias("flag"))


def fraction_by_bisection(estimates: DataFrame, refine: float, coarsen: float, estimate: str = "est", rounds: int = 25) -> tuple[float, float]:
    """Thresholds (refine above, coarsen below) by geometric bisection; each round counts once."""
    low, high, n = estimates.agg(F.min(estimate), F.max(estimate), F.count("*")).first()
    if not n:
        return 0.0, 0.0

    def search(want: float, above: bool) -> float:
        a, b = max(low * 0.99, 1e-10 * high), high * 1.01
        for _ in range(rounds):
            mid = (a * b) ** 0.5
            got = estimates.where(F.col(estimate) > mid if above else F.col(estimate) < mid).count()
            if got == int(want * n):
                break
            if (got > want * n) == above:
                a = mid
            else:
                b = mid
        return mid

    return search(refine, True), search(coarsen, False)


def li_bettess(estimates: DataFrame, objective: float, dims: int, order: int, cell: str = "cell_id", estimate: str = "est", compat: bool = False) -> DataFrame:
    """(cell, flag): refine where the estimate is above the bound of the optimal mesh; never coarsens."""
    power = dims / (2.0 * order + dims)
    exponent = float(-dims // order if -dims % order == 0 or not compat else -(dims // order)) if compat else -dims / order
    total = estimates.agg(F.sum(F.pow(F.col(estimate), F.lit(2 * power))).alias("s"))
    cells = F.pow(F.lit(objective), F.lit(exponent)) * F.pow(F.col("s"), F.lit((2.0 * order + dims) / (2.0 * order)))
    bound = F.lit(objective) / F.sqrt(cells)
    return estimates.crossJoin(F.broadcast(total)).select(cell, F.when(F.col(estimate) > bound, 1).otherwise(0).alias("flag"))


def effectivity(estimates: DataFrame, errors: DataFrame, cell: str = "cell_id") -> DataFrame:
    """(cell, effectivity) from squared estimates and squared errors; null where the error is 0."""
    e = errors.select(cell, F.col("sq_err"))
    return estimates.join(e, cell).select(cell, F.try_divide(F.sqrt("sq_est"), F.sqrt("sq_err")).alias("effectivity"))


def global_effectivity(estimates: DataFrame, errors: DataFrame, cell: str = "cell_id") -> DataFrame:
    both = estimates.join(errors.select(cell, "sq_err"), cell)
    return both.agg(F.try_divide(F.sqrt(F.sum("sq_est")), F.sqrt(F.sum("sq_err"))).alias("effectivity"))


def vector_norms(value: str = "e", weight: str = "w", p: float = 2.0) -> dict[str, Column]:
    """Aggregates over points with an array column: mean by component summed in length, L1, L2, Lp of the lengths, and the
    greatest component."""
    length = F.sqrt(F.aggregate(value, F.lit(0.0), lambda a, x: a + x * x))
    w = F.col(weight)
    return {
        "l1": F.sum(w * F.aggregate(value, F.lit(0.0), lambda a, x: a + F.abs(x))), "l2": F.sqrt(F.sum(w * length * length)),
        "lp": F.pow(F.sum(w * F.aggregate(value, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p)),
        "linfty": F.max(F.array_max(F.transform(value, lambda x: F.abs(x)))),
    }


def tensor_norms(value: str = "e", weight: str = "w") -> dict[str, Column]:
    """The same for an array of rows: mean (of all entries), L1, L2 and the greatest entry."""
    flat, w = F.flatten(value), F.col(weight)
    return {
        "mean": F.sum(w * F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)), "l1": F.sum(w * F.aggregate(flat, F.lit(0.0), lambda a, x: a + F.abs(x))),
        "l2": F.sqrt(F.sum(w * F.aggregate(flat, F.lit(0.0), lambda a, x: a + x * x))), "linfty": F.max(F.array_max(F.transform(flat, lambda x: F.abs(x)))),
    }


def uniform(cells: DataFrame, flag: int = 1) -> DataFrame:
    """(cell_id, flag): all cells alike."""
    return cells.select("cell_id", F.lit(flag).alias("flag"))


def objective_reached(estimates: DataFrame, target: float, tolerance: float, done: int, most: int) -> bool:
    """Whether the sum of squared estimates is below the target; an error after ``most`` refinements without that."""
    total = estimates.agg(F.coalesce(F.sum("sq_est"), F.lit(0.0))).first()[0]
    if total < target * target * (1 + tolerance):
        return True
    if done >= most:
        raise ArithmeticError(f"the objective is not reached after {done} refinements: {total**0.5:g} against {target:g}")
    return False


def enough(done: int, most: int = 10) -> bool:
    return done >= most
