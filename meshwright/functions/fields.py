"""Columns for vectors (x, y, z) and 3x3 tensors, as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(v: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner(v, v))


def cross(v: Column, w: Column) -> Column:
    a, b = (lambda i: F.get(v, i)), (lambda i: F.get(w, i))
    return F.array(*(a(i) * b(j) - a(j) * b(i) for i, j in ((1, 2), (2, 0), (0, 1))))


def plus(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda a, b: a + b)


def minus(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda a, b: a - b)


def times(s: Column, v: Column) -> Column:
    return F.transform(v, lambda a: s * a)


def transposed(t: Column) -> Column:
    return F.array(*(F.array(*(F.get(F.get(t, j), i) for j in range(3))) for i in range(3)))


def tensor_vector(t: Column, v: Column) -> Column:
    return F.transform(t, lambda row: inner(row, v))


def vector_tensor(v: Column, t: Column) -> Column:
    return tensor_vector(transposed(t), v)


def tensor_tensor(t: Column, s: Column) -> Column:
    return F.transform(t, lambda row: tensor_vector(transposed(s), row))


def double_contraction(t: Column, s: Column) -> Column:
    return F.aggregate(F.zip_with(t, s, inner), F.lit(0.0), lambda a, x: a + x)


def symmetric_part(t: Column) -> Column:
    return F.zip_with(t, transposed(t), lambda r, c: F.zip_with(r, c, lambda a, b: (a + b) * 0.5))


def trace(t: Column) -> Column:
    return sum((F.get(F.get(t, i), i) for i in range(1, 3)), F.get(F.get(t, 0), 0))


def determinant(t: Column, dims: int) -> Column:
    m = lambda i, j: F.get(F.get(t, i), j)
    if dims == 1:
        return m(0, 0)
    if dims == 2:
        return m(0, 0) * m(1, 1) - m(0, 1) * m(1, 0)
    return sum((m(0, i) * (m(1, j) * m(2, k) - m(1, k) * m(2, j)) for i, j, k in ((0, 1, 2), (1, 2, 0))), m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0)))


def inverse(t: Column, dims: int) -> Column:
    """Null where the determinant is 0."""
    m = lambda i, j: F.get(F.get(t, i), j)
    d = F.nullif(determinant(t, dims), F.lit(0.0))
    if dims == 1:
        return F.array(F.array(1 / d))
    if dims == 2:
        return F.array(F.array(m(1, 1) / d, -m(0, 1) / d), F.array(-m(1, 0) / d, m(0, 0) / d))
    minor = lambda i, j: m((i + 1) % 3, (j + 1) % 3) * m((i + 2) % 3, (j + 2) % 3) - m((i + 1) % 3, (j + 2) % 3) * m((i + 2) % 3, (j + 1) % 3)
    return F.array(*(F.array(*(minor(j, i) / d for j in range(3))) for i in range(3)))


def curl_of(gradient: Column) -> Column:
    """From gradient[i][j] = d u_j / d x_i."""
    g = lambda i, j: F.get(F.get(gradient, i), j)
    return F.array(g(1, 2) - g(2, 1), g(2, 0) - g(0, 2), g(0, 1) - g(1, 0))


def parsed(text: str) -> Column:
    """A formula over x, y, z, t as a column; anything but arithmetic and known functions is an error."""
    import re

    names = set(re.findall(r"[A-Za-z_]\w*", text))
    known = {"x", "y", "z", "t", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "exp", "log", "log10", "sqrt", "abs", "pow", "e", "E", "pi", "sign", "min", "max"}
    if bad := names - known:
        raise ValueError(f"unknown names in the formula: {sorted(bad)}")
    if re.search(r"[^\w\s.+\-*/^(),]", text):
        raise ValueError("only arithmetic is allowed in a formula")
    body = re.sub(r"\bmin\(", "least(", re.sub(r"\bmax\(", "greatest(", re.sub(r"\blog\(", "ln(", text)))
    body = re.sub(r"\bpi\b", "pi()", body)
    while m := re.search(r"(\w+(?:\([^()]*\))?|\([^()]*\))\s*\^\s*(\w+(?:\([^()]*\))?|\([^()]*\))", body):
        body = f"{body[: m.start()]}power({m[1]}, {m[2]}){body[m.end() :]}"
    return F.expr(body).cast("double")


def vector(*texts: str) -> Column:
    """One formula for each component."""
    return F.array(*map(parsed, texts))


def tensor(rows: list[list[str]]) -> Column:
    return F.array(*(vector(*r) for r in rows))


def with_gradient(text: str, gradient: list[str]) -> Column:
    """struct<value, gradient> of a scalar formula and those of its derivatives."""
    return F.struct(parsed(text).alias("value"), vector(*gradient).alias("gradient"))


def vector_with_gradient(texts: list[str], gradient: list[list[str]]) -> Column:
    """struct<value, gradient>; gradient[i][j] is the derivative of component j by coordinate i."""
    return F.struct(vector(*texts).alias("value"), tensor(gradient).alias("gradient"))


def time_derivatives(*texts: str) -> Column:
    """The formula and those of its derivatives by t: element n is the n-th derivative."""
    return vector(*texts)


def component(v: Column, *index: int) -> Column:
    """One component of a vector or tensor, from 0."""
    for i in index:
        v = F.get(v, i)
    return v


def divergence_of(gradient: Column) -> Column:
    return trace(gradient)


def constant(*values: float) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)) if len(values) > 1 else F.lit(float(values[0]))
