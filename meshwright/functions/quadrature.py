"""Quadrature rules and shape functions as small tables; numpy computes them on the driver."""

from __future__ import annotations

import itertools

import numpy as np


def gauss_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on [-1, 1], exact to degree 2n - 1."""
    return np.polynomial.legendre.leggauss(n)


def cube(n: int, dims: int) -> list[tuple[list[float], float]]:
    """Tensor product on [-1, 1]^dims; x runs fastest."""
    x, w = gauss_legendre(n)
    grid = itertools.product(range(n), repeat=dims)
    return [([float(x[i]) for i in reversed(k)], float(np.prod([w[i] for i in k]))) for k in grid]


def simplex(n: int, dims: int) -> list[tuple[list[float], float]]:
    """Collapsed product on the unit simplex, exact to degree 2n - dims."""
    x, w = gauss_legendre(n)
    x, w = (x + 1) / 2, w / 2
    out = []
    for k in itertools.product(range(n), repeat=dims):
        rest, weight, point = 1.0, 1.0, []
        for d, i in enumerate(k):
            point.append(float(rest * x[i]))
            weight *= float(w[i]) * (rest if d < dims - 1 or dims == 1 else rest) if d else float(w[i])
            rest *= 1 - float(x[i])
        out.append((point, weight))
    return out


def lagrange(order: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives (points, order + 1) of the basis on equal nodes of [-1, 1]."""
    nodes = np.linspace(-1, 1, order + 1)
    at = np.atleast_1d(np.asarray(at, float))
    value, slope = np.ones((len(at), order + 1)), np.zeros((len(at), order + 1))
    for a in range(order + 1):
        others = [b for b in range(order + 1) if b != a]
        scale = np.prod([nodes[a] - nodes[b] for b in others]) if others else 1.0
        value[:, a] = np.prod([at - nodes[b] for b in others], axis=0) / scale if others else 1.0
        slope[:, a] = sum((np.prod([at - nodes[b] for b in others if b != c], axis=0) if len(others) > 1 else np.ones(len(at))) for c in others) / scale if others else 0.0
    return value, slope


def shapes(order: int, dims: int, n: int) -> list[tuple[int, float, int, list[float], float, list[float]]]:
    """(q, weight, a, point, N_a, gradient of N_a) of the tensor-product element at the points of ``cube``; x runs fastest."""
    out = []
    for q, (point, weight) in enumerate(cube(n, dims)):
        parts = [lagrange(order, np.array([p])) for p in point]
        for a, k in enumerate(itertools.product(range(order + 1), repeat=dims)):
            k = list(reversed(k))
            v = [parts[d][0][0, k[d]] for d in range(dims)]
            g = [float(np.prod([parts[e][1][0, k[e]] if e == d else v[e] for e in range(dims)])) for d in range(dims)]
            out.append((q, weight, a, point, float(np.prod(v)), g))
    return out


def monomials(order: int, at: np.ndarray) -> np.ndarray:
    return np.power(np.atleast_1d(at)[:, None], np.arange(order + 1)[None, :])
