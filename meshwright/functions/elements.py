"""Tables of finite elements: shape functions of any order on cubes and simplices, spaces with normal or
tangential continuity, refinement, and the numbering of faces. numpy builds them on the driver; they
have as many rows as an element has points and functions."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwright.functions.fields import tensor_vector, times, vector_tensor
from meshwright.functions.quadrature import cube, lagrange


def lattice(order: int, dims: int) -> np.ndarray:
    """Nodes of the cube element on [-1, 1]^dims; x runs fastest."""
    at = np.linspace(-1, 1, order + 1) if order else np.zeros(1)
    return np.array([[at[k] for k in reversed(m)] for m in itertools.product(range(order + 1), repeat=dims)])


def curvature(order: int, at: np.ndarray) -> np.ndarray:
    """Second derivatives (points, order + 1) of the one-dimensional basis."""
    nodes, at = np.linspace(-1, 1, order + 1), np.atleast_1d(np.asarray(at, float))
    out = np.zeros((len(at), order + 1))
    for a in range(order + 1):
        p = np.poly1d([nodes[b] for b in range(order + 1) if b != a], r=True)
        out[:, a] = (p.deriv(2) / p(nodes[a]))(at) if order > 1 else 0.0
    return out


def cube_shapes(order: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (p, f), gradients (p, f, d) and Hessians (p, f, d, d) of the tensor-product functions at points (p, d)."""
    points = np.atleast_2d(points)
    dims = points.shape[1]
    one = [(*lagrange(order, points[:, d]), curvature(order, points[:, d])) for d in range(dims)]
    functions = [list(reversed(m)) for m in itertools.product(range(order + 1), repeat=dims)]
    pick = lambda f, degrees: np.prod([one[d][degrees[d]][:, f[d]] for d in range(dims)], axis=0)
    unit = np.eye(dims, dtype=int)
    value = np.stack([pick(f, [0] * dims) for f in functions], axis=1)
    slope = np.stack([np.stack([pick(f, unit[i]) for i in range(dims)], axis=1) for f in functions], axis=1)
    bend = np.stack([np.stack([np.stack([pick(f, unit[i] + unit[j]) for j in range(dims)], axis=1) for i in range(dims)], axis=1) for f in functions], axis=1)
    return value, slope, bend


def simplex_exponents(order: int, dims: int) -> list[tuple[int, ...]]:
    return [tuple(reversed(m)) for m in itertools.product(range(order + 1), repeat=dims) if sum(m) <= order]


def simplex_shapes(order: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (p, f) and gradients (p, f, d) on the unit simplex; nodes are the lattice points with i + j + k <= order."""
    points = np.atleast_2d(points)
    dims = points.shape[1]
    powers = np.array(simplex_exponents(order, dims))
    nodes = powers / max(order, 1)
    at = lambda x, e: np.prod(x[:, None, :] ** e[None, :, :], axis=2)
    inverse = np.linalg.inv(at(nodes, powers))
    slopes = []
    for d in range(dims):
        lower = powers.copy()
        lower[:, d] = np.maximum(lower[:, d] - 1, 0)
        slopes.append((at(points, lower) * powers[:, d]) @ inverse)
    return at(points, powers) @ inverse, np.stack(slopes, axis=2)


def vector_shapes(value: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of the vector element with one scalar function for each component (function f of component c is number c * n + f):
    values (p, c*n, d), divergences (p, c*n), and curls (p, c*n) in the plane or (p, c*n, 3) in space."""
    p, n, dims = slope.shape
    v = np.zeros((p, dims * n, dims))
    div, grad = np.zeros((p, dims * n)), np.zeros((p, dims * n, dims, dims))
    for c in range(dims):
        v[:, c * n : (c + 1) * n, c] = value
        div[:, c * n : (c + 1) * n] = slope[:, :, c]
        grad[:, c * n : (c + 1) * n, c] = slope
    return v, div, curl(grad)


def curl(grad: np.ndarray) -> np.ndarray | None:
    """From grad[..., c, i], the derivative of component c by direction i."""
    dims = grad.shape[-1]
    if dims == 2:
        return grad[..., 1, 0] - grad[..., 0, 1]
    return np.stack([grad[..., k, j] - grad[..., j, k] for j, k in ((1, 2), (2, 0), (0, 1))], axis=-1) if dims == 3 else None


class MomentElement:
    """A space of polynomial vectors on [-1, 1]^dims whose functions are dual to moments.

    ``div``: normal moments on facets and moments inside (Raviart-Thomas); ``curl``: tangential moments on edges, on
    faces and inside (Nedelec). ``order`` begins at 1. Moments are against Legendre polynomials."""

    def __init__(self, kind: str, order: int, dims: int):
        if kind not in ("div", "curl") or order < 1 or dims not in (2, 3):
            raise ValueError("kind is div or curl, order at least 1, dims 2 or 3")
        self.kind, self.order, self.dims = kind, order, dims
        high = lambda c, d: (order if (d == c) == (kind == "div") else order - 1)
        self.terms = [(c, e) for c in range(dims) for e in itertools.product(*(range(high(c, d) + 1) for d in range(dims)))]
        #: (dimension of the face, axes that run, fixed sides, component, degrees of the test polynomial)
        self.moments = self.faces() + self.inside()
        m = np.array([self.moment(i) for i in range(len(self.moments))])
        self.coefficients = np.linalg.inv(m)

    def faces(self) -> list[tuple]:
        k, dims, out = self.order, self.dims, []
        if self.kind == "div":
            for c in range(dims):
                run = [d for d in range(dims) if d != c]
                out += [(run, {c: s}, c, q) for s in (-1.0, 1.0) for q in itertools.product(range(k), repeat=dims - 1)]
            return out
        for c in range(dims):
            still = [d for d in range(dims) if d != c]
            out += [([c], dict(zip(still, s, strict=True)), c, (q,)) for s in itertools.product((-1.0, 1.0), repeat=dims - 1) for q in range(k)]
        if dims == 3:
            for n in range(3):
                run = [d for d in range(3) if d != n]
                out += [(run, {n: s}, c, q) for s in (-1.0, 1.0) for c in run for q in itertools.product(*(range(k if d == c else k - 1) for d in run))]
        return out

    def inside(self) -> list[tuple]:
        k, dims = self.order, self.dims
        low = (lambda c, d: k - 1 if d == c else k) if self.kind == "div" else (lambda c, d: k if d == c else k - 1)
        return [(list(range(dims)), {}, c, q) for c in range(dims) for q in itertools.product(*(range(low(c, d)) for d in range(dims)))]

    def moment(self, i: int) -> np.ndarray:
        """The moment of every term."""
        run, fixed, c, degrees = self.moments[i]
        rule = cube(self.order + 1, len(run))
        points = np.array([[fixed.get(d, x[run.index(d)] if d in run else 0.0) for d in range(self.dims)] for x, _ in rule])
        test = np.array([w * math.prod(float(np.polynomial.legendre.Legendre.basis(q)(x[j])) for j, q in enumerate(degrees)) for x, w in rule])
        return np.array([(test * np.prod(points ** np.array(e), axis=1)).sum() if t == c else 0.0 for t, e in self.terms])

    def evaluate(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (p, f, d) and gradients (p, f, c, i) of the functions."""
        points = np.atleast_2d(points)
        n = len(self.terms)
        value, grad = np.zeros((len(points), n, self.dims)), np.zeros((len(points), n, self.dims, self.dims))
        for t, (c, e) in enumerate(self.terms):
            value[:, t, c] = np.prod(points ** np.array(e), axis=1)
            for i in range(self.dims):
                lower = np.array(e)
                lower[i] = max(lower[i] - 1, 0)
                grad[:, t, c, i] = e[i] * np.prod(points**lower, axis=1)
        return np.einsum("ptd,tf->pfd", value, self.coefficients), np.einsum("ptci,tf->pfci", grad, self.coefficients)

    def columns(self, at: list[Column]) -> Column:
        """array<array<double>>: the vectors of all functions at reference coordinates given as columns."""
        power = lambda e: math.prod([F.pow(x, F.lit(float(k))) for x, k in zip(at, e, strict=True) if k], start=F.lit(1.0))
        terms = [power(e) for _, e in self.terms]
        part = lambda f, c: sum((float(self.coefficients[t, f]) * terms[t] for t, (k, _) in enumerate(self.terms) if k == c and abs(self.coefficients[t, f]) > 1e-14), F.lit(0.0))
        return F.array(*(F.array(*(part(f, c) for c in range(self.dims))) for f in range(len(self.terms))))

    def divergence(self, points: np.ndarray) -> np.ndarray:
        return np.einsum("pfcc->pf", self.evaluate(points)[1])

    def curl(self, points: np.ndarray) -> np.ndarray | None:
        return curl(self.evaluate(points)[1])

    def interpolate(self, field) -> np.ndarray:
        """The moments of a field that maps points (p, d) to vectors (p, d): the coefficients of its interpolant."""
        out = []
        for run, fixed, c, degrees in self.moments:
            rule = cube(self.order + 3, len(run))
            points = np.array([[fixed.get(d, x[run.index(d)] if d in run else 0.0) for d in range(self.dims)] for x, _ in rule])
            test = np.array([w * math.prod(float(np.polynomial.legendre.Legendre.basis(q)(x[j])) for j, q in enumerate(degrees)) for x, w in rule])
            out.append(float((test * np.asarray(field(points))[:, c]).sum()))
        return np.array(out)


def contravariant(v: Column, jacobian: Column, det: Column) -> Column:
    """A reference vector as a physical one with the same flux; J[i][j] is the derivative of coordinate j by direction i."""
    return times(1 / det, vector_tensor(v, jacobian))


def covariant(v: Column, inverse: Column) -> Column:
    """A reference vector as a physical one with the same circulation."""
    return tensor_vector(inverse, v)


def refinement(order: int, dims: int) -> np.ndarray:
    """(child, child's node, parent's node): a child's nodal values from its parent's."""
    nodes = lattice(order, dims)
    out = []
    for m in itertools.product((0, 1), repeat=dims):
        corner = np.array(list(reversed(m))) - 0.5
        out.append(cube_shapes(order, nodes / 2 + corner)[0])
    return np.array(out)


def coarsening(order: int, dims: int) -> np.ndarray:
    """(child, parent's node, child's node): the parent's values from its children's, by least squares over the cell."""
    rule = cube(order + 1, dims)
    at, w = np.array([x for x, _ in rule]), np.array([v for _, v in rule])
    own = cube_shapes(order, at)[0]
    mass = np.linalg.inv(np.einsum("p,pa,pb->ab", w, own, own))
    out = []
    for m in itertools.product((0, 1), repeat=dims):
        corner = np.array(list(reversed(m))) - 0.5
        parent = cube_shapes(order, at / 2 + corner)[0]
        out.append(mass @ np.einsum("p,pa,pb->ab", w / 2**dims, parent, own))
    return np.array(out)


def face_codes(dims: int) -> list[tuple[int, int]]:
    """(directions that run, fixed sides) as bits, of all faces of a cube by dimension."""
    out = [(run, fixed) for run in range(2**dims) for fixed in range(2**dims) if not run & fixed]
    return sorted(out, key=lambda c: (bin(c[0]).count("1"), c))


def face_permutations(order: int) -> dict[tuple[bool, int], list[int]]:
    """Of a square face with (order + 1)^2 nodes: where each node is when the face is seen turned by quarter
    turns, and (True) mirrored first."""
    n, out = order + 1, {}
    grid = np.arange(n * n).reshape(n, n)
    for mirrored in (False, True):
        for turns in range(4):
            out[mirrored, turns] = np.rot90(grid.T if mirrored else grid, turns).ravel().tolist()
    return out


def rotation(mine: Column, theirs: Column) -> Column:
    """Where the first corner of ``mine`` stands among ``theirs``, from 0: the same face seen from two cells."""
    return (F.array_position(theirs, F.get(mine, 0)) - 1).cast("int")


#: Symmetric rules on the unit triangle, (barycentric orbit, weight) by degree; weights sum to 1.
SYMMETRIC = {
    1: [((1 / 3, 1 / 3, 1 / 3), 1.0)],
    2: [((2 / 3, 1 / 6, 1 / 6), 1 / 3)],
    3: [((1 / 3, 1 / 3, 1 / 3), -27 / 48), ((0.6, 0.2, 0.2), 25 / 48)],
}


def symmetric_rule(degree: int) -> list[tuple[list[float], float]]:
    """Points and weights on the unit triangle, each orbit of barycentric coordinates turned in all ways."""
    out = []
    for orbit, weight in SYMMETRIC[degree]:
        for b in sorted(set(itertools.permutations(orbit))):
            out.append(([b[1], b[2]], weight / 2))
    return out
