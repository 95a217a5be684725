"""Element tables, files of parts, and solvers' criteria, against what they must fulfil."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import elements as el
from meshwright.operators import norms as checks
from meshwright.plans import facets, poisson, solvers
from meshwright.sources import meshfile, partfile, structured


@pytest.mark.parametrize(("order", "dims"), list(itertools.product((1, 2, 3), (1, 2, 3))))
def test_shapes_and_their_derivatives(order, dims):
    nodes = el.lattice(order, dims)
    assert np.allclose(el.cube_shapes(order, nodes)[0], np.eye(len(nodes)))
    p, e = np.random.default_rng(1).uniform(-1, 1, (5, dims)), 1e-5
    _, slope, bend = el.cube_shapes(order, p)
    for d in range(dims):
        step = np.eye(dims)[d] * e
        hi, lo = el.cube_shapes(order, p + step), el.cube_shapes(order, p - step)
        assert np.allclose((hi[0] - lo[0]) / 2 / e, slope[:, :, d], atol=1e-6) and np.allclose((hi[1] - lo[1]) / 2 / e, bend[:, :, d], atol=1e-5)
    assert np.allclose(sum(c @ r for c, r in zip(el.coarsening(order, dims), el.refinement(order, dims), strict=True)), np.eye(len(nodes)))
    if dims > 1:
        at = np.array(el.simplex_exponents(order, dims)) / order
        assert np.allclose(el.simplex_shapes(order, at)[0], np.eye(len(at)))


@pytest.mark.parametrize(("kind", "order", "dims"), list(itertools.product(("div", "curl"), (1, 2), (2, 3))))
def test_moment_elements_have_their_fields_exactly(kind, order, dims):
    m = el.MomentElement(kind, order, dims)
    p = np.random.default_rng(2).uniform(-1, 1, (6, dims))
    field = lambda x: np.stack([x[:, 0] ** (order - 1) + 1, *([2 * x[:, 1] ** (order - 1)] * (dims - 1))], axis=1)
    c = m.interpolate(field)
    assert np.allclose(np.einsum("pfd,f->pd", m.evaluate(p)[0], c), field(p))
    assert np.allclose(m.divergence(p) @ c, (order - 1) * (1 + 2) if order == 2 else 0)
    turn = m.curl(p)
    assert turn.shape == ((6, len(c)) if dims == 2 else (6, len(c), 3))


def test_permutations_and_codes_of_faces():
    assert len(el.face_codes(3)) == 27 and el.face_codes(2)[:4] == [(0, 0), (0, 1), (0, 2), (0, 3)]
    turned = el.face_permutations(2)
    assert len({tuple(v) for v in turned.values()}) == 8 and all(sorted(v) == list(range(9)) for v in turned.values())
    for degree in el.SYMMETRIC:
        for a, b in itertools.product(range(degree + 1), repeat=2):
            if a + b <= degree:
                got = sum(w * x**a * y**b for (x, y), w in el.symmetric_rule(degree))
                assert abs(got - math.factorial(a) * math.factorial(b) / math.factorial(a + b + 2)) < 1e-12


def test_broken_elements_of_order_two(spark):
    rows = facets.solve_broken(spark, [2, 2], F.lit(-6.0), F.col("x") ** 2 + 2 * F.col("y") ** 2, order=2).collect()
    lattice = el.lattice(2, 2)
    assert len(rows) == 36
    for r in rows:
        cell, a = divmod(r.idx - 1, 9)
        x, y = (cell % 2 + (lattice[a][0] + 1) / 2) / 2, (cell // 2 + (lattice[a][1] + 1) / 2) / 2
        assert abs(r.val - x * x - 2 * y * y) < 1e-9


def test_orders_converge_as_they_should(spark):
    """Halving the cells divides the error by 2^(order + 1)."""
    exact = F.sin(F.col("x") * math.pi) * F.sin(F.col("y") * math.pi)
    errors = []
    for n in (2, 4):
        u, points = poisson.solve(spark, [n, n], 2 * math.pi**2 * exact, exact, order=2, tolerance=1e-8)
        errors.append(poisson.error_norms(points, u, exact, [F.lit(0.0), F.lit(0.0)], 2)["l2"])
    assert 2.4 < math.log2(errors[0] / errors[1]) < 4


def test_criteria_of_solvers():
    n = solvers.Norms(rhs=10.0, residual=0.5, first_residual=2.0, given=0.1, first_given=1.0, given_rhs=1.0)
    assert solvers.met("res_rhs", n, 0.1, 0.0) and not solvers.met("res_res", n, 0.1, 0.0) and solvers.met("res_res", n, 0.1, 0.4)
    assert not solvers.met("delta_rhs", n, 1.0, 0.0) and not solvers.met("delta_delta_and_res_rhs", n, 1.0, 0.0)
    n.step, n.first_step = 0.3, 3.0
    assert solvers.met("delta_delta", n, 0.1, 0.0) and solvers.met("delta_rhs_and_res_rhs", n, 0.1, 0.0) and not solvers.met("delta_delta_and_res_res", n, 0.1, 0.0)
    assert all(isinstance(solvers.met(c, n, 0.1, 0.0), bool) for c in solvers.CRITERIA)
    with pytest.raises(ValueError, match="no criterion"):
        solvers.met("other", n, 0.1, 0.0)
    with pytest.raises(ValueError, match="no solver"):
        solvers.solve("other", None, None)


def test_objectives_of_refinement(spark):
    e = spark.createDataFrame([(1, 0.04), (2, 0.05)], "cell_id long, sq_est double")
    assert checks.objective_reached(e, 0.3, 0.01, 0, 3) and not checks.objective_reached(e, 0.2, 0.0, 1, 3)
    with pytest.raises(ArithmeticError, match="not reached"):
        checks.objective_reached(e, 0.2, 0.0, 3, 3)


def test_files_of_parts(spark, tmp_path):
    cells, vertices = structured.cells(spark, [2, 1]), structured.vertices(spark, [2, 1], [(0.0, 2.0), (0.0, 1.0)])
    lines = [r.line for r in partfile.view_lines(vertices, cells, 2).collect()]
    assert lines[0] == "MESH TITLE dimension 2 Elemtype Quadrilateral Nnode  4" and lines[1] == "coordinates" and lines[-1] == "end elements"
    assert lines[-2].split() == ["2", "2", "3", "6", "5", "1"] and len(lines) == 6 + 2 + 5
    parts = spark.createDataFrame([(1, 1), (2, 2)], "cell_id long, part int")
    paths = partfile.write_parts(vertices, cells, parts, str(tmp_path), "box", 2)
    assert [p[-14:] for p in paths] == ["box.1.post.msh", "box.2.post.msh"] and spark.read.text(paths[1]).where("value LIKE '% 1'").count() == 1
    numbers = {
        "part": 2, "parts": 3, "boundary_cells": [4, 5], "boundary_vertices": list(range(12)), "offsets": [1, 2, 4], "neighbour_cells": [7, 8, 9], "neighbour_parts": [1, 1, 3],
        "l2g_vertices": list(range(5, 28)), "global_vertices": 100, "l2g_cells": [11], "global_cells": 50,
    }
    partfile.write_partition(spark, numbers, str(tmp_path / "p.prt"))
    assert meshfile.read_partition(spark, str(tmp_path / "p.prt" / "*.txt")) == numbers
    assert partfile.environment_lines([4, 1], [3, 1])[1] == "         4         1"
    x = spark.createDataFrame([(1, 0.5), (3, -2.0)], "idx long, val double")
    partfile.write_lines(partfile.vector_lines(x, 3), str(tmp_path / "v"))
    assert sorted(map(tuple, partfile.read_vector(spark, str(tmp_path / "v" / "*.txt")).collect())) == [(1, 0.5), (2, 0.0), (3, -2.0)]
    assert partfile.pieces_manifest(["a.vtu", "b.vtu"], ["u"]).count("<Piece ") == 2


def test_a_series_grows_by_steps(spark, tmp_path):
    s = partfile.Series(spark, str(tmp_path / "run"))
    for k in (0, 1, 1):
        s.append(k, 0.5 * k, spark.createDataFrame([(1, 1.0 + k)], "idx long, val double"))
    assert s.steps() == [(0, 0.0), (1, 0.5)] and sorted((r.step, r.val) for r in s.read().collect()) == [(0, 1.0), (1, 2.0)]


def test_meshes_addressed_by_folder_and_prefix(spark, tmp_path):
    (tmp_path / "m.mesh").write_text("MESH dimension 2 order 1 types 1 elements 1 vertices 3 vefs 0\ncoordinates\n1 0 0\n2 1 0\n3 0 1\nend coordinates\nelements\n1 3 1 2 3 1 1\nend elements\nvefs\nend vefs\n")
    for m in (partfile.mesh_at(spark, str(tmp_path), "m"), partfile.mesh_of(spark, {"dir_path": str(tmp_path), "prefix": "m"})):
        assert m["cells"].first().nodes == [1, 2, 3] and m["vertices"].count() == 3
