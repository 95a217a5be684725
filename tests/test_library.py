"""Operators on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import fields, levelsets, quadrature
from meshwright.operators import cut, graph, norms, octree, sparse, vector
from meshwright.plans import assembly, poisson, solvers, timestep
from meshwright.plans.lineage import Tables
from meshwright.sources import meshfile, structured


def entries(spark, rows):
    return spark.createDataFrame(rows, "ia long, ja long, val double, seq long")


def test_symmetric_insert_and_compress(spark):
    ia, ja, val = [1, 2, 3, 4, 5, 1, 6, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6, 1, 5, 4, 3, 2, 1], [1, 2, 3, 4, 5, 99, 99, 5, 4, 3, 2, 1]
    m = sparse.insert(entries(spark, [(i, j, float(v), k) for k, (i, j, v) in enumerate(zip(ia, ja, val, strict=True))]), 5, 5, symmetric=True)
    want = {(1, 1): 1, (1, 5): 5, (2, 2): 2, (2, 4): 4, (4, 4): 4, (5, 5): 5}
    assert {(r.ia, r.ja): r.val for r in sparse.compress(m).collect()} == want | {(3, 3): 6}
    assert {(r.ia, r.ja): r.val for r in sparse.compress_last(m).collect()} == want | {(3, 3): 3}


def test_update_blocks_and_products(spark):
    blocks = spark.createDataFrame([([1, 2], [1, 2], [[1.0, 2.0], [3.0, 4.0]]), ([2, 3], [2, 3], [[5.0, 6.0], [7.0, 8.0]])], "rows array<long>, cols array<long>, block array<array<double>>")
    m = sparse.compress(sparse.insert_blocks(blocks))
    dense = np.array([[1, 2, 0], [3, 9, 6], [0, 7, 8.0]])
    x = spark.createDataFrame([(1, 1.0), (2, -2.0), (3, 0.5)], "idx long, val double")
    got = {r.idx: r.val for r in sparse.spmv(m, x).collect()}
    assert np.allclose([got[i] for i in (1, 2, 3)], dense @ [1, -2, 0.5])
    up = sparse.update(m, entries(spark, [(1, 1, 10.0, 1), (1, 1, 1.0, 2), (3, 1, 5.0, 1)]))
    assert {(r.ia, r.ja): r.val for r in up.collect()}[1, 1] == 12.0 and up.count() == m.count()
    put = sparse.update(m, entries(spark, [(1, 1, 10.0, 1), (1, 1, 1.5, 2)]), add=False)
    assert {(r.ia, r.ja): r.val for r in put.collect()}[1, 1] == 1.5


def test_empty_inputs(spark):
    none = entries(spark, []).select("ia", "ja", "val")
    x = spark.createDataFrame([], "idx long, val double")
    assert sparse.compress(none).count() == 0 and sparse.spmv(none, x).count() == 0
    assert vector.dot(x, x).first()[0] == 0.0 and vector.nrm2(x).first()[0] == 0.0
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long"), Tables(spark).cut).count() == 0


def test_inverting_zero_is_an_error(spark):
    with pytest.raises(Exception, match="zero entry"):
        vector.invert(spark.createDataFrame([(1, 0.0)], "idx long, val double")).collect()


def test_components_of_a_chain(spark):
    chain = spark.range(1, 60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src != 30")
    got = {r.id: r.component for r in graph.connected_components(chain, Tables(spark).cut).collect()}
    assert all(got[i] == (1 if i <= 30 else 31) for i in got) and len(got) == 60


def test_levels_colours_and_ordering(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (7, 8)], "src long, dst long")
    cut_ = Tables(spark).cut
    assert {r.id: r.level for r in graph.bfs_levels(e, 1, cut_).collect()} == {1: 0, 2: 1, 5: 1, 3: 2, 4: 2}
    c = {r.id: r.colour for r in graph.colouring(e, cut_).collect()}
    assert len(c) == 7 and all(c[r.src] != c[r.dst] for r in e.collect())
    assert sorted(r["rank"] for r in graph.reverse_cuthill_mckee(e, 1, cut_).collect()) == [1, 2, 3, 4, 5]


def test_quadrature_is_exact():
    for n in range(1, 8):
        x, w = quadrature.gauss_legendre(n)
        for k in range(2 * n):
            assert abs((w * x**k).sum() - (0 if k % 2 else 2 / (k + 1))) < 1e-12
    for dims, volume in ((2, 0.5), (3, 1 / 6)):
        assert abs(sum(w for _, w in quadrature.simplex(4, dims)) - volume) < 1e-12
    v, s = quadrature.lagrange(3, np.linspace(-1, 1, 7))
    assert np.allclose(v.sum(axis=1), 1) and np.allclose(s.sum(axis=1), 0)


def test_poisson_with_a_linear_solution(spark):
    exact = 1 + 2 * F.col("x") - 3 * F.col("y")
    u, points = poisson.solve(spark, [4, 4], F.lit(0.0), exact)
    assert all(abs(v) < 1e-8 for v in poisson.error_norms(points, u, exact, [F.lit(2.0), F.lit(-3.0)], 2).values())


def test_mesh_volume_and_solvers(spark):
    cells, vertices = structured.cells(spark, [3, 2]), structured.vertices(spark, [3, 2], [(0.0, 3.0), (0.0, 1.0)])
    points = assembly.quadrature_points(assembly.cell_points(cells, vertices), 2, 2)
    assert abs(points.agg(F.sum("w")).first()[0] - 3.0) < 1e-12
    rows = [(i, i, 4.0) for i in range(1, 7)] + [(i, i + 1, -1.0) for i in range(1, 6)] + [(i + 1, i, -1.0) for i in range(1, 6)]
    m, b = spark.createDataFrame(rows, "ia long, ja long, val double"), spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "idx long, val double")
    dense = np.zeros((6, 6))
    for i, j, v in rows:
        dense[i - 1, j - 1] = v
    want, cut_ = np.linalg.solve(dense, np.arange(1, 7)), Tables(spark).cut
    for method in (solvers.conjugate_gradients, solvers.richardson, solvers.gmres, solvers.minres):
        x, report = method(m, b, cut=cut_)
        got = {r.idx: r.val for r in x.collect()}
        assert report.converged and np.allclose([got[i] for i in range(1, 7)], want, atol=1e-6)


def test_time_steps_have_their_order(spark):
    one = spark.createDataFrame([(1, 1, 1.0)], "ia long, ja long, val double")
    u = spark.createDataFrame([(1, 1.0)], "idx long, val double")
    for scheme, order in (("backward_euler", 1), ("sdirk_2", 2)):
        errors = [abs(timestep.integrate(one, one, u, 0.0, 0.4, h, scheme, Tables(spark).cut).first().val - np.exp(-0.4)) for h in (0.2, 0.1)]
        assert np.log2(errors[0] / errors[1]) > order - 0.35


def test_cut_area_of_a_disc(spark):
    n = 24
    cells, vertices = structured.cells(spark, [n, n]), structured.vertices(spark, [n, n], [(-1.0, 1.0)] * 2)
    phi = vertices.select("vertex_id", (F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) - 0.7).alias("phi"))
    located = cut.nodal(assembly.cell_points(cells, vertices), phi)
    assert abs(cut.negative_area(located).agg(F.sum("area")).first()[0] - np.pi * 0.49) < 5e-3
    states = {r["status"]: r["count"] for r in located.groupBy(cut.status(F.col("phi")).alias("status")).count().collect()}
    assert set(states) == {"cut", "interior", "exterior"} and sum(states.values()) == n * n


def test_octree_families(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 0), (1, 0, 1, 0), (1, 1, 1, -1)], "level int, i long, j long, flag int")
    fine = octree.refine(cells)
    assert fine.count() == 7
    back = octree.coarsen(fine.withColumn("flag", F.when(F.col("level") == 2, -1).otherwise(0)))
    assert {(r.level, r.i, r.j) for r in back.collect()} == {(1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1)}


def test_formulas_and_tensors(spark):
    df = spark.createDataFrame([(2.0, 3.0, 0.5, 1.0)], "x double, y double, z double, t double")
    assert df.select(fields.parsed("x^2 + max(y, z) - (x+y)^2 + cos(pi)")).first()[0] == 4 + 3 - 25 - 1
    with pytest.raises(ValueError, match="unknown names"):
        fields.parsed("drop_table(x)")
    t = [[2.0, 1.0, 0.0], [0.0, 3.0, 1.0], [1.0, 0.0, 4.0]]
    k = F.array(*(F.array(*map(F.lit, r)) for r in t))
    got = df.select(fields.inverse(k, 3).alias("i"), fields.trace(k).alias("t"), fields.determinant(k, 3).alias("d"), fields.double_contraction(k, k).alias("c")).first()
    assert np.allclose(got.i, np.linalg.inv(t)) and got.t == 9 and abs(got.d - np.linalg.det(t)) < 1e-12 and got.c == np.sum(np.square(t))


def test_mesh_file_round_trip(spark, tmp_path):
    text = "MESH dimension 2 order 0 types 1 elements 1 vertices 4 vefs 1\ncoordinates\n1 0.0 0.0\n2 1.0 0.0\n3 1.0 1.0\n4 0.0 1.0\nend coordinates\nelements\n1 4 1 2 3 4 7 9\nend elements\nvefs\n1 2 1 2 5 6\nend vefs\n"
    (tmp_path / "a.mesh").write_text(text)
    m = meshfile.read_mesh(spark, str(tmp_path / "a.mesh"))
    assert m["cells"].first().nodes == [1, 2, 4, 3] and m["cells"].first().set_id == 7 and m["boundary_vefs"].first().geo_id == 6
    meshfile.write_mesh(str(tmp_path / "out"), m["vertices"], m["cells"], m["boundary_vefs"], 2)
    again = meshfile.read_mesh(spark, str(tmp_path / "out" / "*.txt"))
    assert again["cells"].collect() == m["cells"].collect() and again["vertices"].orderBy("vertex_id").collect() == m["vertices"].orderBy("vertex_id").collect()
    assert "connectivity" in meshfile.vtu_lines(m["vertices"], m["cells"], cell_data="set_id")


def test_matrix_market_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(1, 2, 0.1), (3, 1, -2.5e-7)], "ia long, ja long, val double")
    meshfile.write_matrix_market(str(tmp_path / "m"), m, 3, 3)
    assert sorted(meshfile.read_matrix_market(spark, str(tmp_path / "m")).collect()) == sorted(m.collect())


def test_matrix_market_keeps_integers_and_mirrors_symmetric_files(spark, tmp_path):
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% a comment\n\n3 3 3\n1 1 4\n2 1 0.5\n3 3 -2\n")
    assert sorted(meshfile.read_matrix_market(spark, str(tmp_path / "s.mtx")).collect()) == [(1, 1, 4.0), (1, 2, 0.5), (2, 1, 0.5), (3, 3, -2.0)]
    (tmp_path / "i.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 2 2\n1 1 4\n2 1 7\n")
    assert sorted(meshfile.read_matrix_market(spark, str(tmp_path / "i.mtx")).collect()) == [(1, 1, 4.0), (2, 1, 7.0)]
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern skew-symmetric\n2 2 1\n2 1\n")
    assert sorted(meshfile.read_matrix_market(spark, str(tmp_path / "p.mtx")).collect()) == [(1, 2, -1.0), (2, 1, 1.0)]


def test_ranks_and_prefix_sums(spark):
    from meshwright.operators import ranks

    rows = [(k % 3 if k % 7 else None, (k * 37) % 101, k) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, v int, k int")
    order = [F.col("v"), F.col("k")]
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: r[1:]), 1)}
    assert {r.k: r.r for r in ranks.ranked(df, order, "r").collect()} == want
    got = {r.k: r.r for r in ranks.ranked_in(df, "g", order, "r").collect()}
    assert got == {k: 1 + sum(h == g and (x, j) < (v, k) for h, x, j in rows) for g, v, k in rows}
    assert {r.k: r.s for r in ranks.prefix_sums(df, order, "v", "s").collect()} == {k: sum(x for _, x, j in rows if (x, j) < (v, k)) for _, v, k in rows}
    assert ranks.ranked(df.limit(0), order, "r").count() == 0 and ranks.strips(df.limit(0), order, 3).count() == 0


def test_bisection_agrees_with_ranks(spark):
    est = spark.range(1, 101).select(F.col("id").alias("cell_id"), F.col("id").cast("double").alias("est"))
    up, down = norms.fraction_by_bisection(est, 0.1, 0.05)
    flags = {r.cell_id: r.flag for r in norms.fixed_fraction(est, 0.1, 0.05).collect()}
    assert {c for c, f in flags.items() if f == 1} == {c for c in flags if c > up} and {c for c, f in flags.items() if f == -1} == {c for c in flags if c < down}


def test_running_assembly_of_a_stream(spark, tmp_path):
    from meshwright.streaming.assembly import running_matrix

    rows = [(1, 1, 2.0), (1, 2, 3.0), (1, 1, 4.0)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "ia long, ja long, val double").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ia long, ja long, val double").parquet(str(tmp_path / "in"))
    q = running_matrix(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.ia, r.ja): r.val for r in spark.table("running").collect()} == {(1, 1): 6.0, (1, 2): 3.0}


def test_windows_of_a_stream_are_final_behind_the_watermark(spark, tmp_path):
    from meshwright.streaming.assembly import windowed_matrix

    parts = [[("10:01", 1, 1, 2.0), ("10:04", 1, 1, 3.0), ("10:06", 2, 1, 1.0)], [("10:30", 1, 1, 9.0)], [("10:02", 1, 1, 100.0), ("10:31", 9, 9, 1.0), ("10:55", 1, 2, 1.0)]]
    schema = "at timestamp, ia long, ja long, val double"
    source = str(tmp_path / "in")
    stream = windowed_matrix(spark.readStream.schema(schema).parquet(source), "at", "5 minutes", "10 minutes", 5, 5) if (tmp_path / "in").mkdir() is None else None
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").start()
    for part in parts:
        rows = spark.createDataFrame([(f"2024-01-01 {t}:00", i, j, v) for t, i, j, v in part], "at string, ia long, ja long, val double")
        rows.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
    q.stop()
    got = {(r.start.strftime("%H:%M"), r.ia, r.ja): r.val for r in spark.table("windows").collect()}
    assert got == {("10:00", 1, 1): 5.0, ("10:05", 2, 1): 1.0, ("10:30", 1, 1): 9.0}


def test_an_unconverged_vector_is_no_solution(spark, monkeypatch):
    from functools import partial

    short = partial(solvers.conjugate_gradients, most=1)
    monkeypatch.setattr(poisson, "conjugate_gradients", short)
    monkeypatch.setattr(timestep, "conjugate_gradients", short)
    with pytest.raises(ArithmeticError, match="no convergence"):
        poisson.solve(spark, [4, 4], F.lit(0.0), 1 + 2 * F.col("x") - 3 * F.col("y"))
    mass = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "ia long, ja long, val double")
    stiff = spark.createDataFrame([(1, 1, 2.0), (1, 2, -1.0), (2, 1, -1.0), (2, 2, 3.0)], "ia long, ja long, val double")
    u = spark.createDataFrame([(1, 1.0), (2, 3.0)], "idx long, val double")
    with pytest.raises(ArithmeticError, match="no convergence"):
        timestep.step(mass, stiff, u, 0.1, "backward_euler", Tables(spark).cut)


def test_solver_steps_follow_the_unknowns():
    assert solvers.step_limit(49) == 500 and solvers.step_limit(1998**2) > 1998**2


def test_ordering_covers_every_component(spark):
    e = spark.createDataFrame([(2, 1), (1, 3), (3, 4), (10, 11), (11, 12), (12, 13), (20, 21), (30, 30)], "src long, dst long")
    ranks = {r.id: r["rank"] for r in graph.reverse_cuthill_mckee(e, cut=Tables(spark).cut).collect()}
    assert sorted(ranks.values()) == list(range(1, 12)) and set(ranks) == {1, 2, 3, 4, 10, 11, 12, 13, 20, 21, 30}
    assert sorted(ranks, key=ranks.get)[4:8] in ([10, 11, 12, 13], [13, 12, 11, 10]) and max(ranks[i] for i in (1, 2, 3, 4)) == 4
    assert all(abs(ranks[r.src] - ranks[r.dst]) <= 1 for r in e.collect())


def test_a_clique_of_over_100_is_coloured_whole(spark):
    n = 104
    e = spark.createDataFrame([(i, j) for i in range(n) for j in range(i)], "src long, dst long")
    assert sorted(r.colour for r in graph.colouring(e, Tables(spark).cut).collect()) == list(range(n))


def test_cut_cells_far_from_the_interior_join_it(spark):
    n = 54
    states = spark.createDataFrame([(1, "interior"), *((i, "cut") for i in range(2, n)), (100, "cut")], "cell_id long, status string")
    facets = spark.createDataFrame([(i, i + 1) for i in range(1, n - 1)], "cell_id long, neighbour long")
    assert {r.cell_id: r.root for r in cut.aggregates(states, facets, Tables(spark).cut).collect()} == dict.fromkeys(range(1, n), 1) | {100: None}


def test_schemes_fulfil_their_order_conditions():
    orders = {
        "backward_euler": 1, "forward_euler": 1, "trapezoidal": 2, "midpoint": 2, "midpoint_explicit": 2, "sdirk_2": 2, "runge_kutta_3": 3, "runge_kutta_4": 4, "runge_kutta_4_3_8": 4,
        **{f"imex_rk_{n}_{k}": o for n, o in (("2_2_1", 2), ("2_2_2", 2), ("2_3", 3), ("4_3", 3)) for k in ("implicit", "explicit")},
    }
    assert set(timestep.SCHEMES) == set(orders)
    for name, order in orders.items():
        a, b, c = (np.array(v, float) for v in timestep.SCHEMES[name])
        assert np.allclose(a.sum(axis=1), c) and np.allclose(np.triu(a, 1), 0), name
        got = [b.sum() - 1, b @ c - 1 / 2, b @ c**2 - 1 / 3, b @ a @ c - 1 / 6, b @ c**3 - 1 / 4, b @ (c * (a @ c)) - 1 / 8, b @ a @ c**2 - 1 / 12, b @ a @ a @ c - 1 / 24]
        assert np.allclose(got[: (1, 2, 4, 8)[order - 1]], 0), name


def test_gallery_of_level_sets(spark):
    def popcorn(p):
        q = 0.6 / np.sqrt(5)
        bumps = [(2 * q * np.cos(2 * k * np.pi / 5), 2 * q * np.sin(2 * k * np.pi / 5), q) for k in range(5)] + [(0, 0, 0.6), (0, 0, -0.6)]
        bumps += [(2 * q * np.cos((2 * k - 1) * np.pi / 5), 2 * q * np.sin((2 * k - 1) * np.pi / 5), -q) for k in range(5)]
        return np.linalg.norm(p) - 0.6 - sum(2 * np.exp(-np.sum((p - np.array(c)) ** 2) / 0.04) for c in bumps)

    def spiral(p):
        n, r, rd, zmin = 2 / 3, 0.2, 0.75, -1.0
        step, out, k = n / (2 * np.pi), 1e10, 0
        while (alpha := step * (np.arctan2(p[1], p[0]) + k * np.pi)) <= 4.5 * np.pi * step:
            d = np.linalg.norm(p - np.array([rd * np.cos(alpha / step), rd * np.sin(alpha / step), alpha + zmin + 1.1 * r])) - r
            out, k = (d if alpha >= 0 and abs(d) < abs(out) else out), k + 1
        d = np.hypot(p[0] - rd, p[2] - zmin - 1.1 * r) - r
        out = d if d < out and p[1] <= 0 else out
        d = np.hypot(p[1] - rd, p[2] - zmin - 1.1 * r - 4.5 * np.pi * step) - r
        return d if d < out and p[0] <= 0 else out

    at = np.random.default_rng(6).uniform(-1.2, 1.2, (300, 3))
    df = spark.createDataFrame([tuple(map(float, p)) for p in at], "x double, y double, z double")
    names = {"popcorn": (), "bullets": (), "spiral": (-1.0,)}
    rows = df.select("x", "y", "z", *(levelsets.by_name(n, *args).alias(n) for n, args in names.items())).collect()
    for r in rows:
        p = np.array([r.x, r.y, r.z])
        assert np.isclose(r.popcorn, popcorn(p)) and np.isclose(r.spiral, spiral(p))
        assert np.isclose(r.bullets, max(s - np.linalg.norm(p - np.array(c)) for s, c in levelsets.BULLETS))
