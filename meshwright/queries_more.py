"""Further registered queries: parts and exchange, blocks, solvers, elements, cut cells, containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import elements, fields, geometry, levelsets, quadrature
from meshwright.operators import blocks, containers, cut, exchange, graph, norms, octree, sparse, transfer, vector, vefs
from meshwright.plans import direct, lazy, solvers, timestep
from meshwright.plans.lineage import checkpointed
from meshwright.queries import GRID, INC, M, P, PARTS, X, grid_points, incidence, matrix, order_parts, prices, query, rounded, suppliers, table

# --- parts that share values: nations of suppliers hold the parts that these supply --------------

HELD = "(SELECT DISTINCT s_nationkey AS part, l_partkey AS gid FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
SHARED = "(SELECT s_nationkey AS part, l_partkey AS gid, sum(l_quantity)::double AS val FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
PARTED = "(SELECT s_nationkey AS part, l_partkey % 50 AS ia, l_suppkey % 50 AS ja, l_quantity AS val FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def supplied(spark, d) -> DataFrame:
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    return l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("part"), F.col("l_partkey").alias("gid"), "l_suppkey", F.col("l_quantity").cast("double").alias("val"))


def held(spark, d) -> DataFrame:
    return supplied(spark, d).select("part", "gid")


def shared(spark, d) -> DataFrame:
    return supplied(spark, d).groupBy("part", "gid").agg(F.sum("val").alias("val"))


def parted(spark, d) -> DataFrame:
    return supplied(spark, d).select("part", (F.col("gid") % 50).alias("ia"), (F.col("l_suppkey") % 50).alias("ja"), "val")


@query(f"WITH h AS {HELD}, o AS (SELECT gid, min(part) AS owner, count(*) AS copies FROM h GROUP BY 1) SELECT part, gid, owner, copies, round(1.0::double / copies, 9) AS weight FROM h JOIN o USING (gid)")
def import_plan(spark, d):
    return rounded(exchange.import_plan(held(spark, d)), "weight", digits=9)


@query(f"WITH h AS {HELD}, o AS (SELECT gid, min(part) AS owner FROM h GROUP BY 1) SELECT owner AS sender, part AS receiver, gid FROM h JOIN o USING (gid) WHERE part <> owner")
def send_lists(spark, d):
    return exchange.send_lists(held(spark, d))


@query(f"WITH h AS {HELD} SELECT a.part, b.part AS neighbour, count(*) AS shared FROM h a JOIN h b ON a.gid = b.gid AND a.part <> b.part GROUP BY 1, 2")
def part_neighbours(spark, d):
    return exchange.neighbours(held(spark, d))


@query(f"WITH v AS {SHARED}, o AS (SELECT gid, min(part) AS owner FROM v GROUP BY 1) SELECT part, gid, part = owner AS is_local, part <> owner AS is_ghost FROM v JOIN o USING (gid)")
def local_and_ghost(spark, d):
    plan = exchange.import_plan(held(spark, d))
    return plan.select("part", "gid", exchange.is_local(F.col("owner"), F.col("part")).alias("is_local"), exchange.is_ghost(F.col("owner"), F.col("part")).alias("is_ghost"))


@query(f"WITH v AS {SHARED} SELECT part, gid, sum(val) OVER (PARTITION BY gid) AS val FROM v")
def assemble_interface(spark, d):
    return exchange.assembled(shared(spark, d))


@query(f"WITH v AS {SHARED} SELECT part, gid, first_value(val) OVER (PARTITION BY gid ORDER BY part) AS val FROM v")
def refresh_ghosts(spark, d):
    return exchange.refreshed(shared(spark, d))


@query(f"WITH v AS {SHARED} SELECT part, gid, CASE WHEN part = min(part) OVER (PARTITION BY gid) THEN val ELSE 0.0 END AS val FROM v")
def zero_ghosts(spark, d):
    return exchange.zero_ghosts(shared(spark, d))


@query(f"WITH v AS {SHARED}, n AS (SELECT gid, count(*) AS n FROM v GROUP BY 1) SELECT round(sum(val * val / n), 3) AS val FROM v JOIN n USING (gid)")
def parted_dot(spark, d):
    v = shared(spark, d)
    return rounded(exchange.parted_dot(v, v), "val", digits=3)


@query(f"WITH e AS (SELECT part, ia AS gid, sum(val) AS own FROM {PARTED} WHERE ia = ja GROUP BY 1, 2) SELECT part, gid, round(own / sum(own) OVER (PARTITION BY gid), 9) AS weight FROM e")
def diagonal_weights(spark, d):
    return rounded(exchange.diagonal_weights(parted(spark, d)), "weight", digits=9)


@query(f"SELECT ia AS gid, round(sum(val * (ja + 0.5)), 3) AS val FROM {PARTED} GROUP BY 1")
def parted_spmv(spark, d):
    x = spark.range(50).select(F.col("id").alias("gid"), (F.col("id") + 0.5).alias("val"))
    return rounded(exchange.parted_spmv(parted(spark, d), x), "val", digits=3)


@query(f"WITH c AS (SELECT l_orderkey AS gid, l_linenumber AS pos, l_partkey AS v FROM lineitem JOIN {PARTS} ON cell_id = l_orderkey WHERE part = 3), k AS (SELECT gid, row_number() OVER (ORDER BY gid) AS cell_id FROM (SELECT DISTINCT gid FROM c)), u AS (SELECT v, row_number() OVER (ORDER BY v) AS vertex_id FROM (SELECT DISTINCT v FROM c)) SELECT cell_id, c.gid, count(*) AS n, sum(vertex_id)::bigint AS total FROM c JOIN k USING (gid) JOIN u USING (v) GROUP BY 1, 2")
def submesh(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("nodes"))
    part = exchange.submesh(lines, order_parts(spark, d), 3)["cells"]
    return part.select("cell_id", "gid", F.size("nodes").cast("long").alias("n"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# --- blocks -------------------------------------------------------------------------------

#: The block of each field; fields are the line numbers.
LAYOUT = (1, 2, 1, 2, 3, 3, 1)
BLOCK_OF = "([1, 2, 1, 2, 3, 3, 1])"
FIELDS = f"(SELECT l_linenumber AS fi, l_partkey % 7 + 1 AS fj, l_partkey % 30 + 1 AS ia, l_suppkey % 30 + 1 AS ja, l_quantity AS val FROM lineitem)"
BLOCKED = f"(SELECT {BLOCK_OF}[fi] AS bi, {BLOCK_OF}[fj] AS bj, ia, ja, sum(val) AS val FROM {FIELDS} WHERE (fi + fj) % 2 = 0 GROUP BY 1, 2, 3, 4)"
BLOCK_X = "(SELECT b::int AS b, i AS idx, (b * 10 + i)::double AS val FROM range(1, 4) t(b), range(1, 31) u(i))"


def field_entries(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_linenumber").alias("fi"), (F.col("l_partkey") % 7 + 1).alias("fj"), (F.col("l_partkey") % 30 + 1).alias("ia"), (F.col("l_suppkey") % 30 + 1).alias("ja"), F.col("l_quantity").alias("val"))


def blocked(spark, d) -> DataFrame:
    pairs = spark.createDataFrame([(i, j) for i in range(1, 8) for j in range(1, 8) if (i + j) % 2 == 0], "fi int, fj int")
    return blocks.insert_fields(field_entries(spark, d), blocks.field_blocks(spark, LAYOUT), pairs)


def block_vector(spark) -> DataFrame:
    i, b = spark.range(1, 31).select(F.col("id").alias("idx")), F.explode(F.array(*map(F.lit, (1, 2, 3))))
    return i.select(b.alias("b"), "idx").withColumn("val", (F.col("b") * 10 + F.col("idx")).cast("double"))


@query(f"SELECT * FROM {BLOCKED}")
def block_insert(spark, d):
    return blocked(spark, d)


@query(f"SELECT {BLOCK_OF}[fi] AS b, ia AS idx, sum(val) AS val FROM {FIELDS} GROUP BY 1, 2")
def block_insert_vector(spark, d):
    v = field_entries(spark, d).select(F.col("fi").alias("field"), F.col("ia").alias("idx"), "val")
    return blocks.insert_vector(v, blocks.field_blocks(spark, LAYOUT))


@query(f"SELECT bi AS b, ia AS idx, round(sum(m.val * x.val), 3) AS val FROM {BLOCKED} m JOIN {BLOCK_X} x ON m.bj = x.b AND m.ja = x.idx GROUP BY 1, 2")
def block_apply(spark, d):
    return rounded(blocks.apply(blocked(spark, d), block_vector(spark)), "val", digits=3)


@query(f"SELECT b, idx, round(2 * val - 0.5 * val * val, 4) AS val FROM {BLOCK_X}")
def block_axpby(spark, d):
    x = block_vector(spark)
    return rounded(blocks.axpby(2.0, x, -0.5, x.withColumn("val", F.col("val") * F.col("val"))), "val")


@query(f"SELECT sum(val * val) AS val FROM {BLOCK_X}")
def block_dot(spark, d):
    x = block_vector(spark)
    return vector.block_dot(x, x)


SWEPT = f"""d AS (SELECT bi AS b, ia AS idx, val FROM {BLOCKED} WHERE bi = bj AND ia = ja), r AS {BLOCK_X},
x1 AS (SELECT 1 AS b, idx, r.val / d.val AS val FROM r JOIN d USING (b, idx) WHERE b = 1),
s2 AS (SELECT m.ia AS idx, sum(m.val * x.val) AS val FROM {BLOCKED} m JOIN x1 x ON m.ja = x.idx WHERE bi = 2 AND bj = 1 GROUP BY 1),
x2 AS (SELECT 2 AS b, idx, (r.val - coalesce(s2.val, 0)) / d.val AS val FROM r JOIN d USING (b, idx) LEFT JOIN s2 USING (idx) WHERE b = 2)"""


@query(f"WITH {SWEPT} SELECT b, idx, round(val, 5) AS val FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2)")
def block_forward_sweep(spark, d):
    m = checkpointed(blocked(spark, d), "matrix")
    solve = {b: blocks.diagonal_solver(m, b) for b in (1, 2)}
    return rounded(blocks.sweep(m, block_vector(spark), [1, 2], solve, checkpointed), "val", digits=5)


@query(f"""WITH {SWEPT}, y AS (SELECT m.bi AS b, m.ia AS idx, sum(m.val * x.val) AS val FROM {BLOCKED} m JOIN (SELECT * FROM x1 UNION ALL SELECT * FROM x2) x ON m.bj = x.b AND m.ja = x.idx WHERE m.bi = m.bj GROUP BY 1, 2),
z2 AS (SELECT b, idx, y.val / d.val AS val FROM y JOIN d USING (b, idx) WHERE b = 2),
s1 AS (SELECT m.ia AS idx, sum(m.val * z.val) AS val FROM {BLOCKED} m JOIN z2 z ON m.ja = z.idx WHERE bi = 1 AND bj = 2 GROUP BY 1),
z1 AS (SELECT b, idx, (y.val - coalesce(s1.val, 0)) / d.val AS val FROM y JOIN d USING (b, idx) LEFT JOIN s1 USING (idx) WHERE b = 1)
SELECT b, idx, round(val, 3) AS val FROM (SELECT * FROM z1 UNION ALL SELECT * FROM z2)""")
def block_lower_upper(spark, d):
    m = checkpointed(blocked(spark, d), "matrix")
    solve = {b: blocks.diagonal_solver(m, b) for b in (1, 2)}
    return rounded(blocks.lower_upper(m, block_vector(spark), [1, 2], solve, checkpointed), "val", digits=3)


@query(f"SELECT p_partkey AS idx, coalesce(s_acctbal, 0.0) AS val FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def gather_entries(spark, d):
    return blocks.gather(suppliers(spark, d), prices(spark, d).select("idx"))


# --- operators and solvers ----------------------------------------------------------------

SQUARE = "(SELECT l_partkey % 40 + 1 AS ia, l_suppkey % 40 + 1 AS ja, sum(l_quantity) / 100 AS val FROM lineitem GROUP BY 1, 2)"
UNIT = "(SELECT i AS idx, i / 7.0::double AS val FROM range(1, 41) t(i))"


def square(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40 + 1).alias("ia"), (F.col("l_suppkey") % 40 + 1).alias("ja"))
    return t.agg((F.sum("l_quantity") / 100).alias("val"))


def unit(spark) -> DataFrame:
    return spark.range(1, 41).select(F.col("id").alias("idx"), (F.col("id") / F.lit(7.0)).alias("val"))


@query(f"WITH m AS {SQUARE}, x AS {UNIT}, y AS (SELECT ia AS idx, sum(m.val * x.val) AS val FROM m JOIN x ON ja = idx GROUP BY 1), z AS (SELECT ia AS idx, sum(m.val * y.val) AS val FROM m JOIN y ON ja = idx GROUP BY 1) SELECT idx, round(sum(val), 2) AS val FROM (SELECT idx, 2 * val AS val FROM y UNION ALL SELECT idx, -val FROM z UNION ALL SELECT idx, val FROM x UNION ALL SELECT idx, -3 * val FROM x) GROUP BY 1")
def lazy_operators(spark, d):
    """(2 A - A A + I + (-(3 I))) x."""
    a, one = lazy.of_matrix(square(spark, d)), lazy.identity()
    return rounded((2.0 * a - a @ a + one + (-(3.0 * one)))(unit(spark)), "val", digits=2)


@query(f"WITH m AS {SQUARE}, x AS {UNIT} SELECT idx, round(sum(val), 3) AS val FROM (SELECT ia AS idx, sum(m.val * x.val) AS val FROM m JOIN x ON ja = idx GROUP BY 1 UNION ALL SELECT idx, -val FROM x) GROUP BY 1")
def residual(spark, d):
    x = unit(spark)
    return rounded(lazy.of_matrix(square(spark, d)).residual(x, x), "val", digits=3)


def small_system(spark, d) -> tuple[DataFrame, DataFrame]:
    """A diagonally dominant matrix over the regions, and the right side of the solution key + 0.25."""
    key = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("i"))
    m = key.crossJoin(F.broadcast(key.select(F.col("i").alias("j")))).select(F.col("i").alias("ia"), F.col("j").alias("ja"), F.when(F.col("i") == F.col("j"), 20.0 + F.col("i")).otherwise(1.0 / (F.col("i") + F.col("j"))).alias("val"))
    x = key.select(F.col("i").alias("idx"), (F.col("i") + 0.25).alias("val"))
    return m, sparse.spmv(m, x)


KNOWN = "SELECT r_regionkey + 1 AS idx, round(r_regionkey + 1.25::double, 6) AS val FROM region"


def solved_by(name: str):
    def run(spark, d):
        m, b = small_system(spark, d)
        return rounded(solvers.solution(solvers.solve(name, m, b, tolerance=1e-9)), "val", digits=6)

    run.__name__, run.__doc__ = f"solve_{name}", f"The system of the regions by {name}: its solution is key + 0.25."
    return run


for _name in solvers.SOLVERS:
    query(KNOWN)(solved_by(_name))


@query("SELECT n_regionkey AS system, k::int AS k, n_nationkey AS idx, round((n_nationkey + 1) * (k + 1)::double, 6) AS val FROM nation, range(3) t(k)")
def direct_solves(spark, d):
    """One system for each region over its nations, with three right sides each."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("system"), F.col("n_nationkey").cast("long").alias("i"))
    m = n.join(n.select("system", F.col("i").alias("j")), "system").select("system", F.col("i").alias("ia"), F.col("j").alias("ja"), F.when(F.col("i") == F.col("j"), 30.0).otherwise(1.0).alias("val"))
    ks = n.select("system", "i", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    b = m.join(ks.select("system", F.col("i").alias("ja"), "k"), ["system", "ja"]).groupBy("system", "k", F.col("ia").alias("idx")).agg(F.sum(F.col("val") * (F.col("ja") + 1) * (F.col("k") + 1)).alias("val"))
    return rounded(direct.solve(m, b), "val", digits=6)


@query("SELECT r_regionkey + 1 AS idx, round(sqrt(r_regionkey + 2.0), 6) AS val FROM region")
def newton_roots(spark, d):
    """u^2 = key + 2 for every unknown."""
    start = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("idx"), F.lit(2.0).alias("val"))
    rest = lambda u: u.select("idx", (F.col("val") * F.col("val") - F.col("idx") - 1).alias("val"))
    solve = lambda u, r: u.select("idx", F.col("val").alias("u")).join(r, "idx").select("idx", (F.col("val") / (2 * F.col("u"))).alias("val"))
    return rounded(solvers.solution(solvers.newton(rest, solve, start)), "val", digits=6)


def decay(spark, d, scheme: str) -> DataFrame:
    r = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("i"))
    one = r.select(F.col("i").alias("ia"), F.col("i").alias("ja"), F.lit(1.0).alias("val"))
    rate = r.select(F.col("i").alias("ia"), F.col("i").alias("ja"), (F.col("i") / F.lit(2.0)).alias("val"))
    u = r.select(F.col("i").alias("idx"), F.col("i").cast("double").alias("val"))
    return rounded(timestep.step(one, rate, u, 0.2, scheme), "val", digits=8)


Z = "((r_regionkey + 1) / 10.0::double)"


@query(f"SELECT r_regionkey + 1 AS idx, round((r_regionkey + 1) / (1 + {Z}), 8) AS val FROM region")
def step_backward_euler(spark, d):
    """One step of u' = -(key / 2) u."""
    return decay(spark, d, "backward_euler")


@query(f"SELECT r_regionkey + 1 AS idx, round((r_regionkey + 1) * (1 - {Z} / 2) / (1 + {Z} / 2), 8) AS val FROM region")
def step_trapezoidal(spark, d):
    return decay(spark, d, "trapezoidal")


@query(f"SELECT r_regionkey + 1 AS idx, round((r_regionkey + 1) * (1 - {Z} + pow({Z}, 2) / 2 - pow({Z}, 3) / 6 + pow({Z}, 4) / 24), 8) AS val FROM region")
def step_runge_kutta_4(spark, d):
    return decay(spark, d, "runge_kutta_4")


# --- products, updates, scatters -------------------------------------------------------------


@query(f"SELECT idx, round(sum(val), 3) AS val FROM (SELECT ia AS idx, m.val * x.val AS val FROM {M} m JOIN {X} x ON m.ja = x.idx UNION ALL SELECT idx, val FROM {P}) GROUP BY 1")
def spmv_add(spark, d):
    return rounded(vector.axpby(1.0, sparse.spmv(matrix(spark, d), suppliers(spark, d)), 1.0, prices(spark, d)), "val", digits=3)


@query(f"SELECT idx, round(sum(val), 3) AS val FROM (SELECT ja AS idx, m.val * x.val AS val FROM {M} m JOIN {P} x ON m.ia = x.idx UNION ALL SELECT idx, val FROM {X}) GROUP BY 1")
def spmv_t_add(spark, d):
    return rounded(vector.axpby(1.0, sparse.spmv(matrix(spark, d), prices(spark, d), transposed=True), 1.0, suppliers(spark, d)), "val", digits=3)


MEMBERS = "(SELECT k::int AS k, p_partkey AS idx, p_retailprice * (k + 1) AS val FROM part, range(3) t(k))"


def members(spark, d) -> DataFrame:
    return prices(spark, d).select(F.explode(F.array(*map(F.lit, range(3)))).alias("k"), "idx", "val").withColumn("val", F.col("val") * (F.col("k") + 1))


@query(f"SELECT k, ja AS idx, round(sum(m.val * x.val), 2) AS val FROM {M} m JOIN {MEMBERS} x ON m.ia = x.idx GROUP BY 1, 2")
def spmm_transposed(spark, d):
    return rounded(sparse.spmm(matrix(spark, d), members(spark, d), transposed=True), "val", digits=2)


@query(f"SELECT k, idx, round(sum(val), 2) AS val FROM (SELECT x.k, ja AS idx, 0.5 * m.val * x.val AS val FROM {M} m JOIN {MEMBERS} x ON m.ia = x.idx UNION ALL SELECT k, idx, 2 * val FROM {MEMBERS}) GROUP BY 1, 2")
def gemm_transposed(spark, d):
    v = members(spark, d)
    return rounded(sparse.gemm(matrix(spark, d), v, v, 0.5, 2.0, transposed=True), "val", digits=2)


@query(f"SELECT ia, ja, 2.5 * sum(val) AS val FROM {M} GROUP BY 1, 2")
def scale_matrix(spark, d):
    return sparse.scale(sparse.compress(matrix(spark, d)), 2.5)


@query(f"WITH m AS (SELECT ia, ja, sum(val) AS val FROM {M} GROUP BY 1, 2) SELECT ia, ja, val + CASE WHEN ia = ja THEN 7.0 ELSE 0 END AS val FROM m")
def update_entries(spark, d):
    """Adding to the diagonal changes existing entries only."""
    change = prices(spark, d).select(F.col("idx").alias("ia"), F.col("idx").alias("ja"), F.lit(7.0).alias("val"))
    return sparse.update(sparse.compress(matrix(spark, d)), change)


@query("SELECT ia, ja, sum(v)::double AS val FROM (SELECT unnest([l_partkey, l_suppkey]) AS ia, l_partkey AS ja, unnest([l_quantity, 1]) AS v FROM lineitem UNION ALL SELECT unnest([l_partkey, l_suppkey]), l_suppkey, unnest([2, l_linenumber]) FROM lineitem) GROUP BY 1, 2")
def insert_blocks(spark, d):
    """Each order line is a dense 2x2 block over its part and its supplier."""
    ids = F.array("l_partkey", "l_suppkey")
    cell = F.array(F.array(F.col("l_quantity").cast("double"), F.lit(2.0)), F.array(F.lit(1.0), F.col("l_linenumber").cast("double")))
    return sparse.compress(sparse.insert_blocks(table(spark, d, "lineitem").select(ids.alias("rows"), ids.alias("cols"), cell.alias("block"))))


@query(f"SELECT idx, coalesce(n, val) AS val FROM {P} FULL JOIN (SELECT s_suppkey AS idx, s_acctbal AS n FROM supplier WHERE s_nationkey < 12) USING (idx)")
def scatter_put(spark, d):
    s = table(spark, d, "supplier").where("s_nationkey < 12")
    return vector.scatter(prices(spark, d), s.select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("val"), F.lit(1).alias("seq")), add=False)


@query(f"SELECT idx, round(sum(val), 4) AS val FROM (SELECT idx, val FROM {P} UNION ALL SELECT idx, val FROM {X}) GROUP BY 1")
def scatter_add(spark, d):
    return rounded(vector.scatter(prices(spark, d), suppliers(spark, d), add=True), "val")


@query("WITH m AS (SELECT DISTINCT l_partkey AS ia, l_suppkey AS ja FROM lineitem) SELECT CASE WHEN ia <= 1000 THEN 'I' ELSE 'G' END || CASE WHEN ja <= 50 THEN 'I' ELSE 'G' END AS block, CASE WHEN ia <= 1000 THEN ia ELSE ia - 1000 END AS ia, CASE WHEN ja <= 50 THEN ja ELSE ja - 50 END AS ja FROM m")
def split_pattern(spark, d):
    return sparse.split_2x2(sparse.pattern(matrix(spark, d)).withColumn("val", F.lit(1.0)), 1000, 50).drop("val")


@query("WITH m AS (SELECT DISTINCT l_partkey AS ia, l_suppkey AS ja FROM lineitem) SELECT ia, ja FROM m UNION ALL SELECT ia, ja + 100000 FROM m UNION ALL SELECT ja + 100000, ia FROM m UNION ALL SELECT s_suppkey + 100000, s_suppkey + 100000 FROM supplier")
def expand_pattern(spark, d):
    m = sparse.pattern(matrix(spark, d)).withColumn("val", F.lit(1.0))
    eye = suppliers(spark, d).select(F.col("idx").alias("ia"), F.col("idx").alias("ja"), F.lit(1.0).alias("val"))
    return sparse.expand(m, 100_000, m, eye).drop("val")


# --- faces of cells ----------------------------------------------------------------------------

NX, NY = 12, 7


def plane(spark) -> DataFrame:
    from meshwright.sources import structured

    return structured.cells(spark, [NX, NY])


EDGES = f"""(SELECT j * {NX + 1} + i + 1 AS a, j * {NX + 1} + i + 2 AS b, CASE WHEN j IN (0, {NY}) THEN 1 ELSE 2 END AS n_cells FROM range({NX}) t(i), range({NY + 1}) u(j)
UNION ALL SELECT j * {NX + 1} + i + 1, (j + 1) * {NX + 1} + i + 1, CASE WHEN i IN (0, {NX}) THEN 1 ELSE 2 END FROM range({NX + 1}) t(i), range({NY}) u(j))"""


@query(f"SELECT row_number() OVER (ORDER BY a, b) AS vef_id, a, b, n_cells::bigint AS n_cells FROM {EDGES}")
def unique_edges(spark, d):
    return vefs.unique(plane(spark), 2, 1).select("vef_id", F.get("key", 0).alias("a"), F.get("key", 1).alias("b"), "n_cells")


@query(f"SELECT a, b FROM {EDGES} WHERE n_cells = 1")
def boundary_edges(spark, d):
    return vefs.boundary_faces(plane(spark), 2, 1).select(F.get("key", 0).alias("a"), F.get("key", 1).alias("b"))


@query(f"SELECT DISTINCT unnest([a, b]) AS vertex FROM {EDGES} WHERE n_cells = 1")
def boundary_vertices(spark, d):
    return vefs.boundary_faces(plane(spark), 2, 0).select(F.get("key", 0).alias("vertex"))


@query(f"SELECT a, b, CASE WHEN n_cells = 1 AND a <= {NX + 1} AND b <= {NX + 1} THEN 5 ELSE 0 END AS set_id, CASE WHEN n_cells = 1 AND a <= {NX + 1} AND b <= {NX + 1} THEN 6 ELSE 0 END AS geo_id FROM {EDGES}")
def edge_sets(spark, d):
    """The lower side's edges have a set in the boundary table."""
    side = spark.range(NX).select(F.array(F.col("id") + 2, F.col("id") + 1).alias("nodes"), F.lit(5).alias("set_id"), F.lit(6).alias("geo_id"))
    return vefs.with_sets(vefs.unique(plane(spark), 2, 1), side).select(F.get("key", 0).alias("a"), F.get("key", 1).alias("b"), "set_id", "geo_id")


@query(f"WITH c AS (SELECT i + {NX} * j + 1 AS cell_id, [j * {NX + 1} + i + 1, j * {NX + 1} + i + 2] AS lo, [(j + 1) * {NX + 1} + i + 1, (j + 1) * {NX + 1} + i + 2] AS hi FROM range({NX}) t(i), range({NY}) u(j)), e AS (SELECT cell_id, lo[1] AS a, lo[2] AS b FROM c UNION ALL SELECT cell_id, hi[1], hi[2] FROM c UNION ALL SELECT cell_id, lo[1], hi[1] FROM c UNION ALL SELECT cell_id, lo[2], hi[2] FROM c) SELECT dense_rank() OVER (ORDER BY a, b) AS vef_id, cell_id FROM e")
def cells_around_edges(spark, d):
    p = plane(spark)
    return vefs.cells_around(p, vefs.unique(p, 2, 1), 2, 1).select("vef_id", "cell_id")


@query("SELECT * FROM (VALUES (0, 4 * 3 * 5), (1, 3 * 3 * 5 + 4 * 2 * 5 + 4 * 3 * 4), (2, 4 * 2 * 4 + 3 * 3 * 4 + 3 * 2 * 5), (3, 3 * 2 * 4)) t(dim, n)")
def faces_of_a_box(spark, d):
    from meshwright.sources import structured

    return vefs.euler_number(structured.cells(spark, [3, 2, 4]), 3)


@query(f"SELECT count(*) AS n, max(dof_id) AS top, sum(c) AS rows FROM (SELECT i + {3 * NX + 1} * j + 1 AS dof_id, (CASE WHEN i % 3 = 0 AND i > 0 AND i < {3 * NX} THEN 2 ELSE 1 END) * (CASE WHEN j % 3 = 0 AND j > 0 AND j < {3 * NY} THEN 2 ELSE 1 END) AS c FROM range({3 * NX + 1}) t(i), range({3 * NY + 1}) u(j))")
def dof_numbering(spark, d):
    """Unknowns of order three: one a vertex, two an edge, four a cell; numbers are gapless and shared by the cells around."""
    rows = vefs.dofs(plane(spark), 2, {0: 1, 1: 2, 2: 4})
    return rows.agg(F.countDistinct("dof_id").alias("n"), F.max("dof_id").alias("top"), F.count("*").alias("rows"))


# --- elements -----------------------------------------------------------------------------------


@query("SELECT i + 13 * j + 1 AS idx, round(pow(i / 12.0::double, 2) - pow(j / 12.0::double, 2) + 3 * i * j / 144.0::double, 7) + 0.0 AS val FROM range(13) a(i), range(13) b(j)")
def poisson_q2(spark, d):
    """Order two on a 6x6 grid with a harmonic solution of degree two, which these elements have exactly."""
    from meshwright.plans.poisson import solve

    x, y = F.col("x"), F.col("y")
    return rounded(solve(spark, [6, 6], F.lit(0.0), x * x - y * y + 3 * x * y, order=2)[0], "val", digits=7)


@query("SELECT (i + 4 * j) * 4 + a + 2 * b + 1 AS idx, round(1 + 2 * (i + a) / 4.0::double - 3 * (j + b) / 3.0::double, 7) + 0.0 AS val FROM range(4) t(i), range(3) u(j), range(2) v(a), range(2) w(b)")
def poisson_dg(spark, d):
    """Discontinuous elements coupled across edges, with a linear solution."""
    from meshwright.plans.facets import solve_broken

    return rounded(solve_broken(spark, [4, 3], F.lit(0.0), 1 + 2 * F.col("x") - 3 * F.col("y")), "val", digits=7)


@query("SELECT a::int AS a, b::int AS b, round(CASE WHEN a % 2 = 0 AND b % 2 = 0 THEN 4.0 / ((a + 1) * (b + 1)) ELSE 0 END, 9)::double AS val FROM range(6) t(a), range(6) u(b)")
def quadrature_square(spark, d):
    """Integrals of x^a y^b over [-1, 1]^2 by three points a direction: exact up to degree five."""
    rule = spark.createDataFrame([(p[0], p[1], w) for p, w in quadrature.cube(3, 2)], "x double, y double, w double")
    return moments(spark, rule, 6, 6)


@query("SELECT a::int AS a, b::int AS b, round(gamma(a + 1) * gamma(b + 1) / gamma(a + b + 3), 9) AS val FROM range(4) t(a), range(4) u(b) WHERE a + b <= 5")
def quadrature_triangle(spark, d):
    rule = spark.createDataFrame([(p[0], p[1], w) for p, w in quadrature.simplex(4, 2)], "x double, y double, w double")
    return moments(spark, rule, 4, 4).where("a + b <= 5")


def moments(spark, rule: DataFrame, most_a: int, most_b: int) -> DataFrame:
    powers = spark.createDataFrame([(a, b) for a in range(most_a) for b in range(most_b)], "a int, b int")
    at = rule.crossJoin(F.broadcast(powers))
    return rounded(at.groupBy("a", "b").agg(F.sum(F.col("w") * F.pow("x", "a") * F.pow("y", "b")).alias("val")), "val", digits=9)


PLACES = "(SELECT p_partkey AS point_id, p_partkey % 21 / 10.0::double - 1 AS x, p_size / 25.0::double - 1 AS y FROM part)"


def places(spark, d) -> DataFrame:
    t = table(spark, d, "part")
    return t.select(F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 21 / F.lit(10.0) - 1).alias("x"), (F.col("p_size") / F.lit(25.0) - 1).alias("y"))


@query(f"SELECT point_id, round((1 - x) / 4, 9) AS left_x, round((1 + x) / 4, 9) AS right_x, round((1 - y) / 4, 9) AS low_y, round((1 + y) / 4, 9) AS high_y FROM {PLACES}")
def raviart_thomas(spark, d):
    """The functions of lowest order with a normal moment of 1 on one side of the square each."""
    p = places(spark, d).withColumn("v", elements.MomentElement("div", 1, 2).columns([F.col("x"), F.col("y")]))
    at = lambda f, c: F.get(F.get("v", f), c)
    return rounded(p.select("point_id", at(0, 0).alias("left_x"), at(1, 0).alias("right_x"), at(2, 1).alias("low_y"), at(3, 1).alias("high_y")), "left_x", "right_x", "low_y", "high_y", digits=9)


@query(f"SELECT point_id, round((1 - y) / 4, 9) AS low_x, round((1 + y) / 4, 9) AS high_x, round((1 - x) / 4, 9) AS left_y, round((1 + x) / 4, 9) AS right_y FROM {PLACES}")
def nedelec(spark, d):
    """The functions of lowest order with a tangential moment of 1 on one edge of the square each."""
    p = places(spark, d).withColumn("v", elements.MomentElement("curl", 1, 2).columns([F.col("x"), F.col("y")]))
    at = lambda f, c: F.get(F.get("v", f), c)
    return rounded(p.select("point_id", at(0, 0).alias("low_x"), at(1, 0).alias("high_x"), at(2, 1).alias("left_y"), at(3, 1).alias("right_y")), "low_x", "high_x", "left_y", "right_y", digits=9)


@query(f"SELECT point_id, round((2 * x + 0.5 * y) / 6, 8) + 0.0 AS flux_x, round(3 * y / 6, 8) + 0.0 AS flux_y, round(x / 2, 8) + 0.0 AS turn_x, round((y - 0.25 * x) / 3, 8) + 0.0 AS turn_y FROM {PLACES}")
def piola_maps(spark, d):
    """The vector (x, y) carried by the map with rows (2, 0) and (0.5, 3) of derivatives: its flux and its circulation are kept."""
    j = F.array(F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    v = F.array("x", "y", F.lit(0.0))
    p = places(spark, d).withColumns({"f": elements.contravariant(v, j, fields.determinant(j, 3)), "t": elements.covariant(v, fields.inverse(j, 3))})
    return rounded(p.select("point_id", F.get("f", 0).alias("flux_x"), F.get("f", 1).alias("flux_y"), F.get("t", 0).alias("turn_x"), F.get("t", 1).alias("turn_y")), "flux_x", "flux_y", "turn_x", "turn_y", digits=8)


CORNERS = "(SELECT s_suppkey AS cell_id, s_acctbal AS a, s_acctbal * 2 + 1 AS b, s_nationkey::double AS c, s_acctbal - s_nationkey AS e FROM supplier)"


def nodal(spark, d) -> DataFrame:
    t = table(spark, d, "supplier")
    a, n = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    return t.select(F.col("s_suppkey").alias("cell_id"), F.array(a, a * 2 + 1, n, a - n).alias("vals"))


@query(f"WITH v AS (SELECT cell_id, k, CASE k WHEN 0 THEN [a, (a + b) / 2, (a + c) / 2, (a + b + c + e) / 4] WHEN 1 THEN [(a + b) / 2, b, (a + b + c + e) / 4, (b + e) / 2] WHEN 2 THEN [(a + c) / 2, (a + b + c + e) / 4, c, (c + e) / 2] ELSE [(a + b + c + e) / 4, (b + e) / 2, (c + e) / 2, e] END AS w FROM {CORNERS}, range(4) t(k)) SELECT cell_id, k::int AS child, round(w[1], 5) AS v0, round(w[2], 5) AS v1, round(w[3], 5) AS v2, round(w[4], 5) AS v3 FROM v")
def refine_values(spark, d):
    """Each cell's four corner values interpolated to those of its children."""
    return rounded(transfer.refined(nodal(spark, d), 1, 2).select("cell_id", "child", *(F.get("vals", k).alias(f"v{k}") for k in range(4))), "v0", "v1", "v2", "v3", digits=5)


@query(f"SELECT cell_id, round(a, 5) AS v0, round(b, 5) AS v1, round(c, 5) AS v2, round(e, 5) AS v3 FROM {CORNERS}")
def coarsen_values(spark, d):
    """Refined values projected back are the values before."""
    back = transfer.coarsened(transfer.refined(nodal(spark, d), 1, 2), 1, 2)
    return rounded(back.select("cell_id", *(F.get("vals", k).alias(f"v{k}") for k in range(4))), "v0", "v1", "v2", "v3", digits=5)


# --- geometry, formulas, tensors -----------------------------------------------------------------


@query(f"SELECT point_id, round(2 * sqrt((2 + x) * 3 / sqrt((9 + y * y) / 9)), 7) AS h, round(least(2 * (2 + x) / sqrt((9 + y * y) / 9), 6.0), 7) AS h_min, round(greatest(2 * (2 + x) / sqrt((9 + y * y) / 9), 6.0), 7) AS h_max FROM {GRID}")
def cell_lengths(spark, d):
    """Of the map with rows (2 + x, 0) and (y, 3) of derivatives."""
    p = grid_points(spark, d)
    j = F.array(F.array(2 + F.col("x"), F.lit(0.0)), F.array(F.col("y"), F.lit(3.0)))
    k = fields.inverse(j, 2)
    out = p.select("point_id", geometry.characteristic_length(k, 2).alias("h"), geometry.shortest(k, 2).alias("h_min"), geometry.longest(k, 2).alias("h_max"))
    return rounded(out, "h", "h_min", "h_max", digits=7)


@query(f"SELECT point_id, round(sqrt(x * x + pow(2 + y, 2)), 8) AS size, round((2 + y) / sqrt(x * x + pow(2 + y, 2)), 8) AS nx, round(-x / sqrt(x * x + pow(2 + y, 2)), 8) + 0.0 AS ny FROM {GRID}")
def facet_normals(spark, d):
    t = F.array(F.col("x"), 2 + F.col("y"), F.lit(0.0))
    p = grid_points(spark, d).withColumn("n", geometry.facet_normal(t)).withColumn("size", geometry.facet_measure(t))
    return rounded(p.select("point_id", "size", F.get("n", 0).alias("nx"), F.get("n", 1).alias("ny")), "size", "nx", "ny", digits=8)


@query(f"SELECT point_id, round(a / n, 8) + 0.0 AS tx, round(b / n, 8) + 0.0 AS ty, round(c / n, 8) + 0.0 AS tz FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (SELECT point_id, 3 - x AS a, -5.0::double AS b, 1.0::double AS c FROM {GRID}))")
def edge_tangents(spark, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    t = geometry.unit_tangent(F.array(x, F.lit(5.0) - y + y, z), F.array(F.lit(3.0), F.lit(0.0) * y, z + 1))
    p = grid_points(spark, d).withColumn("v", t)
    return rounded(p.select("point_id", *(F.get("v", k).alias(n) for k, n in enumerate(("tx", "ty", "tz")))), "tx", "ty", "tz", digits=8)


@query(f"SELECT point_id, round(x * y, 8) + 0.0 AS value, round(y, 8) + 0.0 AS gx, round(x, 8) + 0.0 AS gy, round(x + t, 8) + 0.0 AS v0, round(z * 2, 8) + 0.0 AS v1, round(2.0 - y, 8) + 0.0 AS curl_z, round(x * 1.0 + 3, 8) + 0.0 AS divergence, round(3 * t * t, 8) + 0.0 AS rate FROM {GRID}")
def parsed_functions(spark, d):
    """Scalar, vector and tensor formulas with given gradients; curl and divergence from a gradient; a derivative by t; components."""
    grad = fields.with_gradient("x*y", ["y", "x", "0"])
    v = fields.vector("x + t", "2*z", "y")
    g = fields.tensor([["x", "2", "0"], ["y", "1", "0"], ["0", "0", "2"]])
    rate = fields.component(fields.time_derivatives("t^3", "3*t^2", "6*t"), 1)
    p = grid_points(spark, d).withColumns({"s": grad, "v": v, "g": g})
    out = p.select(
        "point_id", F.col("s.value").alias("value"), F.get("s.gradient", 0).alias("gx"), F.get("s.gradient", 1).alias("gy"), fields.component(F.col("v"), 0).alias("v0"), fields.component(F.col("v"), 1).alias("v1"),
        F.get(fields.curl_of(F.col("g")), 2).alias("curl_z"), fields.divergence_of(F.col("g")).alias("divergence"), rate.alias("rate"),
    )
    return rounded(out, "value", "gx", "gy", "v0", "v1", "curl_z", "divergence", "rate", digits=8)


@query(f"SELECT point_id, round(x * x + 2 * y + z, 8) + 0.0 AS tv, round(x * x + y + 3 * z, 8) + 0.0 AS vt, round(x * x + 2 + 3, 8) + 0.0 AS tt, round(x * x + 4 + 1 + 1 + y * y + z * z + 9 + 0 + 1, 8) + 0.0 AS contraction, round((2 + 1) / 2.0::double, 8) AS symmetric, round(x + y + 1, 8) + 0.0 AS trace, round(x + y, 8) + 0.0 AS plus, round(x - y, 8) + 0.0 AS minus, round(2.5 * x, 8) + 0.0 AS scaled, round(z * y - x * x, 8) + 0.0 AS cy FROM {GRID}")
def tensor_products(spark, d):
    """Products of the tensor ((x, 2, 1), (1, y, z), (3, 0, 1)) and the vectors (x, y, z) and (y, z, x)."""
    x, y, z, one = F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)
    t = F.array(F.array(x, F.lit(2.0), one), F.array(one, y, z), F.array(F.lit(3.0), F.lit(0.0), one))
    p = grid_points(spark, d).withColumns({"T": t, "v": F.array(x, y, z), "u": F.array(y, z, x)})
    tt, v, u = F.col("T"), F.col("v"), F.col("u")
    out = p.select(
        "point_id", F.get(fields.tensor_vector(tt, v), 0).alias("tv"), F.get(fields.vector_tensor(v, tt), 0).alias("vt"), F.get(F.get(fields.tensor_tensor(tt, tt), 0), 0).alias("tt"),
        fields.double_contraction(tt, tt).alias("contraction"), F.get(F.get(fields.symmetric_part(tt), 0), 1).alias("symmetric"), fields.trace(tt).alias("trace"),
        F.get(fields.plus(v, u), 0).alias("plus"), F.get(fields.minus(v, u), 0).alias("minus"), F.get(fields.times(F.lit(2.5), v), 0).alias("scaled"), F.get(fields.cross(v, u), 1).alias("cy"),
    )
    return rounded(out, "tv", "vt", "tt", "contraction", "symmetric", "trace", "plus", "minus", "scaled", "cy", digits=8)


_S = levelsets.CHEESE[0]
_BULLETS = ", ".join(f"sqrt(pow(x - {c[0]}, 2) + pow(y - {c[1]}, 2) + pow(z - {c[2]}, 2)) - {r}" for r, c in levelsets.BULLETS)


@query(f"WITH q AS (SELECT *, pow({_S} * x, 2) AS a, pow({_S} * y, 2) AS b, pow({_S} * z, 2) AS c FROM {GRID}) SELECT point_id, round(pow(a + b - 4, 2) + pow(b + c - 4, 2) + pow(c + a - 4, 2) + pow(a - 1.2, 2) + pow(b - 1.2, 2) + pow(c - 1.2, 2) - 12, 6) AS cheese, round(-least({_BULLETS}), 6) AS bullets FROM q")
def level_set_gallery(spark, d):
    out = grid_points(spark, d).select("point_id", levelsets.by_name("cheese_block").alias("cheese"), levelsets.by_name("bullets").alias("bullets"))
    return rounded(out, "cheese", "bullets", digits=6)


@query("SELECT l_returnflag AS region, round(sum(w * (abs(a) + abs(b))), 2) AS l1, round(sqrt(sum(w * (a * a + b * b))), 4) AS l2, round(greatest(max(abs(a)), max(abs(b))), 4) AS linfty, round(sum(w * (a + b + a * b + 1)), 2) AS tensor_mean, round(sqrt(sum(w * (a * a + b * b + a * a * b * b + 1))), 4) AS tensor_l2 FROM (SELECT l_returnflag, l_tax + 0.01 AS w, l_quantity / 10 - 2.5 AS a, l_discount * 20 - 1 AS b FROM lineitem) GROUP BY 1")
def vector_error_norms(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("region"), (F.col("l_tax") + 0.01).alias("w"), (F.col("l_quantity") / 10 - 2.5).alias("a"), (F.col("l_discount") * 20 - 1).alias("b"))
    t = t.withColumn("e", F.array("a", "b")).withColumn("m", F.array(F.array("a", "b"), F.array(F.col("a") * F.col("b"), F.lit(1.0))))
    v, m = norms.vector_norms(), norms.tensor_norms("m")
    out = t.groupBy("region").agg(*(v[k].alias(k) for k in ("l1", "l2", "linfty")), m["mean"].alias("tensor_mean"), m["l2"].alias("tensor_l2"))
    return rounded(rounded(out, "l1", "tensor_mean", digits=2), "l2", "linfty", "tensor_l2")


@query("SELECT l_returnflag AS region, round(sqrt(sum(w * (a * a + b * b))), 4) AS h1_seminorm, round(sqrt(sum(w * (e * e + a * a + b * b))), 4) AS h1, round(greatest(max(abs(a)), max(abs(b))), 4) AS w1infty_seminorm, round(max(abs(e)) + greatest(max(abs(a)), max(abs(b))), 4) AS w1infty, round(pow(sum(w * (pow(abs(a), 3) + pow(abs(b), 3))), 1.0 / 3), 4) AS w1p_seminorm, round(pow(sum(w * (pow(abs(e), 3) + pow(abs(a), 3) + pow(abs(b), 3))), 1.0 / 3), 4) AS w1p FROM (SELECT l_returnflag, l_tax + 0.01 AS w, l_quantity / 10 - 2.5 AS e, l_discount * 20 - 1 AS a, l_linenumber / 4.0::double - 1 AS b FROM lineitem) GROUP BY 1")
def sobolev_norms(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("region"), (F.col("l_tax") + 0.01).alias("w"), (F.col("l_quantity") / 10 - 2.5).alias("e"), (F.col("l_discount") * 20 - 1).alias("a"), (F.col("l_linenumber") / F.lit(4.0) - 1).alias("b"))
    names = ("h1_seminorm", "h1", "w1infty_seminorm", "w1infty", "w1p_seminorm", "w1p")
    return rounded(t.groupBy("region").agg(*(norms.norm(n, gradient=("a", "b"), p=3.0).alias(n) for n in names)), *names)


# --- cut cells, trees, graphs -------------------------------------------------------------------------

def disc(spark) -> DataFrame:
    """A grid over [-1, 1]^2 with the level set x + 2y - 0.3 at its corners, which is linear, so areas are exact."""
    from meshwright.plans.assembly import cell_points
    from meshwright.sources import structured

    cells, points = structured.cells(spark, [16, 16]), structured.vertices(spark, [16, 16], [(-1.0, 1.0)] * 2)
    return cut.nodal(cell_points(cells, points), points.select("vertex_id", (F.col("x") + 2 * F.col("y") - 0.3).alias("phi")))


@query("SELECT round(area, 8) AS area FROM (SELECT 2.3::double AS area)")
def cut_area(spark, d):
    """The part of the square below the line: both formulas, by shares and by sub-cells, meet the exact area."""
    cells = disc(spark)
    by_share = cut.negative_area(cells).agg(F.sum("area").alias("a"))
    by_pieces = cut.subcells(cells).where("side = -1").agg(F.sum(cut.triangle_area(F.col("xy"))).alias("b"))
    return by_share.crossJoin(by_pieces).select(F.when(F.abs(F.col("a") - F.col("b")) < 1e-9, F.round("a", 8)).alias("area"))


@query("SELECT round(sqrt(5.0), 7) AS length")
def cut_length(spark, d):
    """The line's length inside the square: it goes from (-1, 0.65) to (1, -0.35)."""
    at = lambda k, i: F.get(F.get("xy", k), i)
    length = F.sqrt(F.pow(at(0, 0) - at(1, 0), F.lit(2.0)) + F.pow(at(0, 1) - at(1, 1), F.lit(2.0)))
    return rounded(cut.cut_lines(disc(spark)).agg(F.sum(length).alias("length")), "length", digits=7)


@query("WITH v AS (SELECT l_orderkey AS facet, min(l_quantity - 25) AS lo, max(l_quantity - 25) AS hi FROM lineitem GROUP BY 1) SELECT facet, lo < 0 AND hi > 0 AS is_cut FROM v")
def cut_facets(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("facet")).agg(F.collect_list(F.col("l_quantity") - 25).alias("phi"))
    return t.select("facet", cut.facet_is_cut(F.col("phi")).alias("is_cut"))


@query("WITH s AS (SELECT l_orderkey, min(l_quantity - 25) AS lo, max(l_quantity - 25) AS hi FROM lineitem GROUP BY 1) SELECT CASE WHEN lo < 0 AND hi > 0 THEN 'cut' WHEN hi <= 0 THEN 'interior' ELSE 'exterior' END AS status, count(*) AS n FROM s GROUP BY 1")
def cut_counts(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.collect_list(F.col("l_quantity") - 25).alias("phi"))
    return cut.counts(t.select(cut.status(F.col("phi")).alias("status")))


@query("SELECT c_custkey AS cell_id, dense_rank() OVER (ORDER BY c_nationkey) AS place FROM customer")
def dense_ids(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), "c_nationkey")
    return cut.dense_ids(t, "c_nationkey", "place").select("cell_id", "place")


@query("WITH b AS (SELECT c_nationkey, greatest(max(c_acctbal) - min(c_acctbal), (max(c_custkey) - min(c_custkey))::double, 0) AS size FROM customer GROUP BY 1) SELECT c_custkey AS cell_id, round(size, 4) AS size FROM customer JOIN b USING (c_nationkey)")
def aggregate_boxes(spark, d):
    t = table(spark, d, "customer")
    m = t.select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("root"))
    return rounded(cut.aggregate_sizes(m, t.select(F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"), F.lit(0.0).alias("z"))), "size")


@query("SELECT p_partkey AS dof_id, k + 1 AS master_id, round((CASE WHEN k % 2 = 1 THEN u ELSE 1 - u END) * (CASE WHEN k >= 2 THEN v ELSE 1 - v END), 9) + 0.0 AS coeff FROM (SELECT p_partkey, p_partkey % 11 / 5.0::double AS u, p_size / 20.0::double AS v FROM part), range(4) t(k)")
def extrapolation(spark, d):
    """Unknowns at (u, v) follow the root cell [0, 1]^2 with the nodes 1 to 4."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("dof_id"), F.lit(0).alias("cell_id"), F.lit(1).alias("root"), (F.col("p_partkey") % 11 / F.lit(5.0)).alias("x"), (F.col("p_size") / F.lit(20.0)).alias("y"))
    roots = spark.createDataFrame([(1, [1, 2, 3, 4], [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 1.0, 0.0]])], "cell_id int, nodes array<long>, xyz array<array<double>>")
    return rounded(cut.extrapolated(t.drop("cell_id"), roots), "coeff", digits=9)


@query("WITH c AS (SELECT DISTINCT 3 AS level, p_partkey % 8 AS i, p_size % 8 AS j FROM part) SELECT level + 1 AS level, 2 * i + a AS i, 2 * j + b AS j FROM c, range(2) t(a), range(2) u(b) WHERE (i + j) % 3 = 0 UNION ALL SELECT level, i, j FROM c WHERE (i + j) % 3 <> 0")
def octree_refine(spark, d):
    c = table(spark, d, "part").select(F.lit(3).alias("level"), (F.col("p_partkey") % 8).cast("long").alias("i"), (F.col("p_size") % 8).cast("long").alias("j")).distinct()
    return octree.refine(c.withColumn("flag", F.when((F.col("i") + F.col("j")) % 3 == 0, 1).otherwise(0)))


@query("WITH c AS (SELECT DISTINCT 3 AS level, p_partkey % 8 AS i, p_size % 8 AS j FROM part), w AS (SELECT i // 2 AS pi, j // 2 AS pj FROM c WHERE (i // 2 + j // 2) % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 4) SELECT 2 AS level, pi AS i, pj AS j FROM w UNION ALL SELECT level, i, j FROM c WHERE (i // 2, j // 2) NOT IN (SELECT (pi, pj) FROM w)")
def octree_coarsen(spark, d):
    """Whole families of which all cells are flagged become their parent."""
    c = table(spark, d, "part").select(F.lit(3).alias("level"), (F.col("p_partkey") % 8).cast("long").alias("i"), (F.col("p_size") % 8).cast("long").alias("j")).distinct()
    return octree.coarsen(c.withColumn("flag", F.when((F.floor(F.col("i") / 2) + F.floor(F.col("j") / 2)) % 2 == 0, -1).otherwise(0)))


@query("WITH RECURSIVE e AS (SELECT l_orderkey AS a, l_suppkey + 1000000000000 AS b FROM lineitem WHERE l_orderkey % 50 = 0), u AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)), t(id, level) AS (SELECT min(a), 0 FROM e UNION SELECT u.b, level + 1 FROM t JOIN u ON t.id = u.a WHERE level < 12) SELECT id, min(level)::int AS level FROM t GROUP BY 1")
def bfs_levels(spark, d):
    """Levels from the least order over orders and their suppliers, of a share of the orders (a graph of more than one level)."""
    l = table(spark, d, "lineitem").where("l_orderkey % 50 = 0")
    e = l.select(F.col("l_orderkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000_000).alias("dst"))
    return graph.bfs_levels(e, e.agg(F.min("src")).first()[0])


@query(f"WITH p AS {PARTS}, i AS {INC}, g AS (SELECT a.cell_id, b.cell_id AS neighbour FROM i a JOIN i b ON a.vertex = b.vertex AND a.cell_id <> b.cell_id GROUP BY 1, 2 HAVING count(*) >= 2) SELECT g.cell_id AS id, count(*) AS degree FROM g JOIN p x ON x.cell_id = g.cell_id JOIN p y ON y.cell_id = g.neighbour WHERE x.part = y.part GROUP BY 1")
def masked_degree(spark, d):
    """Neighbours of a cell inside its own part."""
    return graph.masked_degree(graph.dual_graph(incidence(spark, d), 2), order_parts(spark, d))


# --- containers and reductions ------------------------------------------------------------------------


@query("WITH t AS (SELECT c_custkey AS key, -1 AS value FROM customer WHERE c_custkey % 5 = 0), o AS (SELECT o_custkey AS key, min(o_orderkey) AS value FROM orders GROUP BY 1) SELECT key, coalesce(t.value, o.value) AS value, t.value IS NULL AS stored FROM t FULL JOIN o USING (key)")
def hash_put(spark, d):
    """Customers' first orders put into a table that has every fifth customer already."""
    t = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("value"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("seq"))
    return containers.put(t, o)


@query("SELECT c_custkey AS key, s_acctbal AS value, s_suppkey IS NOT NULL AS found FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def hash_get(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    return containers.get(s, table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


@query("SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def hash_delete(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return containers.delete(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")))


@query("WITH l AS (SELECT l_orderkey AS key, list(l_partkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY 1) SELECT key, array_to_string(list_append(v, 7), ',') AS pushed, array_to_string(v[2:], ',') AS without_first, array_to_string(v[:1] || v[3:], ',') AS without_second, array_to_string(v || v, ',') AS twice FROM l")
def list_operations(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("v"))
    v = F.col("v")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return l.select("key", text(containers.pushed(v, F.lit(7).cast("long"))).alias("pushed"), text(containers.without_place(v, 1)).alias("without_first"), text(containers.without_place(v, 2)).alias("without_second"), text(containers.joined(v, v)).alias("twice"))


@query("SELECT row_number() OVER (ORDER BY l_linenumber, l_partkey)::int - 1 AS place, l_partkey AS value FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def sublist(spark, d):
    t = table(spark, d, "lineitem")
    l = t.groupBy(F.col("l_orderkey").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("v"))
    return containers.sublist(l, "key", "v", t.agg(F.min("l_orderkey")).first()[0])


@query("SELECT l_returnflag AS name, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def times_over_tasks(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("seconds"))
    return rounded(containers.over_tasks(t), "mean", digits=6)


@query("SELECT round(sum(c_acctbal), 2) AS c_acctbal, max(c_custkey) AS c_custkey, min(c_nationkey) AS c_nationkey FROM customer")
def all_reduce(spark, d):
    return rounded(containers.reduced(table(spark, d, "customer"), {"c_acctbal": "sum", "c_custkey": "max", "c_nationkey": "min"}), "c_acctbal", digits=2)


@query("SELECT p_partkey AS cell_id, 1 AS flag FROM part")
def uniform_marking(spark, d):
    return norms.uniform(table(spark, d, "part").select(F.col("p_partkey").alias("cell_id")))
