"""Every query of the library against its SQL, on whole tables."""

import pytest

from meshwright.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_octree_is_balanced(spark, sf):
    rows = QUERIES["octree_balance"](spark, sf).collect()
    assert abs(sum(0.25**r.level for r in rows) - 1) < 1e-12
    leaf = {(r.level, r.i, r.j) for r in rows}
    for level, i, j in leaf:
        for di, dj in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)):
            x, y = i + di, j + dj
            if 0 <= x < 2**level and 0 <= y < 2**level:
                for up in range(2, level + 1):
                    assert (level - up, x >> up, y >> up) not in leaf
    assert {r.part for r in rows} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("symmetric", [False, True])
@pytest.mark.parametrize("inside", [False, True])
def test_insert_clips_at_the_edges_and_keeps_the_bulk(spark, sf, duck, symmetric, inside):
    """Bounds and window follow the table's id ranges; part ids are folded onto the suppliers', so that the triangle halves the rows."""
    from pyspark.sql import functions as F

    from meshwright.operators import sparse

    total, most = duck.execute("SELECT count(*), max(l_suppkey) + 1 FROM lineitem").fetchone()
    rows, cols = most - most // 10, most
    window = (1 + most // 10, most, 1, most - most // 10) if inside else None
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_partkey") % most + 1).alias("ia"), (F.col("l_suppkey") + 1).alias("ja"), F.col("l_quantity").alias("val"))
    t = t.unionByName(t.where("ja = 1").withColumn("ja", F.lit(cols + 1).cast("long")))
    got = sparse.insert(t, rows, cols, window, symmetric)
    clip = f"ia BETWEEN 1 AND {rows} AND ja BETWEEN 1 AND {cols}" + (" AND ia BETWEEN {} AND {} AND ja BETWEEN {} AND {}".format(*window) if window else "") + (" AND ia <= ja" if symmetric else "")
    sql = f"SELECT ia, ja, sum(val) FROM (SELECT l_partkey % {most} + 1 AS ia, l_suppkey + 1 AS ja, l_quantity AS val FROM lineitem) WHERE {clip} GROUP BY 1, 2"
    assert total // 4 < got.count() < total
    mine = {(r.ia, r.ja): round(r.val, 4) for r in sparse.compress(got).collect()}
    assert mine == {(i, j): round(v, 4) for i, j, v in duck.execute(sql).fetchall()}


def made(folder, accounts, lines):
    """Tables of suppliers (key, nation, balance) and order lines (supplier, line number, quantity), and a DuckDB connection to them."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    c = duckdb.connect()
    for name, rows, columns in (("supplier", accounts, ("s_suppkey", "s_nationkey", "s_acctbal")), ("lineitem", lines, ("l_suppkey", "l_linenumber", "l_quantity"))):
        types = (pa.int64(), pa.int32(), pa.float64())
        pq.write_table(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(columns, types, strict=True))}), f"{folder}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c


def rows_made(plan):
    """The most rows that one node of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(rows_made, below)])


def test_triple_product_makes_no_more_rows_than_it_reads(spark, tmp_path):
    """All 1,000 rows of the factor share their columns, so its product with itself has 1,000,000 entries."""
    c = made(tmp_path, [(i, i % 5, i % 100 - 20.0) for i in range(1000)], [(i, j, (i + j) % 50 + 1.0) for i in range(1000) for j in range(3)])
    df = QUERIES["triple_product"](spark, str(tmp_path))
    assert {(r.ia, r.ja, r.val) for r in df.collect()} == set(c.execute(ORACLE["triple_product"]).fetchall())
    assert 0 < rows_made(df._jdf.queryExecution().executedPlan()) <= 3000


def as_text(rows):
    return sorted((str(i), str(j), "null" if v is None else str(round(v, 3) + 0.0)) for i, j, v in rows)


INF, NAN = float("inf"), float("nan")
LINES = [(0, 1, 5e3), (0, 2, 7e3), (1, 1, 4e3), (1, 2, 0), (2, 2, 3e3), (3, 3, 6e3), (4, 1, 2e3), (4, 1, 3e3), (None, 1, 9e3), (2, None, 9e3), (5, 1, None), (6, 4, None), (9, 1, 8e3)]
ACCOUNTS = [(0, 10, 2e4), (1, 10, -3e4), (2, 11, 0), (3, None, 1e4), (4, 11, None), (4, 11, 5e4), (5, 12, 4e4), (6, 13, 1e4), (7, 14, 1e4), (None, 11, 1e4)]


@pytest.mark.parametrize(
    "lines, accounts",
    [
        ([], []), ([(1, 2, -9e3)], []), ([(1, 3, NAN)], []), ([(1, 3, INF)], []), ([(2, 1, INF)], []), ([(0, 3, INF), (2, 3, -INF)], []), ([(i, 1, INF) for i in range(7)], []),
        ([(0, 2, -2e4)], [(1, 10, INF)]), ([], [(1, 11, -INF)]), ([], [(0, 12, INF), (3, 12, -INF)]), ([], [(2, 10, NAN)]), ([(4, 1, INF)], [(0, 11, INF)]), ([(1, 2, 9e3)], [(3, None, INF), (6, 13, INF)]),
    ],
)
def test_triple_product_of_odd_values(spark, tmp_path, lines, accounts):
    """Null keys and values, repeated rows, zeros, both signs, infinite and undefined values."""
    c = made(tmp_path, ACCOUNTS + accounts, LINES + lines)
    want = as_text(c.execute(ORACLE["triple_product"]).fetchall())
    assert len(want) >= 11
    assert as_text(QUERIES["triple_product"](spark, str(tmp_path)).collect()) == want


def test_gram_triple_product_is_that_of_the_whole_matrix(spark):
    from meshwright.operators import sparse

    b, k = (spark.createDataFrame([(i, j, None if v is None else float(v)) for i, j, v in rows], "ia long, ja long, val double") for rows in (LINES, ((i, j, v and v / 1e4) for i, j, v in ACCOUNTS)))
    got = as_text(sparse.gram_triple_product(b, k).collect())
    assert got == as_text(sparse.triple_product(sparse.product(b, sparse.transpose(b)), k).collect()) and len(got) >= 11


@pytest.mark.parametrize("table", ["supplier", "lineitem"])
def test_triple_product_of_an_empty_table(spark, tmp_path, table):
    made(tmp_path, [] if table == "supplier" else ACCOUNTS, [] if table == "lineitem" else LINES)
    assert QUERIES["triple_product"](spark, str(tmp_path)).collect() == []
