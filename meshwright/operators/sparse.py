"""Sparse matrices as rows (ia, ja, val), 1-based. A missing row is a zero entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(entries: DataFrame, rows: int | None = None, cols: int | None = None, window: tuple[int, int, int, int] | None = None, symmetric: bool = False) -> DataFrame:
    """Entries inside the matrix (and inside ``window`` imin, imax, jmin, jmax); symmetric storage keeps the upper triangle."""
    keep = F.lit(True)
    if rows is not None:
        keep = keep & F.col("ia").between(1, rows)
    if cols is not None:
        keep = keep & F.col("ja").between(1, cols)
    if window:
        keep = keep & F.col("ia").between(*window[:2]) & F.col("ja").between(*window[2:])
    if symmetric:
        keep = keep & (F.col("ia") <= F.col("ja"))
    return entries.where(keep)


def insert_blocks(blocks: DataFrame) -> DataFrame:
    """Dense element matrices (rows array, cols array, block array of rows) as entries."""
    one = blocks.select("cols", F.explode(F.arrays_zip(F.col("rows").alias("ia"), F.col("block").alias("line"))).alias("r"))
    return one.select(F.col("r.ia").alias("ia"), F.explode(F.arrays_zip(F.col("cols").alias("ja"), F.col("r.line").alias("val"))).alias("c")).select("ia", "c.ja", "c.val")


def compress(entries: DataFrame) -> DataFrame:
    """Duplicates are summed; sums combine before the shuffle."""
    return entries.groupBy("ia", "ja").agg(F.sum("val").alias("val"))


def compress_last(entries: DataFrame, seq: str = "seq") -> DataFrame:
    """Of duplicates the one with the greatest ``seq`` stays; of equal ones that with the greatest value."""
    return entries.groupBy("ia", "ja").agg(F.max(F.struct(seq, "val"))["val"].alias("val"))


def pattern(entries: DataFrame) -> DataFrame:
    return entries.select("ia", "ja").distinct()


def update(matrix: DataFrame, changes: DataFrame, add: bool = True) -> DataFrame:
    """Change existing entries only: add the changes' sums or put the greatest-``seq`` change."""
    new = (compress(changes) if add else compress_last(changes)).withColumnRenamed("val", "new")
    value = F.col("val") + F.coalesce("new", F.lit(0.0)) if add else F.coalesce("new", "val")
    return matrix.join(new, ["ia", "ja"], "left").select("ia", "ja", value.alias("val"))


def scale(matrix: DataFrame, alpha: float) -> DataFrame:
    return matrix.withColumn("val", F.col("val") * alpha)


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha*A + beta*B in one aggregation."""
    return compress(scale(a, alpha).select("ia", "ja", "val").unionByName(scale(b, beta).select("ia", "ja", "val")))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("ja").alias("ia"), F.col("ia").alias("ja"), "val")


def mirrored(matrix: DataFrame) -> DataFrame:
    """Both triangles of a symmetric matrix from its upper one, in one pass."""
    pairs = F.array(F.struct("ia", "ja", "val"), F.struct(F.col("ja").alias("ia"), F.col("ia").alias("ja"), "val"))
    return matrix.select(F.explode(F.when(F.col("ia") == F.col("ja"), F.slice(pairs, 1, 1)).otherwise(pairs)).alias("e")).select("e.ia", "e.ja", "e.val")


def diagonal(matrix: DataFrame, indices: DataFrame) -> DataFrame:
    """(idx, val) for every row of ``indices`` (idx); a missing entry is 0."""
    d = matrix.where("ia = ja").select(F.col("ia").alias("idx"), "val")
    return indices.join(d, "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val"))


def entry(matrix: DataFrame, i: int, j: int) -> DataFrame:
    return matrix.where((F.col("ia") == i) & (F.col("ja") == j)).select("ia", "ja", "val")


def split_2x2(matrix: DataFrame, rows: int, cols: int) -> DataFrame:
    """Entries with their block (II, IG, GI, GG) and indices inside it."""
    up, left = F.col("ia") <= rows, F.col("ja") <= cols
    block = F.concat(F.when(up, "I").otherwise("G"), F.when(left, "I").otherwise("G"))
    return matrix.select(block.alias("block"), F.when(up, F.col("ia")).otherwise(F.col("ia") - rows).alias("ia"), F.when(left, F.col("ja")).otherwise(F.col("ja") - cols).alias("ja"), "val")


def permute(matrix: DataFrame, perm: DataFrame) -> DataFrame:
    """Rows and columns renumbered by ``perm`` (old, new)."""
    r = perm.select(F.col("old").alias("ia"), F.col("new").alias("ni"))
    c = perm.select(F.col("old").alias("ja"), F.col("new").alias("nj"))
    return matrix.join(r, "ia").join(c, "ja").select(F.col("ni").alias("ia"), F.col("nj").alias("ja"), "val")


def expand(a: DataFrame, n: int, c_t: DataFrame, i: DataFrame) -> DataFrame:
    """[[A, C^T], [C, I]] from A (n rows), C^T and a square matrix in the place of I."""
    shift = F.lit(n)
    right = c_t.select("ia", (F.col("ja") + shift).alias("ja"), "val")
    low = c_t.select((F.col("ja") + shift).alias("ia"), F.col("ia").alias("ja"), "val")
    corner = i.select((F.col("ia") + shift).alias("ia"), (F.col("ja") + shift).alias("ja"), "val")
    return a.select("ia", "ja", "val").unionByName(right).unionByName(low).unionByName(corner)


def spmv(matrix: DataFrame, x: DataFrame, transposed: bool = False, symmetric: bool = False) -> DataFrame:
    """(idx, val) of A*x; rows without an entry are absent. ``x`` is (idx, val)."""
    m = mirrored(matrix) if symmetric else matrix
    row, col = ("ja", "ia") if transposed else ("ia", "ja")
    v = x.select(F.col("idx").alias(col), F.col("val").alias("x"))
    return m.join(v, col).groupBy(F.col(row).alias("idx")).agg(F.sum(F.col("val") * F.col("x")).alias("val"))


#: Members of a multi-vector that are multiplied in one pass.
WIDTH = 64


def spmm(matrix: DataFrame, x: DataFrame, transposed: bool = False) -> DataFrame:
    """(k, idx, val) of A times a multi-vector (k, idx, val), k from 0.

    The matrix is summed first, and each idx has its WIDTH members side by side in one row, so a
    product is one join and one aggregation over the matrix's entries, not over entries times members."""
    row, col = ("ja", "ia") if transposed else ("ia", "ja")
    a, top, out = compress(matrix), x.agg(F.max("k")).first()[0], None
    for low in range(0, 1 if top is None else int(top) + 1, WIDTH):
        names = [f"m{j}" for j in range(min(WIDTH, int(top or 0) + 1 - low))]
        own = x.where(F.col("k").between(low, low + WIDTH - 1)).withColumn("_j", F.col("k") - low)
        wide = own.groupBy(F.col("idx").alias(col)).agg(*(F.sum(F.when(F.col("_j") == j, F.col("val"))).alias(n) for j, n in enumerate(names)))
        sums = a.join(wide, col).groupBy(F.col(row).alias("idx")).agg(*(F.sum(F.col("val") * F.col(n)).alias(n) for n in names))
        members = F.array(*(F.struct(F.lit(low + j).cast(x.schema["k"].dataType).alias("k"), F.col(n).alias("val")) for j, n in enumerate(names)))
        part = sums.select("idx", F.explode(F.filter(members, lambda m: m["val"].isNotNull())).alias("m")).select("m.k", "idx", "m.val")
        out = part if out is None else out.unionByName(part)
    return out


def gemm(matrix: DataFrame, x: DataFrame, y: DataFrame, alpha: float, beta: float, transposed: bool = False) -> DataFrame:
    """alpha*A*X + beta*Y."""
    ax = spmm(matrix, x, transposed).select("k", "idx", (F.col("val") * alpha).alias("val"))
    return ax.unionByName(y.select("k", "idx", (F.col("val") * beta).alias("val"))).groupBy("k", "idx").agg(F.sum("val").alias("val"))


def csr_rows(matrix: DataFrame) -> DataFrame:
    """One row for each matrix row: its entries sorted by column."""
    return matrix.groupBy("ia").agg(F.sort_array(F.collect_list(F.struct("ja", "val"))).alias("entries"))


def triple_product(matrix: DataFrame, k: DataFrame) -> DataFrame:
    """K^T*A*K, for K (ia, ja, val): two joins, each followed by a sum."""
    right = k.select(F.col("ia").alias("ja"), F.col("ja").alias("j2"), F.col("val").alias("kv"))
    ak = matrix.join(right, "ja").groupBy("ia", F.col("j2").alias("ja")).agg(F.sum(F.col("val") * F.col("kv")).alias("val"))
    left = k.select("ia", F.col("ja").alias("i2"), F.col("val").alias("kv"))
    return ak.join(left, "ia").groupBy(F.col("i2").alias("ia"), "ja").agg(F.sum(F.col("val") * F.col("kv")).alias("val"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """A*B: a join and a sum."""
    right = b.select(F.col("ia").alias("ja"), F.col("ja").alias("j2"), F.col("val").alias("bv"))
    return a.join(right, "ja").groupBy("ia", F.col("j2").alias("ja")).agg(F.sum(F.col("val") * F.col("bv")).alias("val"))


def gram_triple_product(b: DataFrame, k: DataFrame) -> DataFrame:
    """K^T*(B*B^T)*K as (K^T*B)*(K^T*B)^T: B*B^T, which is dense where rows of B share a column, is not formed.

    Infinite values keep the signs they have in B*B^T: terms of K^T*B are summed for each sign apart, and only
    the rows of B*B^T that meet an infinite entry of K are formed."""
    infinite = F.coalesce(F.abs("val") == float("inf"), F.lit(False))
    finite, rest = k.where(~infinite), k.where(infinite)
    left, term = finite.select("ia", F.col("ja").alias("i2"), F.col("val").alias("kv")), F.col("kv") * F.col("val")
    kb = b.join(left, "ia").groupBy(F.col("i2").alias("ia"), "ja", F.signum(term).alias("sign")).agg(F.sum(term).alias("val")).drop("sign")
    out = product(kb, transpose(kb))
    if rest.isEmpty():
        return out
    lines = product(transpose(rest), product(b.join(rest.select("ia").distinct(), "ia", "left_semi"), transpose(b)))
    mixed = product(lines, finite)
    return compress(out.unionByName(mixed).unionByName(transpose(mixed)).unionByName(product(lines, rest)))


def market_line(symmetric: bool = False) -> Column:
    """A line of a Matrix-Market coordinate file for (ia, ja, val)."""
    return F.format_string("%d %d %.17e", "ia", "ja", "val")
