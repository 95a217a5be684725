"""Direct solution of systems of bounded size, in phases: pattern, factors, solves with many right sides.

Independent systems (the interiors of parts, the blocks of a preconditioner) are solved side by side, one
task each; a system of more than ``MOST`` unknowns is refused, as its dense factors would not fit one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 4000


class TooLarge(ValueError):
    pass


def symbolic(matrix: DataFrame, system: str = "system") -> DataFrame:
    """(system, n, entries): the size of each system; raises TooLarge beyond MOST."""
    sizes = matrix.groupBy(system).agg(F.countDistinct("ia").alias("n"), F.count("*").alias("entries"))
    top = sizes.agg(F.max("n")).first()[0]
    if top is not None and top > MOST:
        raise TooLarge(f"a system has {top} unknowns, at most {MOST} are solved directly")
    return sizes


def solve(matrix: DataFrame, rhs: DataFrame) -> DataFrame:
    """(system, k, idx, val) for systems (system, ia, ja, val) and right sides (system, k, idx, val); a singular
    system raises an error. All right sides of a system share its factors."""
    symbolic(matrix)
    both = (
        matrix.groupBy("system", F.col("ia").alias("i"), F.col("ja").alias("j")).agg(F.sum("val").alias("val")).withColumn("k", F.lit(-1))
        .unionByName(rhs.select("system", F.col("idx").alias("i"), F.lit(None).cast("long").alias("j"), "val", F.col("k").cast("int").alias("k")))
    )

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(tables))
        k, i, j, v = (t.column(c).to_numpy(zero_copy_only=False) for c in ("k", "i", "j", "val"))
        own = k < 0
        ids = np.unique(i[own])
        a = np.zeros((len(ids), len(ids)))
        a[np.searchsorted(ids, i[own]), np.searchsorted(ids, j[own].astype(np.int64))] = v[own]
        members = np.unique(k[~own])
        b = np.zeros((len(ids), len(members)))
        np.add.at(b, (np.searchsorted(ids, i[~own]), np.searchsorted(members, k[~own])), v[~own])
        x = np.linalg.solve(a, b) if len(ids) else b
        n = len(ids) * len(members)
        system = pa.chunked_array([t.column("system").combine_chunks()[:1]]).combine_chunks()
        name = pa.concat_arrays([system] * n) if n else system[:0]
        yield pa.RecordBatch.from_arrays([name, pa.array(np.repeat(members, len(ids)), pa.int32()), pa.array(np.tile(ids, len(members)), pa.int64()), pa.array(x.T.ravel())], names=["system", "k", "idx", "val"])

    kind = matrix.schema["system"].dataType.simpleString()
    return both.groupBy("system").applyInArrow(run, f"system {kind}, k int, idx long, val double")


def solve_one(matrix: DataFrame, rhs: DataFrame) -> DataFrame:
    """(idx, val) of one system (ia, ja, val) with one right side (idx, val)."""
    own = lambda df: df.withColumn("system", F.lit(0))
    return solve(own(matrix.select("ia", "ja", "val")), own(rhs.select("idx", "val")).withColumn("k", F.lit(0))).select("idx", "val")
