"""Files of a partitioned mesh, one for each part, and mesh and result files for viewers.

Each file holds one part, so its size is that of the part, which the partition bounds."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.sources.meshfile import TO_Z, numbered_lines, read_mesh

#: What viewers call a cell with so many corners, by dimension.
KINDS = {(2, 3): "Triangle", (2, 4): "Quadrilateral", (3, 4): "Tetrahedra", (3, 6): "Prism", (3, 8): "Hexahedra"}


def mesh_at(spark: SparkSession, folder: str, prefix: str) -> dict[str, DataFrame]:
    """The mesh ``<folder>/<prefix>.mesh``."""
    return read_mesh(spark, os.path.join(folder, f"{prefix}.mesh"))


def mesh_of(spark: SparkSession, parameters: dict[str, str]) -> dict[str, DataFrame]:
    """The same, addressed by the entries ``dir_path`` and ``prefix`` of a dictionary."""
    return mesh_at(spark, parameters["dir_path"], parameters["prefix"])


def view_lines(vertices: DataFrame, cells: DataFrame, dims: int, title: str = "TITLE") -> DataFrame:
    """(n, line): the post-process mesh: a header and blocks for each kind of cell, coordinates in the first one. Corners go
    round the cell; cells are numbered as they are, all of material 1."""
    spark = vertices.sparkSession
    sizes = [r[0] for r in cells.select(F.size("nodes")).distinct().orderBy(F.desc(F.size("nodes"))).collect()]
    out = None
    for k, size in enumerate(sizes):
        marks = [(4 * k, 0, f"MESH {title} dimension {dims} Elemtype {KINDS[dims, size]} Nnode {size:2d}"), (4 * k, 1, "coordinates"), (4 * k + 2, 0, "end coordinates"), (4 * k + 2, 1, "elements"), (4 * k + 3, 2**62, "end elements")]
        part = spark.createDataFrame(marks, "block int, n long, line string")
        if k == 0:
            point = F.format_string("%10d" + " %16.8e" * dims, "vertex_id", *"xyz"[:dims])
            part = part.unionByName(vertices.select(F.lit(4 * k + 1).alias("block"), F.col("vertex_id").alias("n"), point.alias("line")))
        round_ = TO_Z.get(size, list(range(size)))
        cell = F.concat_ws(" ", F.format_string("%10d", "cell_id"), *(F.format_string("%10d", F.get("nodes", c)) for c in round_), F.lit(f"{1:10d}"))
        part = part.unionByName(cells.where(F.size("nodes") == size).select(F.lit(4 * k + 3).alias("block"), F.col("cell_id").alias("n"), cell.alias("line")))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("block", "n")


def write_lines(lines: DataFrame, path: str) -> None:
    """One ordered file in the folder ``path``."""
    lines.coalesce(1).sortWithinPartitions("block", "n").select("line").write.mode("overwrite").text(path)


def partition_lines(numbers: dict) -> list[str]:
    """A partition file's lines, as ``meshfile.read_partition`` reads them: ten integers of ten places each a line."""

    def block(values: list[int]) -> list[str]:
        return ["".join(f"{v:10d}" for v in values[k : k + 10]) for k in range(0, len(values), 10)] or [""]

    out = block([numbers["part"], numbers["parts"]])
    for name in ("boundary_cells", "boundary_vertices"):
        out += block([len(numbers[name])]) + block(numbers[name])
    out += block(numbers["offsets"]) + block(numbers["neighbour_cells"]) + block(numbers["neighbour_parts"])
    for name in ("vertices", "cells"):
        own = numbers[f"l2g_{name}"]
        out += block([len(own), numbers[f"global_{name}"]]) + (block(own) if own else [])
    return out


def write_partition(spark: SparkSession, numbers: dict, path: str) -> None:
    rows = [(0, k, line) for k, line in enumerate(partition_lines(numbers))]
    write_lines(spark.createDataFrame(rows, "block int, n long, line string"), path)


def environment_lines(parts_by_level: list[int], mapping: list[int]) -> list[str]:
    """A task's environment: the number of levels, the tasks of each level, the part that the task has on each level."""
    row = lambda v: "".join(f"{x:10d}" for x in v)
    return [row([len(parts_by_level)]), row(parts_by_level), row(mapping)]


def write_parts(vertices: DataFrame, cells: DataFrame, parts: DataFrame, folder: str, prefix: str, dims: int) -> list[str]:
    """One viewer's mesh for each part, with its own cells and the vertices that they name; the paths by part."""
    out = []
    for part in [r[0] for r in parts.select("part").distinct().orderBy("part").collect()]:
        own = cells.join(parts.where(F.col("part") == part).select("cell_id"), "cell_id", "left_semi")
        used = vertices.join(own.select(F.explode("nodes").alias("vertex_id")).distinct(), "vertex_id", "left_semi")
        out.append(os.path.join(folder, f"{prefix}.{part}.post.msh"))
        write_lines(view_lines(used, own, dims), out[-1])
    return out


def vector_lines(x: DataFrame, n: int) -> DataFrame:
    """(block, n, line): a Matrix-Market array file of a vector; absent entries are 0."""
    spark = x.sparkSession
    head = spark.createDataFrame([(0, 0, "%%MatrixMarket matrix array real general"), (0, 1, f"{n} 1")], "block int, n long, line string")
    whole = spark.range(1, n + 1).join(x.select(F.col("idx").alias("id"), "val"), "id", "left")
    return head.unionByName(whole.select(F.lit(1).alias("block"), F.col("id").alias("n"), F.format_string("%.17e", F.coalesce("val", F.lit(0.0))).alias("line")))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(idx, val) of an array file of one column."""
    lines = numbered_lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith("%"))
    first = lines.agg(F.min("n")).first()[0]
    body = lines.where(F.col("n") > first)
    return body.select((F.col("n") - first).cast("long").alias("idx"), F.col("line").cast("double").alias("val"))


def pieces_manifest(pieces: list[str], point_data: list[str] = (), cell_data: list[str] = ()) -> str:
    """The manifest of a result's pieces, one file for each part."""
    array = lambda n: f'<PDataArray type="Float64" Name="{n}" NumberOfComponents="1"/>'
    body = f"<PPointData>{''.join(map(array, point_data))}</PPointData><PCellData>{''.join(map(array, cell_data))}</PCellData>"
    body += '<PPoints><PDataArray type="Float64" NumberOfComponents="3"/></PPoints>' + "".join(f'<Piece Source="{p}"/>' for p in pieces)
    return f'<?xml version="1.0"?><VTKFile type="PUnstructuredGrid" version="1.0"><PUnstructuredGrid GhostLevel="0">{body}</PUnstructuredGrid></VTKFile>'


class Series:
    """A result over time: the tables of each step beside each other under ``path``, appended step by step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, step: int, time: float, fields: DataFrame) -> None:
        """Write one step's fields; a step that is written again replaces what it had."""
        fields.withColumn("time", F.lit(float(time))).write.mode("overwrite").parquet(f"{self.path}/step={step}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def steps(self) -> list[tuple[int, float]]:
        return [tuple(r) for r in self.read().select("step", "time").distinct().orderBy("step").collect()]
