"""Text meshes (header, coordinates, elements, vefs), partition files and Matrix-Market files.

Files are read as lines with their file and place, and blocks are told apart by the place of
their marks, so a file is parsed in parallel once its marks are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where each vertex of a cell in counter-clockwise order stands in the order with x fastest.
TO_Z = {4: [0, 1, 3, 2], 8: [0, 1, 3, 2, 4, 5, 7, 6]}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a text file, by one ordered pass; mesh files are read whole by one task as they have no index."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))


def read_mesh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``vertices``, ``cells``, ``boundary_vefs`` and the ``header`` of a mesh file; corner order becomes x fastest."""
    lines = numbered_lines(spark, path)
    head = lines.where("lower(line) LIKE 'mesh %'").first()["line"].split()
    value = {head[k].lower(): int(head[k + 1]) for k in range(1, len(head) - 1, 2)}
    marks = {r.line.lower(): r.n for r in lines.where(F.lower("line").rlike("^(end +)?(coordinates|elements|cells|vefs)$")).collect()}
    marks = {" ".join(k.split()): v for k, v in marks.items()}

    def block(*names: str) -> DataFrame:
        name = next(n for n in names if n in marks)
        return lines.where((F.col("n") > marks[name]) & (F.col("n") < marks[f"end {name}"]) & (F.col("line") != "")).select(F.split("line", r"\s+").alias("f"))

    xyz = [F.get("f", i).cast("double") if i <= value["dimension"] else F.lit(0.0) for i in (1, 2, 3)]
    vertices = block("coordinates").select(F.get("f", 0).cast("long").alias("vertex_id"), *(c.alias(a) for c, a in zip(xyz, "xyz", strict=True)))

    def entities(rows: DataFrame, key: str, permute: bool) -> DataFrame:
        n = F.get("f", 1).cast("int")
        nodes = F.transform(F.slice("f", 3, n), lambda x: x.cast("long"))
        if permute:
            for size, order in TO_Z.items():
                nodes = F.when(n == size, F.transform(F.array(*map(F.lit, order)), lambda i: F.get(F.slice(F.transform("f", lambda x: x.cast("double")), 3, F.lit(size)), i).cast("long"))).otherwise(nodes)
        return rows.select(F.get("f", 0).cast("long").alias(key), nodes.alias("nodes"), F.get("f", n + 2).cast("int").alias("set_id"), F.get("f", n + 3).cast("int").alias("geo_id"))

    return {"header": value, "vertices": vertices, "cells": entities(block("elements", "cells"), "cell_id", value.get("order", 0) == 0), "boundary_vefs": entities(block("vefs"), "vef_id", False)}


def mesh_lines(vertices: DataFrame, cells: DataFrame, vefs: DataFrame, dims: int) -> DataFrame:
    """The lines of a mesh file with x-fastest order, as (n, line) in file order."""
    counts = [vertices.count(), cells.count(), vefs.count()]
    types = cells.select(F.size("nodes")).distinct().count()
    spark = vertices.sparkSession
    head = f"MESH dimension {dims} order 1 types {types} elements {counts[1]} vertices {counts[0]} vefs {counts[2]}"
    fixed = [(0, 0, head), (1, 0, "coordinates"), (3, 0, "end coordinates"), (4, 0, "elements"), (6, 0, "end elements"), (7, 0, "vefs"), (9, 0, "end vefs")]
    marks = spark.createDataFrame(fixed, "part int, id long, line string")
    points = vertices.select(F.lit(2).alias("part"), F.col("vertex_id").alias("id"), F.concat_ws(" ", "vertex_id", *(F.format_string("%.16e", c) for c in "xyz"[:dims])).alias("line"))

    def entity(df: DataFrame, key: str, part: int) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.col(key).alias("id"), F.concat_ws(" ", F.col(key), F.size("nodes"), F.array_join(F.col("nodes").cast("array<string>"), " "), "set_id", "geo_id").alias("line"))

    return marks.unionByName(points).unionByName(entity(cells, "cell_id", 5)).unionByName(entity(vefs, "vef_id", 8)).orderBy("part", "id").select("part", "id", "line")


def write_mesh(path: str, vertices: DataFrame, cells: DataFrame, vefs: DataFrame, dims: int) -> None:
    mesh_lines(vertices, cells, vefs, dims).coalesce(1).sortWithinPartitions("part", "id").select("line").write.mode("overwrite").text(path)


def read_partition(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """A partition file: integers in a fixed order of counts and lists."""
    rows = numbered_lines(spark, path).where("line != ''").orderBy("n").select(F.split("line", r"\s+").alias("f")).collect()
    values = [int(x) for r in rows for x in r.f]
    at = 0

    def take(n: int) -> list[int]:
        nonlocal at
        at += n
        return values[at - n : at]

    out = dict(zip(("part", "parts"), take(2), strict=True))
    out["boundary_cells"] = take(take(1)[0])
    out["boundary_vertices"] = take(take(1)[0])
    out["offsets"] = take(len(out["boundary_cells"]) + 1)
    n = out["offsets"][-1] - out["offsets"][0] if out["offsets"] else 0
    out["neighbour_cells"], out["neighbour_parts"] = take(n), take(n)
    for name in ("vertices", "cells"):
        local, out[f"global_{name}"] = take(2)
        out[f"l2g_{name}"] = take(local)
    return out


def write_matrix_market(path: str, matrix: DataFrame, rows: int, cols: int, symmetric: bool = False) -> None:
    """Coordinate format in one sorted file set: the header is the first part file's first lines."""
    from meshwright.operators.sparse import market_line, mirrored

    full = mirrored(matrix) if symmetric else matrix
    spark, n = matrix.sparkSession, full.count()
    head = spark.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate real general"), (0, 1, f"{rows} {cols} {n}")], "ia long, ja long, line string")
    lines = head.unionByName(full.select(F.col("ia").cast("long"), F.col("ja").cast("long"), market_line().alias("line")))
    lines.repartitionByRange("ia", "ja").sortWithinPartitions("ia", "ja").select("line").write.mode("overwrite").text(path)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(ia, ja, val) of a coordinate file: the first line that is no comment has the sizes; pattern entries
    are 1, and ``symmetric`` or ``skew-symmetric`` files give both triangles. In a file set the header is in one of its files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("line")).where("line != ''")
    head = lines.where(F.lower("line").startswith("%%matrixmarket")).orderBy("file", "n").first()
    words = head["line"].lower().split() if head else ["", "matrix", "coordinate", "real", "general"]
    body = lines.where(~F.col("line").startswith("%"))
    # Lines of one file keep their order; the sizes follow the header, or open a file set that has none.
    first = (body.where(F.col("file") == head["file"]).where(F.col("n") > head["n"]) if head else body).orderBy("file", "n").first()
    if first is None:
        return spark.createDataFrame([], "ia long, ja long, val double")
    f = body.where((F.col("file") != first["file"]) | (F.col("n") != first["n"])).select(F.split("line", r"\s+").alias("f"))
    value = F.lit(1.0) if words[3] == "pattern" else F.get("f", 2).cast("double")
    out = f.select(F.get("f", 0).cast("long").alias("ia"), F.get("f", 1).cast("long").alias("ja"), value.alias("val"))
    if words[4] not in ("symmetric", "skew-symmetric", "hermitian"):
        return out
    other = out.where("ia != ja").select(F.col("ja").alias("ia"), F.col("ia").alias("ja"), (-F.col("val") if words[4] == "skew-symmetric" else F.col("val")).alias("val"))
    return out.unionByName(other)


def vtu_lines(vertices: DataFrame, cells: DataFrame, point_data: str | None = None, cell_data: str | None = None) -> str:
    """One VTU piece as text, for one part: its size is that of the part, which the caller bounds."""
    p = vertices.orderBy("vertex_id").collect()
    number = {r.vertex_id: k for k, r in enumerate(p)}
    c = cells.orderBy("cell_id").collect()
    kinds = {3: 5, 4: 9, 8: 12}
    ends, total = [], 0
    for r in c:
        total += len(r.nodes)
        ends.append(total)
    corner = {4: [0, 1, 3, 2], 8: [0, 1, 3, 2, 4, 5, 7, 6]}
    linked = " ".join(str(number[r.nodes[i]]) for r in c for i in corner.get(len(r.nodes), range(len(r.nodes))))
    array = lambda name, kind, body, n="1": f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{n}" format="ascii">{body}</DataArray>'
    points = array("Points", "Float64", " ".join(f"{v:.16g}" for r in p for v in (r.x, r.y, r.z)), "3")
    topology = array("connectivity", "Int64", linked) + array("offsets", "Int64", " ".join(map(str, ends))) + array("types", "UInt8", " ".join(str(kinds[len(r.nodes)]) for r in c))
    pd = f"<PointData>{array(point_data, 'Float64', ' '.join(f'{r[point_data]:.16g}' for r in p))}</PointData>" if point_data else ""
    cd = f"<CellData>{array(cell_data, 'Float64', ' '.join(f'{float(r[cell_data]):.16g}' for r in c))}</CellData>" if cell_data else ""
    body = f'<Piece NumberOfPoints="{len(p)}" NumberOfCells="{len(c)}">{pd}{cd}<Points>{points}</Points><Cells>{topology}</Cells></Piece>'
    return f'<?xml version="1.0"?><VTKFile type="UnstructuredGrid" version="1.0"><UnstructuredGrid>{body}</UnstructuredGrid></VTKFile>'


def pvd_lines(steps: list[tuple[float, str]]) -> str:
    rows = "".join(f'<DataSet timestep="{t:.16g}" part="0" file="{f}"/>' for t, f in steps)
    return f'<?xml version="1.0"?><VTKFile type="Collection" version="1.0"><Collection>{rows}</Collection></VTKFile>'


