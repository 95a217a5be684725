"""Keyed tables and jagged lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(table: DataFrame, rows: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """(key, value, stored): the first write of a key wins, by ``seq``; what the table has is older than all rows.
    ``stored`` tells of each key whether it was new."""
    old = table.select(key, value, F.lit(False).alias("_new"), F.lit(None).cast(rows.schema[seq].dataType).alias("_at"))
    new = rows.select(key, value, F.lit(True).alias("_new"), F.col(seq).alias("_at"))
    both = old.unionByName(new).groupBy(key).agg(F.min(F.struct("_new", "_at", value)).alias("_first"))
    return both.select(key, F.col(f"_first.{value}").alias(value), F.col("_first._new").alias("stored"))


def get(table: DataFrame, keys: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value, found) of the asked keys."""
    known = table.select(key, value, F.lit(True).alias("_found"))
    return keys.select(key).join(known, key, "left").select(key, value, F.coalesce("_found", F.lit(False)).alias("found"))


def delete(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def pushed(values: Column, value: Column) -> Column:
    return F.array_append(values, value)


def without_place(values: Column, place: int) -> Column:
    """The array without its element at ``place``, from 1."""
    return F.concat(F.slice(values, 1, place - 1), F.slice(values, place + 1, F.greatest(F.size(values) - place, F.lit(0)))) if place > 1 else F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


def joined(*lists: Column) -> Column:
    return F.concat(*lists)


def sublist(rows: DataFrame, key: str, values: str, which: int) -> DataFrame:
    """(place, value): the elements of one list of a jagged table."""
    return rows.where(F.col(key) == which).select(F.posexplode(values).alias("place", "value"))


def over_tasks(times: DataFrame, name: str = "name", seconds: str = "seconds") -> DataFrame:
    """(name, least, most, mean) of the tasks' times."""
    return times.groupBy(name).agg(F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.avg(seconds).alias("mean"))


def reduced(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """One row: sum, max or min of columns, as ``values`` says."""
    how = {"sum": F.sum, "max": F.max, "min": F.min}
    return df.agg(*(how[h](c).alias(c) for c, h in values.items()))
