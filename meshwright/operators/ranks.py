"""Ranks and prefix sums over whole tables, without a task that sorts all rows.

Rows are dealt into ranges of their order and sorted there; a table of as many rows as there are
ranges (the session's shuffle partitions) holds what stands before each range, and is all that is
broadcast. The dealt rows are cut (written) first, so that ranges stay what they are in every retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwright.plans.lineage import Cut, checkpointed

#: monotonically_increasing_id: the range's number stands above these bits, the place in the range in them.
PLACE_BITS = 33


def dealt(df: DataFrame, order: list, cut: Cut) -> DataFrame:
    """``df`` in ranges of ``order``, with ``_b`` (range) and ``_i`` (place in it, from 0)."""
    at = F.monotonically_increasing_id()
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranged")
    return ranged.withColumns({"_b": F.shiftright("_at", PLACE_BITS), "_i": F.col("_at").bitwiseAND(F.lit(2**PLACE_BITS - 1))}).drop("_at")


def before_ranges(ranged: DataFrame, value: Column) -> DataFrame:
    """(_b, _o): the sum of ``value`` over all smaller ranges."""
    totals = ranged.groupBy("_b").agg(F.sum(value).alias("_t"))
    return totals.select("_b", (F.sum("_t").over(W.orderBy("_b")) - F.col("_t")).alias("_o"))


def ranked(df: DataFrame, order: list, out: str, cut: Cut = checkpointed) -> DataFrame:
    """``df`` with its rank from 1 in ``order``, which must be total for the same ranks in every run."""
    ranged = dealt(df, order, cut)
    placed = ranged.join(F.broadcast(before_ranges(ranged, F.lit(1).cast("long"))), "_b")
    return placed.withColumn(out, (F.col("_i") + F.col("_o") + 1).cast("long")).select(*df.columns, out)


def ranked_in(df: DataFrame, group: str, order: list, out: str, cut: Cut = checkpointed) -> DataFrame:
    """``df`` with its rank from 1 inside ``group``: the rank over all rows less that of the group's first row.
    Groups may be few and large; their first ranks are broadcast up to ``MOST_GROUPS`` of them."""
    whole = cut(ranked(df, [F.col(group), *order], "_r", cut), "ranked")
    first = whole.groupBy(F.col(group).alias("_g")).agg(F.min("_r").alias("_f"))
    joined = whole.join(small(first), F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(out, F.col("_r") - F.col("_f") + 1).select(*df.columns, out)


MOST_GROUPS = 1_000_000


def small(df: DataFrame, most: int = MOST_GROUPS) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows; a larger table is left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def prefix_sums(df: DataFrame, order: list, value: str, out: str, cut: Cut = checkpointed) -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows."""
    ranged = dealt(df, order, cut)
    inner = F.sum(value).over(W.partitionBy("_b").orderBy("_i").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value)
    placed = ranged.withColumn("_s", inner).join(F.broadcast(before_ranges(ranged, F.col(value))), "_b")
    return placed.withColumn(out, F.col("_s") + F.col("_o")).select(*df.columns, out)


def strips(df: DataFrame, order: list, parts: int, out: str = "part", cut: Cut = checkpointed) -> DataFrame:
    """``df`` with its strip from 1: contiguous in ``order``, the first ones a row larger where sizes differ."""
    rows = cut(ranked(df, order, "_r", cut), "ranked")
    n = rows.count()
    q, more = n // parts, n % parts
    edge, r = more * (q + 1), F.col("_r") - 1
    strip = F.when(r < edge, F.floor(r / (q + 1))).otherwise(F.floor((r - edge) / max(q, 1)) + more) + 1
    return rows.withColumn(out, strip.cast("int")).select(*df.columns, out)
