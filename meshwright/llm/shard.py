"""Balanced label propagation onto shards, with DataFrame functions only.

Documents with equal texts are linked. Every linked document begins on a shard that its id
decides; then, round by round, joins count each group's members on each shard, every group
agrees on the shard where most of its members are (among those with room), and members move
there under the shards' quotas: movers are taken by gain, in small slices, until a shard's room
is used up. When nothing moves any more, shards above the mean give their slices of the least
groups back, and these and the unlinked documents fill all shards up to the mean, large ones
first, so that small ones level what the large ones left uneven.

Law: ``bytes`` (sizes near equal). Size: UTF-8 bytes of the text plus 8.

A group larger than a shard's room fills one shard after the other, so any group's share of the
rows is fine; hot groups are never gathered in a task, as counts combine before the shuffle and
joins on the group treat its large values by broadcast of at most 2,000 rows. Nothing else is
broadcast: which movers fit is told by one number for each shard.

Cases: a null text has no bytes and is linked with nothing; empty texts are equal texts;
repeated rows and null ids are rows like any other; an empty table gives no rows; columns but
doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.llm.common import Scratch, bounded_prefix, hot_join, settled, text_frame

SHARDS = 24
ROUNDS = 8
EXTRA = 8
GAINS, GROUP_SLICES, MEMBER_SLICES = 32, 16, 128
#: A shard attracts movers while its room is over 1/ROOM_SHARE of the mean, which is more than a slice of a hot group.
ROOM_SHARE = 12
#: Size classes of the last filling, as shares of the mean shard size.
CLASSES = (64, 1024, 16384)
ROWS_A_SLICE = 4_000


def loads(df: DataFrame, shards: int) -> list[int]:
    """The bytes of every shard: as many numbers as there are shards."""
    got = dict(df.groupBy("shard").agg(F.sum("size")).collect())
    return [int(got.get(s, 0)) for s in range(shards)]


def number_at(values: list[int], index: Column) -> Column:
    return F.get(F.array(*(F.lit(int(v)).cast("long") for v in values)), index)


def slice_of(rank: Column) -> Column:
    """The order in which movers are taken: by rank, then a slice of the groups, then of the members."""
    return (rank * GROUP_SLICES + F.pmod(F.xxhash64("group"), F.lit(GROUP_SLICES))) * MEMBER_SLICES + F.pmod(F.xxhash64("doc_id", "group"), F.lit(MEMBER_SLICES))


def within(rows: DataFrame, shard: str, room: list[int]) -> Column:
    """Whether a row's slice fits into its shard's room, slices being taken in their order. Sums only grow, so
    one number for each shard tells it: the last slice that fits."""
    sums = rows.groupBy(shard, "slice").agg(F.sum("size").alias("b"))
    before = F.sum("b").over(W.partitionBy(shard).orderBy("slice"))
    fit = sums.withColumn("upto", before).where(F.col("upto") <= number_at(room, F.col(shard))).groupBy(shard).agg(F.max("slice"))
    last = {int(s): int(x) for s, x in fit.collect()}
    return F.coalesce(F.col("slice") <= number_at([last.get(s, -1) for s in range(len(room))], F.col(shard)), F.lit(False))


def propagated(linked: DataFrame, scratch: Scratch, shards: int, mean: int, rounds: int) -> DataFrame:
    """Move linked documents towards their groups' shards under the quota ``mean``."""
    now = loads(linked, shards)
    for k in range(rounds):
        room = [max(0, mean - x) for x in now]
        counts = linked.groupBy("group", "shard").agg(F.count("*").alias("c"))
        open_ = number_at(room, F.col("shard")) * ROOM_SHARE > mean
        best = F.max(F.when(open_, F.struct("c", F.xxhash64("group", "shard").alias("h"), "shard"))).alias("best")
        targets = counts.groupBy("group").agg(best, F.map_from_entries(F.collect_list(F.struct("shard", "c"))).alias("on"), F.sum("c").alias("weight"))
        targets = scratch.table(targets.where(F.col("best").isNotNull() & (F.size("on") > 1)), f"targets{k}")
        if targets.isEmpty():
            break
        asked = hot_join(linked, targets, "group", "weight", "left")
        gain = F.col("best.c") - F.try_element_at("on", F.col("shard")) + 1
        wants = (F.col("best.shard") != F.col("shard")) & (gain > 0)
        rank = F.lit(GAINS - 1) - F.least(F.floor(F.log2(F.greatest(gain, F.lit(1)).cast("double"))), F.lit(GAINS - 1))
        asked = asked.select(*linked.columns, F.when(wants, F.col("best.shard")).alias("to"), F.when(wants, slice_of(rank)).alias("slice"))
        asked = scratch.table(asked, f"asked{k}")
        moved = asked.withColumn("moved", within(asked.where("to IS NOT NULL"), "to", room))
        linked = scratch.table(moved.withColumn("shard", F.when(F.col("moved"), F.col("to")).otherwise(F.col("shard"))).select(*linked.columns, "moved"), f"linked{k}")
        n_moved = linked.where("moved").limit(1).count()
        linked = linked.drop("moved")
        now = loads(linked, shards)
        if n_moved == 0:
            break
    return linked


def filled(pool: DataFrame, now: list[int], total: int, shards: int) -> Column:
    """The shard of every row of ``pool`` (size, class, before), which fills all up to the mean.

    The rows of a class lie on a line; each shard has an interval of it as long as its share of
    what is missing, and a row goes where its middle lies."""
    out = F.lit(0)
    for k in range(len(CLASSES) + 1):
        own = pool.where(F.col("class") == k)
        mass = int(own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
        missing = [max(0.0, total / shards - x) for x in now]
        scale = mass / sum(missing) if sum(missing) > 0 else 0.0
        edge, at = 0.0, F.lit(0)
        middle = F.col("before") + F.col("size") / 2
        for s in range(shards - 1):
            edge += missing[s] * scale if scale else mass / shards
            at = at + (middle >= edge).cast("int")
        if mass:
            now = [x + y for x, y in zip(now, loads(own.select("size", at.alias("shard")), shards), strict=True)]
        out = F.when(F.col("class") == k, at).otherwise(out)
    return out


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    with Scratch(spark, "shard") as scratch:
        text = F.coalesce("text", F.lit(""))
        rows = text_frame(docs).select("doc_id", (F.octet_length(text) + EXTRA).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("group"))
        rows = scratch.table(rows, "rows")
        total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        mean = int(total) // shards
        kept = [F.first(c).alias(c) for c in ("doc_id", "size", "crc")]
        groups = scratch.table(rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.count("*").alias("n"), *kept), "groups")
        single = groups.where("n = 1").select("doc_id", "size", "crc", "group").unionByName(rows.where(F.col("group").isNull()))
        linked = hot_join(rows.where(F.col("group").isNotNull()), groups.where("n > 1").select("group", "n"), "group", "n")
        linked = linked.select("doc_id", "size", "crc", "group", "n", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"))
        linked = propagated(scratch.table(linked, "linked"), scratch, shards, mean, rounds)
        small = F.least(F.floor(F.log2(F.col("n").cast("double"))), F.lit(GAINS - 1))
        linked = linked.withColumn("slice", slice_of(F.lit(GAINS - 1) - small))
        linked = scratch.table(linked.withColumn("fits", within(linked, "shard", [mean] * shards)).drop("slice", "n"), "stay")
        kind = sum(((F.col("size") * c < mean).cast("int") for c in CLASSES), F.lit(0))
        pool = single.unionByName(linked.where(~F.col("fits")).select("doc_id", "size", "crc", "group")).withColumn("class", kind)
        slices = max(1, int(n) // ROWS_A_SLICE)
        slice_ = F.pmod(F.xxhash64("doc_id", "crc"), F.lit(slices))
        pool = scratch.table(bounded_prefix(pool, ["class"], ["doc_id", "crc"], F.col("size"), "before", slices, slice_), "pool")
        stayed = linked.where("fits").select("doc_id", "size", "crc", "shard")
        placed = pool.select("doc_id", "size", "crc", filled(pool, loads(stayed, shards), int(total), shards).alias("shard")).unionByName(stayed)
        placed = scratch.table(placed, "placed")
        own = F.pmod(F.xxhash64("doc_id", "crc"), F.lit(max(1, int(n) // (shards * ROWS_A_SLICE))))
        out = bounded_prefix(placed, ["shard"], ["doc_id", "crc"], F.lit(1).cast("long"), "slot", 1, own)
        return settled(out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
