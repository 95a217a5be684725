"""MinHash near-duplicates with tensored banding.

``GROUPS`` small signatures of ``PER_GROUP`` minhashes each are computed once; a table's key
joins the signatures of two groups, so GROUPS*(GROUPS-1)/2 tables of 2*PER_GROUP minhashes cost
GROUPS*PER_GROUP minhashes only. Two sets of similarity s share a table unless fewer than two
groups agree: with 14 groups of 2 that misses 1.6 of 100,000 pairs at s = 0.8 and fewer above.

Texts with equal shingle sets become one class first. In each bucket the classes are compared
with the bucket's least one; then, while a bucket holds several components, with further ones, and at
last members of different components with each other, unless their sizes or their one-bit
sketches rule a link out (the latter errs for about one similar pair in a million). Pairs inside
a component are never listed, so a group of copies costs comparisons in proportion to its size.
Links are confirmed on whole sets.

Cases: null, empty and wordless texts have no shingles and are linked with nothing; fewer words
than a shingle has are one shingle; rows that share a ``doc_id`` are judged each by its own text: a
component's name is the least id among its rows, and a row is kept if it has that id, so a text that is
nowhere else always stays; a null ``doc_id`` gets a null component and is kept; other columns pass
through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import LOWER, Prefixes, Scratch, by_size, bytes_of, hot_join, mixed, settled, text_frame, word_edges
from meshwright.operators.graph import connected_components

PERCENT = 80
GROUPS, PER_GROUP = 14, 2
PIECE = 1_000_000
ROUNDS = 2
SKETCH = 3072
PART = 32_768
#: Members of a bucket that one task compares with as many others; larger buckets are cut into blocks of about this size.
BLOCK = 2000
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of each text, in order, and the n + 1 offsets."""
    starts, ends, first = word_edges(WORD[data], offsets)
    n_words = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = mixed(Prefixes(LOWER[data], 23).of(starts, ends) + (ends - starts).astype(np.uint64))
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = words.copy()
    for j in range(1, size):
        out = out * STEP + padded[j : j + len(words)]
    keep = np.ones(len(words), bool)
    for j in range(1, size):
        last = first[1:] - j
        keep[last[n_words >= j]] = False
    for d in np.flatnonzero((n_words > 0) & (n_words < size)).tolist():
        h = int(n_words[d])
        for w in words[first[d] : first[d + 1]].tolist():
            h = (h * 0xC2B2AE3D27D4EB4F + w + 1) % 2**64
        out[first[d]], keep[first[d]] = h, True
    at = np.concatenate([[0], np.cumsum(keep)])
    return mixed(out[keep]), at[first]


def signatures(sh: np.ndarray, at: np.ndarray, groups: int, per_group: int) -> np.ndarray:
    """(texts with shingles, groups) signatures."""
    rng = np.random.Generator(np.random.PCG64(101))
    factors = rng.integers(1, 2**63, groups * per_group, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    begin = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(begin), groups), np.uint64)
    for k, f in enumerate(factors):
        least = np.minimum.reduceat(mixed(sh * f) if per_group > 2 else (sh ^ (sh >> np.uint64(29))) * f, begin)
        g = k // per_group
        out[:, g] = mixed(out[:, g] * STEP + least)
    return out


def signed(docs: DataFrame, size: int, groups: int, per_group: int) -> DataFrame:
    """doc_id, key (of the text), n_shingles, fp (128-bit digest of the sorted set; null if empty), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 2, PIECE):
            sh, at = shingles(*bytes_of(b.column(2)), size)
            full = np.diff(at) > 0
            counts, prints = np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            for d in np.flatnonzero(full).tolist():
                own = np.unique(sh[at[d] : at[d + 1]])
                counts[d], prints[d] = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            flat = signatures(sh, at, groups, per_group).astype(np.int64).ravel() if full.any() else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]).astype(np.int32) * np.int32(groups)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts), pa.array(prints, pa.binary()), lists], names=["doc_id", "key", "n_shingles", "fp", "sig"])

    return docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(run, "doc_id long, key binary, n_shingles long, fp binary, sig array<long>")


def text_key(text: Column) -> Column:
    """Tells the rows of one ``doc_id`` apart; null: empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def sets_of(wanted: DataFrame, size: int) -> DataFrame:
    """id and the sorted set of shingle hashes, as bytes, of the rows (id, fp, text) whose set has the digest ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 2, PIECE):
            sh, at = shingles(*bytes_of(b.column(2)), size)
            sets = [np.unique(sh[s:e]).tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            own = pa.array([len(x) > 0 and hashlib.blake2b(x, digest_size=16).digest() == f.as_py() for x, f in zip(sets, b.column(1), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "set"]).filter(own)

    return wanted.select("id", "fp", "text").mapInArrow(run, "id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = sorted((len(x), len(y)))
                both = 0
                if 100 * small >= percent * large:
                    merged = np.sort(np.concatenate([x, y]), kind="stable")
                    both = int((merged[1:] == merged[:-1]).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def ordered(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def sketched(sets: DataFrame) -> DataFrame:
    """id and SKETCH one-bit minhashes of its set, as longs of 64 bits."""
    seeds = np.random.Generator(np.random.PCG64(211)).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in b.column(1):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                least = np.full(SKETCH, np.uint64(2**64 - 1))
                # A long set is worked on in parts, so that memory does not follow its size.
                for at in range(0, len(own), PART):
                    for k in range(0, SKETCH, 32):
                        h = own[at : at + PART, None] * seeds[None, k : k + 32]
                        h ^= h >> np.uint64(31)
                        h *= np.uint64(0xD6E8FEB86659FD93)
                        least[k : k + 32] = np.minimum(least[k : k + 32], h.min(axis=0))
                bits = (least >> np.uint64(20)) & np.uint64(1)
                rows.append((bits.reshape(-1, 64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "sketch"])

    return sets.mapInArrow(run, "id long, sketch array<long>")


def sized(a: str, b: str, percent: int) -> Column:
    """Sets whose sizes differ more than this cannot be similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def links(docs: DataFrame, reps: DataFrame, scratch: Scratch, size: int, percent: int, groups: int, repeated: bool) -> DataFrame | None:
    """(id, component) of the classes (id, rep, fp, n, sig) that have a link; None if there is none. Where ids
    of documents are ``repeated``, a class may have its text in several rows of its representative."""
    tables = [(i, j) for i in range(groups) for j in range(i + 1, groups)]
    keys = F.array(*(F.xxhash64(F.lit(k), F.get("sig", i), F.get("sig", j)) for k, (i, j) in enumerate(tables)))
    entries = reps.select("id", "n", F.posexplode(keys).alias("pos", "key"))
    # Plain numbers only, so that both sides of the shuffle are hashed, not sorted.
    shared = entries.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least")
    members = scratch.table(entries.join(scratch.table(shared, "shared"), "key"), "members")
    asked = scratch.table(members.where("id != least").select("least", "id", "n").distinct(), "asked")
    sizes = asked.groupBy("least").agg(F.count("*").alias("w")).join(reps.select(F.col("id").alias("least"), F.col("n").alias("least_n")), "least")
    tried = hot_join(asked, scratch.table(sizes, "sizes"), "least", "w").where(sized("n", "least_n", percent))
    tried = scratch.table(tried.select(*ordered("least", "id")).distinct(), "pairs0")
    members = members.select("key", "pos", "id", "n")
    narrow = {"spark.sql.execution.arrow.maxRecordsPerBatch": "128"}
    wanted = reps.join(members.select("id").distinct(), "id", "left_semi").select("id", "fp", F.col("rep").alias("doc_id"))
    sets = sets_of((docs.distinct() if repeated else docs).join(wanted, "doc_id"), size)
    sets = scratch.table(sets.dropDuplicates(["id"]) if repeated else sets, "sets", narrow)
    found = scratch.table(confirmed(tried, sets, percent), "links0", narrow)
    components, k, changed = None, 0, True
    while True:
        if changed and not found.isEmpty():
            components = connected_components(found, lambda df, name, k=k: scratch.table(df, f"round{k}/{name}"), "a", "b")
        if k > ROUNDS:
            return components
        if changed:
            marked = members.withColumn("c", F.col("id"))
            if components is not None:
                marked = members.join(components, "id", "left").select("key", "pos", "id", "n", F.coalesce("component", "id").alias("c"))
            marked = scratch.table(marked, f"marked{k}")
        hub = F.min(F.struct(F.xxhash64("id", F.lit(k)), F.col("id"), F.col("c"), F.col("n"))).alias("hub")
        several = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), hub).where("lo < hi")
        left = scratch.table(marked.join(several.select("key", "hub"), "key"), f"several{k}")
        if left.isEmpty():
            return components
        # After a round that finds nothing new to compare, and after the last one, all that is left is compared.
        k = k + 1 if changed else ROUNDS + 1
        if k <= ROUNDS:
            pairs = left.where(F.col("c") != F.col("hub.c")).where(sized("n", "hub.n", percent)).select(*ordered("id", "hub.id")).distinct()
        else:
            pairs = across(left, sets, reps, scratch, percent, tables, narrow)
        new = scratch.table(pairs.join(tried, ["a", "b"], "left_anti"), f"pairs{k}")
        changed = not new.isEmpty()
        if changed:
            tried = tried.unionByName(new)
            more = scratch.table(confirmed(new, sets, percent), f"links{k}", narrow)
            found = found.unionByName(more)


def across(left: DataFrame, sets: DataFrame, reps: DataFrame, scratch: Scratch, percent: int, tables: list[tuple[int, int]], narrow: dict[str, str]) -> DataFrame:
    """Pairs of different components that share a table and that sizes and sketches do not rule out, each
    from the first table it shares only."""
    ids = left.select("id").distinct()
    marks = scratch.table(sketched(sets.join(ids, "id", "left_semi")), "sketches", narrow)
    # The first table that two rows share is told by 31 bits of each signature.
    small = F.transform("sig", lambda x: F.pmod(x, F.lit(2147483647)).cast("int")).alias("sig")
    marks = marks.join(reps.select("id", small), "id")
    i, j = (F.get(F.array(*(F.lit(t[x]) for t in tables)), F.col("pos")) for x in (0, 1))
    rows = scratch.table(left.select("key", i.alias("i"), j.alias("j"), "id", "n", "c").join(marks, "id"), "left")
    differ = lambda first, last: sum((F.bit_count(F.get("sketch1", w).bitwiseXOR(F.get("sketch2", w))) for w in range(first, last)), F.lit(0))
    words, head = SKETCH // 64, SKETCH // 256
    groups = 1 + max(t[1] for t in tables)
    earlier = sum((((F.col("j1") > g) & (F.col("i1") != g) & (F.get("sig1", g) == F.get("sig2", g))).cast("int") for g in range(groups)), F.lit(0))
    near = (differ(0, head) <= most_different(percent, 64 * head)) & (earlier == 0) & (differ(0, words) <= most_different(percent, SKETCH))
    columns = ("key", "i", "j", "id", "n", "c", "sig", "sketch")

    def compared(mine: DataFrame, other: DataFrame, more: Column) -> DataFrame:
        possible = more & sized("n1", "n2", percent) & near
        return mine.join(other, (mine.key1 == other.key2) & possible).select(*ordered("id1", "id2"))

    side = lambda df, k, *extra: df.select(*(F.col(c).alias(f"{c}{k}") for c in columns), *extra)
    large = scratch.table(rows.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK), "large")
    if large.isEmpty():
        # Both sides have the same columns in the same order, so one exchange serves both.
        return compared(side(rows, 1), side(rows, 2), F.col("c1") < F.col("c2"))
    cold = rows.join(large, "key", "left_anti")
    # A large bucket is cut into blocks, and each pair of blocks is a key of its own: no task compares a whole bucket.
    blocks = F.ceil(F.col("k") / BLOCK).cast("long")
    hot = hot_join(rows, large, "key", "k").withColumns({"nb": blocks, "blk": F.pmod(F.xxhash64("id"), blocks)})
    pair = lambda b, o: F.xxhash64("key", b, o)
    mine = side(hot.withColumn("o", F.explode(F.sequence(F.col("blk"), F.col("nb") - 1))).withColumn("key", pair("blk", "o")), 1, F.col("blk").alias("blk1"))
    other = side(hot.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blk")))).withColumn("key", pair("o", "blk")), 2, F.col("blk").alias("blk2"))
    apart = F.when(F.col("blk1") == F.col("blk2"), F.col("c1") < F.col("c2")).otherwise((F.col("blk1") < F.col("blk2")) & (F.col("c1") != F.col("c2")))
    return compared(side(cold, 1), side(cold, 2), F.col("c1") < F.col("c2")).unionByName(compared(mine, other, apart)).distinct()


def most_different(percent: int, bits: int) -> int:
    """Bits by which the sketches of a similar pair differ with all but a chance of about one in a million."""
    p = (1 - percent / 100) / 2
    return int(np.ceil(bits * p + 5 * (bits * p * (1 - p)) ** 0.5))


def judged(docs: DataFrame, size: int, percent: int = PERCENT, groups: int = GROUPS, per_group: int = PER_GROUP) -> DataFrame:
    """doc_id, key (of the text), n_shingles, component_id (the least doc_id reachable) and kept, for every row."""
    spark = docs.sparkSession
    docs = text_frame(docs)
    with Scratch(spark, "minhash") as scratch:
        sigs = scratch.table(signed(docs, size, groups, per_group), "sigs")
        repeated = not sigs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
        classes = sigs.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        # Classes are told apart by a number of their own, as one doc_id may stand for several; once written, it stays.
        reps = scratch.table(classes.withColumn("id", F.monotonically_increasing_id() if repeated else F.col("rep")), "reps")
        linked = links(docs, reps.select("id", "rep", "fp", "n", "sig"), scratch, size, percent, groups, repeated)
        placed = reps.select("id", "fp", "rep", "rows")
        if linked is None:
            placed = placed.withColumn("component", F.col("rep"))
        else:
            if repeated:
                linked = scratch.table(linked.join(reps.select("id", "rep"), "id"), "linked")
                least = linked.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
                linked = hot_join(linked, scratch.table(least, "least"), "component", "n").select("id", F.col("least").alias("component"))
            placed = placed.join(linked, "id", "left").select("fp", "rows", F.coalesce("component", "rep").alias("component"))
        placed = scratch.table(placed.select("fp", "rows", "component"), "classes")
        thin = sigs.select("doc_id", "key", "n_shingles", "fp")
        there = hot_join(thin.where("fp IS NOT NULL AND doc_id IS NOT NULL"), placed, "fp", "rows").select("doc_id", "key", "n_shingles", "component")
        alone = thin.where("fp IS NULL OR doc_id IS NULL").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component"))
        out = there.unionByName(alone).select("doc_id", "key", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
        return settled(out)


def near_duplicates(docs: DataFrame, size: int, percent: int = PERCENT, groups: int = GROUPS, per_group: int = PER_GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept, for every row."""
    return judged(docs, size, percent, groups, per_group).drop("key")


def deduplicate(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the least id, in the columns of ``docs``; of a repeated id only the rows that are copies go."""
    gone = judged(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_mh_id"), F.col("key").alias("_mh_key")).distinct()
    own = (F.col("doc_id").cast("long") == F.col("_mh_id")) & (text_key(F.col("text")) == F.col("_mh_key"))
    return docs.join(gone, own, "left_anti").select(*docs.columns)
