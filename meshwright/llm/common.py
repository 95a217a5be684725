"""What several operators of this subpackage share: tables in the shared folder, views of
texts as bytes, hash rules, and a join that keeps hot keys out of single tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The allocator hands every block above its limit back to the system at once, to be cleared and mapped again for
#: the next array. Freeing one block of nearly 32 MB raises that limit for the life of this process.
np.empty(31 << 20, np.uint8)

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process is a temporary folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = now.get() if now.isDefined() else ""
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it names the shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="meshwright-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables in the shared folder that live as long as the ``with`` block.

    Writing a table cuts the lineage: a lost executor costs the tasks of the step that runs,
    never the steps before it. Shuffle files of a step go as soon as its table is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def table(self, df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
        """Write ``df`` under these settings and read it again."""
        path, conf = f"{self.path}/{name}", {CLEANUP: "true"} | (conf or {})
        before = {k: self.spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """A final result of a few numbers for each document, kept as a reliable checkpoint: it stays in the shared folder,
    unless spark.cleaner.referenceTracking.cleanCheckpoints is set, which lets Spark's cleaner remove it."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", most: int = 2000) -> DataFrame:
    """Join many ``left`` rows with ``right``, which has one row per key and its number of
    left rows in ``weight``. The at most ``most`` keys that hold over 1/most of all left rows
    each are broadcast (their number is bounded by that share); the others are shuffled."""
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    bound = max(10_000, int(total) // most)
    hot = right.where(F.col(weight) > bound)
    keys = [r[0] for r in hot.select(key).limit(most + 1).collect()] if total > bound else []
    if not keys:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(keys)
    cold = left.where(~F.coalesce(is_hot, F.lit(False))).join(right.where(F.col(weight) <= bound), key, how)
    return left.where(is_hot).join(F.broadcast(hot), key, how).unionByName(cold)


def bounded_prefix(df: DataFrame, group: list[str], order: list, value, out: str, buckets: int, bucket_of) -> DataFrame:
    """Exclusive running sum of ``value`` inside ``group`` by (bucket, order).

    No task holds a whole group: rows are summed inside (group, bucket), and only the
    ``buckets`` totals of each group are summed over the group.
    """
    from pyspark.sql import Window as W

    marked = df.withColumn("_b", bucket_of).withColumn("_v", value)
    totals = marked.groupBy(*group, "_b").agg(F.sum("_v").alias("_t"))
    before = totals.withColumn("_o", F.sum("_t").over(W.partitionBy(*(group or [F.lit(0)])).orderBy("_b")) - F.col("_t")).drop("_t")
    inner = W.partitionBy(*group, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = marked.withColumn(out, F.sum("_v").over(inner) - F.col("_v"))
    return summed.join(before, [*group, "_b"]).withColumn(out, F.col(out) + F.col("_o")).drop("_b", "_v", "_o")


# --- texts as bytes -----------------------------------------------------------------------


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one array of bytes, and the n + 1 offsets; null: empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_size(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece have about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.diff(bytes_of(batch.column(text))[1])
        first = total = 0
        for i, s in enumerate(sizes):
            if i > first and total + s > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += s
        yield batch.slice(first)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the usual xor-shift-multiply finish)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


PRIME = np.uint64(2**31 - 1)


def folded(x: np.ndarray) -> np.ndarray:
    """The same modulo PRIME, 33 bits at most."""
    return (x & PRIME) + (x >> np.uint64(31))


def modular(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo PRIME."""
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out, step = np.concatenate([out, out * np.uint64(step) % PRIME]), step * step % int(PRIME)
    return out


class Prefixes:
    """62-bit hashes of any byte range of a buffer from one pass of prefix sums: polynomials in two bases
    modulo the prime 2**31 - 1. (Modulo a power of two, texts such as the Thue-Morse words would collide by rule.)"""

    _powers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        n = len(data) + 1
        rng = np.random.Generator(np.random.PCG64(seed))
        bases = rng.integers(2**20, int(PRIME), 2).tolist()
        have = self._powers.get(seed)
        if have is None or len(have[0][0]) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            have = self._powers[seed] = [(modular(b, size), modular(pow(b, -1, int(PRIME)), size)) for b in bases]
        self.down = [down for _, down in have]
        self.sums = []
        for up, _ in have:
            # Every term has 33 bits at most, so sums are exact up to 2**31 bytes.
            sums = np.zeros(n, np.uint64)
            np.cumsum(folded(rng.integers(1, int(PRIME), 256, dtype=np.uint64)[data] * up[: n - 1]), out=sums[1:])
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        parts = []
        for sums, down in zip(self.sums, self.down, strict=True):
            h = folded(folded(sums[end] - sums[start])) * down[start]
            h = folded(folded(h))
            parts.append(np.where(h >= PRIME, h - PRIME, h))
        return parts[0] | (parts[1] << np.uint64(31))


#: The lowest k bytes of a number, k from 0 to 8.
LOWEST = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
TOP = np.uint64(56)


def alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal slices of a buffer: the place of each class's first slice, and every slice's class.

    Slices of up to 7 bytes are numbers themselves. Longer ones are grouped by hash and then compared
    with the first one of their class, byte by byte, so slices of one class are equal whatever the hash."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts
    eight = byte_words(np.append(data, np.zeros(8, np.uint8)))
    head = eight[starts] & LOWEST[np.minimum(sizes, 8)]
    keys = head | (np.minimum(sizes, 7).astype(np.uint64) << TOP)
    some = np.flatnonzero(sizes > 7)
    tail = eight[ends[some] - 8]
    hashes = mixed(head[some] ^ mixed(tail))
    # Of slices over 16 bytes, a pool: the two ends do not tell all of them.
    long = np.flatnonzero(sizes[some] > 16)
    far = some[long]
    begun = np.cumsum(sizes[far]) - sizes[far]
    pool = data[np.repeat(starts[far] - begun, sizes[far]) + np.arange(int(sizes[far].sum()))]
    if len(far):
        hashes[long] = mixed(hashes[long] ^ Prefixes(pool, seed).of(begun, begun + sizes[far]))
    keys[some] = (hashes >> np.uint64(8)) | ((8 + (sizes[some] - 8) % 248).astype(np.uint64) << TOP)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    if not len(some):
        return first, which
    # Where each slice over 7 bytes, and over 16, stands among them; -1: it is shorter.
    place, in_pool = np.full(len(starts), -1), np.full(len(starts), -1)
    place[some], in_pool[far] = np.arange(len(some)), begun
    other = first[which[some]]
    differ = (sizes[other] != sizes[some]) | (head[other] != head[some]) | (tail[place[other]] != tail)
    whole = long[~differ[long]]
    if len(whole):
        own, begin, size = other[whole], begun[np.searchsorted(long, whole)], sizes[some[whole]]
        at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
        apart = pool[at + np.repeat(in_pool[own] - begin, size)] != pool[at]
        differ[whole] |= np.logical_or.reduceat(apart, np.cumsum(size) - size)
    odd = some[differ]
    if len(odd):
        known: dict[bytes, int] = {}
        first = first.tolist()
        for i in odd.tolist():
            raw = data[starts[i] : ends[i]].tobytes()
            if raw not in known:
                known[raw] = len(first)
                first.append(i)
            which[i] = known[raw]
        first = np.array(first)
    return first, which


def byte_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, without a copy; the buffer needs 8 bytes at least."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all grams of ``gram`` >= 8 bytes, eight bytes at a time; the last eight may overlap those before."""
    n, words = len(data) - gram + 1, byte_words(data)
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h ^= h >> np.uint64(32)
        h += words[at : at + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
    return mixed(h)


def word_edges(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each text, and of each text the first word's number (n + 1 values)."""
    n = len(is_word)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, is_word[:-1]
    after[-1], after[:-1] = False, is_word[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = False
    after[inner[1:] - 1] = False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_frame(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Only the two columns an operator needs, so that further ones cannot clash or be read."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
