"""Exact substring deduplication by a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``MATCH`` bytes that covers it also starts in a document with a
smaller ``doc_id``. Suffixes are sampled where a window's content says so: of all grams of
``gram`` bytes inside a MATCH-byte window the one with the least hash stands for the window, and
neighbouring windows with the same gram form a run. Equal windows have equal grams, so every
match shows among suffixes that begin with equal grams.

The arrays are in alphabetical order: by the first 16 bytes of the sampled suffix and the next 8 (in
the closer looks with longer grams by a hash of the gram instead of those 8), so grams of 20
bytes are compared byte by byte. Behind equal grams stands a 62-bit hash of the run's whole content.

The sampled suffixes are dealt out by their gram. In each deal a family of suffix arrays grows
in batches of ascending document ids: a new batch is sorted, merged against every level for
equal beginnings, and pushed as a level of rank 0; two levels of a rank merge into one of the
next. A level keeps the first document of each distinct run only. ``deduplicated`` grows a
family inside one job; ``Index`` keeps one in files, and takes batch after batch.

A run whose whole content is in an earlier document is a match as it stands. A run that shares
its gram but not its whole content is looked at again with longer grams, and at last window by
window, so the result is exact up to collisions of the hashes of contents with equal grams.

Cases: null and empty texts, and texts under MATCH bytes, lose nothing; a row with a null
``doc_id`` is neither earlier nor later than any other and stays whole; rows that share a
``doc_id`` are separate, and none is earlier than the other; texts are searched whole, in slices
of ``SLICE`` bytes that overlap by MATCH - 1; columns but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.llm.common import Prefixes, Scratch, by_size, byte_words, bytes_of, gram_hashes, mixed, settled, text_frame

MATCH = 50
GRAMS = (20, 40)
BATCHES = 4
#: Text bytes that are worked on together, and the slices of longer texts: few enough for a processor's cache.
PIECE = 250_000
SLICE = 250_000
#: Text bytes whose runs are combined before they are dealt out, and text bytes for each deal.
FLUSH = 12_000_000
DEAL = 12_000_000
#: The gram's bytes 0-7, 8-15 and the rest, the content's hash, and where the run is.
GRAM = ("high", "middle", "low")
NAMES = (*GRAM, "body", "doc", "sub", "start", "count")
KINDS = (np.uint64, np.uint64, np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int32)
Columns = dict[str, np.ndarray]


def runs(data: np.ndarray, offsets: np.ndarray, gram: int, wanted: np.ndarray | None) -> tuple[np.ndarray, Columns]:
    """Text of each run, and its gram, content hash, start and number of windows; gram = MATCH: of each window."""
    n = len(data) - MATCH + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: max(n, 0)]
    if n <= 0:
        return np.zeros(0, np.int64), {k: np.zeros(0, t) for k, t in zip((*GRAM, "body", "start", "count"), (np.uint64,) * 4 + (np.int64,) * 2, strict=True)}
    valid = np.arange(n) + MATCH <= offsets[1:][text]
    if wanted is not None:
        valid &= wanted[:n]
    hashes = least = gram_hashes(data, gram)
    width, size = MATCH - gram + 1, 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < width:
        least = np.minimum(least[:n], least[width - size : width - size + n])
    if gram == MATCH:
        start = last = np.flatnonzero(valid)
    else:
        apart = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(valid & np.concatenate([[True], apart | ~valid[:-1]]))
        last = np.flatnonzero(valid & np.concatenate([apart | ~valid[1:], [True]]))
    own, at, left = least[start], start.copy(), np.arange(len(start))
    for k in range(width):
        left = left[hashes[start[left] + k] != own[left]] if k else left[hashes[start[left]] != own[left]]
        at[left] = start[left] + k + 1
        if not len(left):
            break
    # Big-endian numbers are in the order of their bytes.
    eight = byte_words(np.append(data, np.zeros(16, np.uint8)))
    words = [eight[at].byteswap(), eight[at + 8].byteswap(), own if gram > 24 else eight[at + 16].byteswap() >> np.uint64(8 * (24 - gram))]
    body = mixed(Prefixes(data, 37).of(start, last + MATCH) + (last - start).astype(np.uint64))
    return text[start], dict(zip(GRAM, words, strict=True)) | {"body": body, "start": start - offsets[:-1][text[start]], "count": last - start + 1}


def tags(c: Columns) -> np.ndarray:
    """One number for each gram; equal grams have equal ones."""
    return mixed(c["high"] ^ mixed(c["middle"] ^ mixed(c["low"])))


def packed(c: Columns) -> bytes:
    """Sorted columns as bytes: differences of the first words and byte planes compress well."""
    planes = []
    for name, kind in zip(NAMES, KINDS, strict=True):
        v = c[name].astype(kind)
        v = np.diff(v, prepend=np.uint64(0)) if name == "high" else v
        planes.append(np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, n: int) -> Columns:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, {}
    for name, kind in zip(NAMES, KINDS, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        v = np.ascontiguousarray(planes.T).view(kind).ravel()
        out[name], at = np.cumsum(v, dtype=np.uint64) if name == "high" else v, at + n * size
    return out


def taken(c: Columns, which: np.ndarray) -> Columns:
    return {k: v[which] for k, v in c.items()}


def joined(parts: list[Columns]) -> Columns:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def in_order(c: Columns) -> Columns:
    """By gram, content and document: one comparison of 40 bytes is cheaper than five sorts."""
    rows = np.empty((len(c["high"]), 5), ">u8")
    for k, name in enumerate((*GRAM, "body")):
        rows[:, k] = c[name]
    rows[:, 4] = c["doc"].astype(np.int64).view(np.uint64) ^ np.uint64(2**63)
    return taken(c, np.argsort(rows.view("S40").ravel(), kind="stable"))


def changes(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def later(c: Columns) -> np.ndarray:
    """Of sorted rows: whether the same run is in a document with a smaller id."""
    new = changes(*(c[k] for k in (*GRAM, "body")))
    return c["doc"] > c["doc"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else new


class Family:
    """Levels of suffix arrays: (rank, columns); ``sent`` marks rows given out for a closer look."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, Columns]] = []
        self.grew = False

    def absorb(self, batch: Columns) -> tuple[Columns, Columns]:
        """Add a batch of larger document ids. Gives the runs found earlier, and those to look at again."""
        batch = in_order(batch)
        n = len(batch["high"])
        parts = [batch | {"level": np.full(n, -1), "row": np.arange(n), "sent": np.zeros(n, bool)}]
        mine = np.unique(tags(batch))
        for k, (_, level) in enumerate(self.levels):
            theirs = tags(level)
            near = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs) if n else np.zeros(0, np.int64)
            parts.append(taken(level, near) | {"level": np.full(len(near), k), "row": near})
        both = in_order(joined(parts)) if len(parts) > 1 else parts[0]
        late = later(both)
        found = taken(both, late)
        fresh = taken(both, ~late)
        again = np.zeros(0, bool)
        if len(fresh["high"]):
            new = changes(*(fresh[k] for k in GRAM))
            at, group = np.flatnonzero(new), np.cumsum(new) - 1
            several = np.minimum.reduceat(fresh["doc"], at) < np.maximum.reduceat(fresh["doc"], at)
            again = several[group] & ~fresh["sent"]
        out = taken(fresh, again)
        fresh["sent"] = fresh["sent"] | again
        for k, (_, level) in enumerate(self.levels):
            level["sent"][out["row"][out["level"] == k]] = True
        self.push(taken({k: fresh[k] for k in (*NAMES, "sent")}, fresh["level"] == -1))
        return found, out

    def push(self, level: Columns) -> None:
        rank, self.grew = 0, True
        while self.levels and self.levels[-1][0] == rank:
            level, rank = in_order(joined([self.levels.pop()[1], level])), rank + 1
        self.levels.append((rank, level))


MANIFEST = "version int, level int, rank int, deals int, last_id long"
FOUND = "doc_id long, sub int, start int, count int, again boolean"
DEALT = "deal int, batch int, n int, blob binary"


def dealt(texts: DataFrame, gram: int, deals: int, bounds: list[int]) -> DataFrame:
    """Rows of packed runs for each deal and batch. Of equal runs in one flush only the first document's
    go on; the others are matches already and travel as a batch -1. ``ranges``: flat pairs (start, count)."""
    has_ranges = "ranges" in texts.columns

    def flushed(parts: list[Columns]) -> pa.RecordBatch:
        c = in_order(joined(parts))
        late = later(c)
        rows = []
        first, gone = taken(c, ~late), taken(c, late)
        deal = (tags(first) % np.uint64(deals)).astype(np.int64)
        batch = np.searchsorted(bounds, first["doc"], "left")
        label = deal * (len(bounds) + 1) + batch
        order = np.argsort(label, kind="stable")
        cut = np.flatnonzero(changes(label[order]))
        for which in np.split(order, cut[1:]) if len(order) else []:
            rows.append((int(deal[which[0]]), int(batch[which[0]]), len(which), packed(taken(first, which))))
        if len(gone["high"]):
            rows.append((int(tags(taken(gone, slice(1)))[0] % np.uint64(deals)), -1, len(gone["high"]), packed(gone)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["deal", "batch", "n", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Columns] = []
        held = 0
        for b in by_size(batches, 2, PIECE):
            ids, subs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            data, offsets = bytes_of(b.column(2))
            ranges = b.column(3) if has_ranges else None
            for rows, base, part, at in sliced(data, offsets):
                wanted = None
                if ranges is not None:
                    steps = np.zeros(len(part) + 1, np.int32)
                    for k, row in enumerate(rows):
                        r = ranges[row].values.to_numpy()
                        low = np.clip(r[::2] - base, 0, at[k + 1] - at[k])
                        high = np.clip(r[::2] + r[1::2] - base, 0, at[k + 1] - at[k])
                        np.add.at(steps, at[k] + low, 1)
                        np.add.at(steps, at[k] + high, -1)
                    wanted = np.cumsum(steps)[:-1] > 0
                text, c = runs(part, at, gram, wanted)
                row = np.asarray(rows)[text] if len(text) else np.zeros(0, np.int64)
                parts.append({k: c[k] for k in (*GRAM, "body")} | {"doc": ids[row], "sub": subs[row], "start": (c["start"] + base).astype(np.int32), "count": c["count"].astype(np.int32)})
                held += len(part)
            if held >= FLUSH:
                if any(len(p["high"]) for p in parts):
                    yield flushed(parts)
                parts, held = [], 0
        if any(len(p["high"]) for p in parts):
            yield flushed(parts)

    return texts.mapInArrow(run, DEALT)


def sliced(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list[int], int, np.ndarray, np.ndarray]]:
    """(rows, first byte, bytes, offsets); texts over SLICE bytes come alone, in slices that overlap."""
    n = len(offsets) - 1
    if n == 1 and len(data) > SLICE:
        for begin in range(0, len(data) - MATCH + 1, SLICE):
            part = data[begin : begin + SLICE + MATCH - 1]
            yield [0], begin, part, np.array([0, len(part)])
    else:
        yield list(range(n)), 0, data, offsets


def unpacked_rows(table: pa.Table, which: np.ndarray) -> Columns:
    sizes, blobs = table.column("n").to_numpy(), table.column("blob")
    return joined([unpacked(blobs[int(i)].as_py(), int(sizes[i])) for i in which]) if len(which) else {k: np.zeros(0, t) for k, t in zip(NAMES, KINDS, strict=True)}


def grown(family: Family, table: pa.Table) -> list[tuple[Columns, bool]]:
    """The family takes a deal's batches in order of document ids: runs found earlier, and (True) runs to look at again."""
    batch, out = table.column("batch").to_numpy(), []
    for k in np.unique(batch).tolist():
        parts = unpacked_rows(table, np.flatnonzero(batch == k))
        if k < 0:
            out.append((parts, False))
            continue
        hit, more = family.absorb(parts)
        out += [(hit, False), (more, True)]
    return [(c, again) for c, again in out if len(c["high"])]


def found_columns(out: list[tuple[Columns, bool]]) -> list[pa.Array]:
    """doc_id, sub, start, count, again."""
    columns = [pa.array(np.concatenate([np.zeros(0, t), *(c[k] for c, _ in out)])) for k, t in (("doc", np.int64), ("sub", np.int32), ("start", np.int32), ("count", np.int32))]
    return [*columns, pa.array(np.concatenate([np.zeros(0, bool), *(np.full(len(c["high"]), again) for c, again in out)]), pa.bool_())]


def scanned(table: pa.Table) -> pa.Table:
    """One deal."""
    return pa.Table.from_arrays(found_columns(grown(Family(), table)), names=["doc_id", "sub", "start", "count", "again"])


def flat(found: DataFrame) -> DataFrame:
    """Of each document the flat list (start, count, ...)."""
    pairs = F.sort_array(F.collect_list(F.struct("start", "count")))
    return found.groupBy("doc_id", "sub").agg(F.flatten(F.transform(pairs, lambda p: F.array(p["start"], p["count"]))).alias("ranges"))


def cut_out(texts: DataFrame) -> DataFrame:
    """The digest of each text without the windows of its ranges, and the text that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 1, PIECE):
            data, offsets = bytes_of(b.column(1))
            rows = []
            for k in range(b.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                ranges = b.column(2)[k].values
                if ranges is None or len(ranges) == 0:
                    rows.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
                    continue
                r = ranges.to_numpy()
                steps = np.zeros(len(text) + 1, np.int32)
                np.add.at(steps, r[::2], 1)
                np.add.at(steps, r[::2] + r[1::2] + MATCH - 1, -1)
                gone = np.cumsum(steps)[:-1] > 0
                spans = int(changes(gone)[gone].sum())
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def numbered(docs: DataFrame) -> DataFrame:
    """``sub`` tells rows with one doc_id apart; only where there are such rows is a shuffle needed."""
    docs = text_frame(docs)
    if docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        return docs.withColumn("sub", F.lit(0))
    return docs.withColumn("sub", F.row_number().over(W.partitionBy("doc_id").orderBy("text")) - 1)


def closer(texts: DataFrame, found: DataFrame, deals: int, scratch: Scratch) -> DataFrame:
    """All matches, from the first look's ``found``: what is to be looked at again goes through longer grams."""
    parts = [found.where(~F.col("again"))]
    for k, gram in enumerate((*GRAMS[1:], MATCH)):
        again = found.where("again")
        if again.isEmpty():
            break
        rows = dealt(texts.join(flat(again), ["doc_id", "sub"]), gram, deals, [])
        found = scratch.table(rows.groupBy("deal").applyInArrow(scanned, FOUND), f"closer{k}")
        parts.append(found.where(~F.col("again")))
    return reduce(DataFrame.unionByName, parts).select("doc_id", "sub", "start", "count")


def long_enough(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").where(F.octet_length("text") >= MATCH).select("doc_id", "sub", "text")


def deals_of(texts: DataFrame) -> int:
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(8, -(-int(total) // DEAL))


def repeats(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, deals: int | None = None) -> DataFrame:
    """(doc_id, sub, start, count): windows that also start in an earlier document, as ranges of window starts.

    ``docs`` comes from ``numbered``."""
    texts = long_enough(docs)
    deals = deals or deals_of(texts)
    bounds = sorted({int(x) for x in texts.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)}) if batches > 1 else []
    found = dealt(texts, GRAMS[0], deals, bounds).groupBy("deal").applyInArrow(scanned, FOUND)
    return closer(texts, scratch.table(found, "found"), deals, scratch)


def deduplicated(docs: DataFrame, batches: int = BATCHES, deals: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    with Scratch(docs.sparkSession, "suffix-index") as scratch:
        rows = numbered(docs)
        ranges = flat(repeats(rows, scratch, batches, deals))
        return settled(cut_out(rows.join(ranges, ["doc_id", "sub"], "left").select("doc_id", "text", "ranges")))


class Index:
    """A family of suffix arrays in files under ``path``, which grows by batches of ascending document ids.

    A level is a folder with one row for each deal; ``manifest`` names the levels of every version. Adding
    a batch writes its texts and one level, that of its own suffixes and of the levels that merge with
    it; the others stay as they are. ``deals`` is fixed by the first batch (one for DEAL text bytes
    unless given): a deal's share of all levels is held by one task, so give the number that the
    whole corpus will need. A batch that was not finished leaves files that the next one replaces.
    """

    def __init__(self, spark: SparkSession, path: str, deals: int | None = None):
        self.spark, self.path, self.deals = spark, path.rstrip("/"), deals

    def versions(self) -> list[Row]:
        """(version, level, rank, deals, last_id) of the newest version's levels, in their order."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return []
        manifest = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        newest = manifest.agg(F.max("version")).first()[0]
        return sorted(manifest.where(F.col("version") == newest).collect(), key=lambda r: r.level)

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of the batch; its ids must be above all earlier ones."""
        spark, now = self.spark, self.versions()
        rows = numbered(docs)
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        before = max((r.last_id for r in now), default=None)
        if low is not None and before is not None and low <= before:
            raise ValueError(f"document ids of a batch must be above {before}, found {low}")
        version = now[0].version + 1 if now else 1
        deals = now[0].deals if now else self.deals or deals_of(long_enough(rows))
        levels = [(r.level, r.rank) for r in now]
        rank, merged = 0, 0
        while merged < len(levels) and levels[-1 - merged][1] == rank:
            rank, merged = rank + 1, merged + 1
        ranks = [r for _, r in levels]

        def run(table: pa.Table) -> pa.Table:
            level = table.column("level").to_numpy()
            family = Family()
            for k, r in enumerate(ranks):
                c = unpacked_rows(table, np.flatnonzero(level == k))
                family.levels.append((r, c | {"sent": np.zeros(len(c["high"]), bool)}))
            out = grown(family, table.filter(pa.array(level < 0)))
            if not family.grew:
                family.push({k: np.zeros(0, t) for k, t in zip((*NAMES, "sent"), (*KINDS, bool), strict=True)})
            last = family.levels[-1][1]
            columns, n = found_columns(out), sum(len(c["high"]) for c, _ in out)
            extra = [pa.array([deal] * n + [deal], pa.int32()) for deal in [table.column("deal")[0].as_py()]]
            columns = [pa.concat_arrays([c, pa.array([None], c.type)]) for c in columns]
            sizes, blobs = pa.array([None] * n + [len(last["high"])], pa.int32()), pa.array([None] * n + [packed(last)], pa.binary())
            return pa.Table.from_arrays([*columns, *extra, sizes, blobs], names=["doc_id", "sub", "start", "count", "again", "deal", "n", "blob"])

        with Scratch(spark, "suffix-index") as scratch:
            long_enough(rows).write.mode("overwrite").parquet(f"{self.path}/texts/batch={version}")
            batch = spark.read.schema("doc_id long, sub int, text string").parquet(f"{self.path}/texts/batch={version}")
            parts = [dealt(batch, GRAMS[0], deals, []).withColumn("level", F.lit(-1))]
            for k, (name, _) in enumerate(levels):
                stored = spark.read.schema("deal int, n int, blob binary").parquet(f"{self.path}/levels/{name}")
                parts.append(stored.select("deal", F.lit(0).alias("batch"), "n", "blob", F.lit(k).alias("level")))
            done = scratch.table(reduce(DataFrame.unionByName, parts).groupBy("deal").applyInArrow(run, f"{FOUND}, deal int, n int, blob binary"), "first")
            done.where("blob IS NOT NULL").select("deal", "n", "blob").write.mode("overwrite").parquet(f"{self.path}/levels/{version}")
            texts = spark.read.schema("doc_id long, sub int, text string").parquet(*(f"{self.path}/texts/batch={k}" for k in range(1, version + 1)))
            found = closer(texts, done.where("blob IS NULL").select("doc_id", "sub", "start", "count", "again"), deals, scratch)
            found = found.join(batch.select("doc_id", "sub"), ["doc_id", "sub"], "left_semi")
            out = settled(cut_out(rows.join(flat(found), ["doc_id", "sub"], "left").select("doc_id", "text", "ranges")))
        last = max(x for x in (before, high, -(2**63)) if x is not None)
        kept = [*levels[: len(levels) - merged], (version, rank)]
        spark.createDataFrame([(version, name, r, deals, last) for name, r in kept], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return out
