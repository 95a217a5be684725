"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become rows of lower-cased words with one space around each; every window of 13 words of
a benchmark item (a shorter item is one window) is a pattern. For each class of pattern
lengths, a shift table over hashed blocks says how far the search may jump; where it may not,
the block's bucket gives the patterns whose first ``m`` bytes end in it, and a direct
comparison confirms. Many cursors walk through a buffer side by side, so a step of the search
is a few array operations.

Cases: null and empty texts have no words and no hits; null or wordless items give no pattern;
items with a null id mark hits but are not listed; repeated items and windows count once;
repeated documents are each judged; texts beyond ``SLICE`` bytes are searched in slices that
overlap by the longest pattern, so memory stays bounded and nothing is cut off; an empty
benchmark leaves all clean; other columns pass through, and the new ones begin with ``_wm_``.

Patterns are broadcast in groups of at most ``GROUP_BYTES``; a larger benchmark takes one
pass over the documents for each group.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.llm.common import LOWER, by_size, bytes_of, word_edges

WINDOW = 13
PIECE = 2_000_000
SLICE = 8_000_000
GROUP_BYTES = 8_000_000
CLASSES = (1, 8, 16, 32)
TABLE_BITS = 20
#: A document is contaminated when at least 1/SHARE of its words are hit.
SHARE = 20
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = True
WORD[0x41:0x5B] = WORD[0x80:] = True
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def windows(text: str | None, size: int = WINDOW) -> list[list[bytes]]:
    words = WORDS.findall((text or "").encode().lower())
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


class Class:
    """Wu-Manber tables for the patterns of one class of lengths."""

    def __init__(self, patterns: dict[bytes, int]):
        self.least = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.shift = np.full(1 << TABLE_BITS, m - b + 1, np.int32)
        self.bucket: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        for p, number in patterns.items():
            head = np.frombuffer(p[:m], np.uint8)
            hashes = self.hashes(head, np.arange(b - 1, m))
            np.minimum.at(self.shift, hashes, np.arange(m - b, -1, -1, dtype=np.int32))
            self.bucket[int(hashes[-1])].append((p, number))

    def hashes(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        blocks = np.zeros((len(ends), 8), np.uint8)
        blocks[:, : self.block] = data[ends[:, None] + np.arange(1 - self.block, 1)]
        return ((blocks.view(np.uint64)[:, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, data: np.ndarray, stride: int = 2048) -> list[tuple[int, int]]:
        """(position, pattern number) of every occurrence."""
        m, n = self.least, len(data)
        if n < m:
            return []
        end = np.arange(m - 1, n, stride)
        limit = np.minimum(end + stride, n)
        found: list[tuple[int, int]] = []
        raw = data.tobytes()
        while len(end):
            h = self.hashes(data, end)
            step = self.shift[h]
            for e, k in zip(end[step == 0].tolist(), h[step == 0].tolist(), strict=True):
                found += [(e - m + 1, number) for p, number in self.bucket.get(k, ()) if raw.startswith(p, e - m + 1)]
            end = end + np.maximum(step, 1)
            go = end < limit
            end, limit = end[go], limit[go]
        return found


class Matcher:
    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        numbers: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        self.n_words: list[int] = []
        for item, text in items:
            for w in windows(text, size):
                k = numbers.setdefault(b" " + b" ".join(w) + b" ", len(numbers))
                if k == len(self.items):
                    self.items.append(set())
                    self.n_words.append(len(w))
                if item is not None:
                    self.items[k].add(item)
        sets: list[dict[bytes, int]] = [{} for _ in CLASSES]
        for p, k in numbers.items():
            sets[int(np.searchsorted(CLASSES, len(p), "right")) - 1][p] = k
        self.classes = [Class(s) for s in sets if s]
        self.longest = max(map(len, numbers), default=1)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Words of each text, and (text, word in the text, pattern) of every occurrence."""
        is_word = WORD[data]
        starts, ends, first = word_edges(is_word, offsets)
        n_words = np.diff(first)
        if not len(starts) or not self.classes:
            return n_words, []
        of = np.repeat(np.arange(len(n_words)), n_words)
        lengths = ends - starts
        # A space before each word, and after each text a space and a zero byte.
        at = np.cumsum(lengths + 1) - lengths - 1 + 2 * of
        row = np.full(int(at[-1] + lengths[-1] + 3), 32, np.uint8)
        put = np.repeat(at + 1 - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        put += np.arange(len(put))
        row[put] = LOWER[data[is_word]]
        last = np.flatnonzero(np.diff(of, append=-1))
        row[at[last] + lengths[last] + 2] = 0
        found = [x for c in self.classes for x in c.search(row)]
        if not found:
            return n_words, []
        places, numbers = np.array(found).T
        word = np.searchsorted(at, places)
        return n_words, list(zip(of[word].tolist(), (word - first[of[word]]).tolist(), numbers.tolist(), strict=True))

    def long_text(self, data: np.ndarray, slice_bytes: int) -> tuple[int, list[tuple[int, int]]]:
        """The same for one text, slice by slice; slices begin at the start of a word."""
        total, found, begin = 0, [], 0
        apart = ~WORD[data]
        while begin < len(data):
            gap = np.flatnonzero(apart[begin + slice_bytes :][:slice_bytes]) if begin + slice_bytes < len(data) else []
            cut = begin + slice_bytes + int(gap[0]) if len(gap) else len(data)
            part = data[begin : min(len(data), self.reach(data, cut))]
            _, got = self.texts(part, np.array([0, len(part)]))
            own = len(word_edges(WORD[data[begin:cut]], np.array([0, cut - begin]))[0])
            found += [(total + w, k) for _, w, k in got if w < own]
            total, begin = total + own, cut
        return total, found

    def reach(self, data: np.ndarray, cut: int) -> int:
        """Where the words that a pattern begun before ``cut`` may need have ended."""
        at, need = cut, max(self.n_words, default=1) + 1
        while at < len(data) and need > 0:
            block = data[at : at + 1_000_000]
            ends = word_edges(WORD[block], np.array([0, len(block)]))[1]
            if len(ends) >= need:
                return at + int(ends[need - 1]) + 1
            need, at = need - len(ends), at + len(block)
        return len(data)


SCHEMA = T.StructType(
    [T.StructField("_wm_n_words", T.LongType()), T.StructField("_wm_hits", T.ArrayType(T.LongType())), T.StructField("_wm_items", T.ArrayType(T.StringType()))]
)


def union(hits: list[int], more: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint intervals of words, flat: start, end, start, end, ..."""
    out: list[int] = []
    for s, e in sorted([*zip(hits[::2], hits[1::2], strict=True), *more]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def searched(docs: DataFrame, items: list[tuple[str | None, str | None]], size: int, first: bool, slice_bytes: int) -> DataFrame:
    """``docs`` with hits and items of one group of benchmark items added."""
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(items, size))
    at = docs.columns.index("text")
    n_in = len(docs.columns) - (0 if first else len(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for b in by_size(batches, at, PIECE):
            data, offsets = bytes_of(b.column(at))
            found: dict[int, list[tuple[int, int]]] = defaultdict(list)
            if len(data) > slice_bytes:
                n, got = m.long_text(data, slice_bytes) if b.num_rows == 1 else (0, [])
                n_words = [n]
                found[0] = got
            else:
                counts, triples = m.texts(data, offsets)
                n_words = counts.tolist()
                for d, w, k in triples:
                    found[d].append((w, k))
            hits = [[] for _ in n_words] if first else b.column(n_in + 1).to_pylist()
            names = [[] for _ in n_words] if first else b.column(n_in + 2).to_pylist()
            for d, got in found.items():
                hits[d] = union(hits[d], [(w, w + m.n_words[k]) for w, k in got])
                names[d] = sorted({*names[d], *(i for k in {k for _, k in got} for i in m.items[k])})
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n_in], pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
                names=[*b.schema.names[:n_in], *SCHEMA.names],
            )

    return docs.mapInArrow(run, T.StructType(docs.schema.fields[:n_in] + SCHEMA.fields))


def marked(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, group_bytes: int = GROUP_BYTES, slice_bytes: int = SLICE) -> DataFrame:
    """``docs`` with ``_wm_n_words``, ``_wm_n_hit``, ``_wm_items`` and ``_wm_contaminated``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    groups = max(1, -(-int(total) // group_bytes))
    out = docs
    for g in range(groups):
        part = items if groups == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        out = searched(out, [tuple(r) for r in part.collect()], size, g == 0, max(slice_bytes, PIECE))
    signed = F.transform("_wm_hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("_wm_n_hit", n_hit)
    return out.withColumn("_wm_contaminated", (F.col("_wm_n_hit") > 0) & (F.col("_wm_n_hit") * SHARE >= F.col("_wm_n_words"))).drop("_wm_hits")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.col("_wm_n_words").alias("n_words"), F.col("_wm_n_hit").alias("n_hit"), F.size("_wm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_wm_items"), ",").cast("binary"), 256).alias("items_sha256"), F.col("_wm_contaminated").alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, in the columns of ``docs``."""
    return marked(docs, benchmark).where(~F.col("_wm_contaminated")).select(*docs.columns)
