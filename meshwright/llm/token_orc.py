"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt into ranges of ``doc_id``, encoded, and written in ascending order, one file
for each range; the file names ascend as well. Stripes are small enough to be read side by
side, and a reader that asks for document ids skips files, stripes and row groups by their
statistics and Bloom filters.

Encoding cuts a buffer of texts into the tokenizer's own pre-tokens with array operations and
encodes each distinct pre-token once, by the tokenizers library; which class a character has is
asked of the library, too. Tokenizers of another make, and texts that hold a special token's
string, are encoded by the library as they are.

Cases: null and empty texts have the end id only; a null ``doc_id`` sorts first; equal ids keep
all their rows, ordered by text; texts are encoded whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import Scratch, alike, bounded_prefix, by_size, bytes_of, settled, text_frame

END_ID = 2
PIECE = 1_500_000
MOST_KNOWN = 800_000
#: Text bytes for each file at most, on average, once there are more than the session's shuffle partitions hold.
FILE_BYTES = 256_000_000
FILE_SCHEMA = "row long, doc_id long, ids array<int>"
OPTIONS = {
    "compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
SUFFIXES = {b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"}


def byte_characters() -> dict[int, str]:
    """The alphabet of byte-level tokenizers: printing characters of Latin-1 stand for themselves, the other bytes for characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_CHARACTERS = byte_characters()


class Encoder:
    """Ids of whole texts, equal to the library's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.split = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # A pre-token is what the library's merge model takes, byte by byte in its alphabet.
        self.model = self.tokenizer.model if self.split and (spec.get("model") or {}).get("type") == "BPE" else None
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.learn(np.arange(128))
        self.forget()

    def forget(self) -> None:
        """Known pre-tokens by number; the ids of number k are flat[ends[k]:ends[k + 1]]. Both arrays grow by doubling."""
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def learn(self, points: np.ndarray) -> None:
        """Ask the library with which characters each of these joins."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.split else None
        for p in points.tolist() if cut else ():
            c = chr(p)
            self.classes[p] = next((k for k, with_ in enumerate("a1!") if len(cut(with_ + c)) == 1), SPACE)

    def class_of(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        out = self.classes[:128].take(data, mode="clip")
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            point = first & (0x7F >> size)
            for k in (1, 2, 3):
                more = size > k
                point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
            self.learn(np.unique(point[self.classes[point] == UNKNOWN]))
            of = self.classes[point]
            for k in (0, 1, 2, 3):
                out[lead[size > k] + k] = of[size > k]
        return out

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin."""
        n = len(data)
        kind = self.class_of(data)
        begin = np.empty(n, bool)
        begin[0], begin[1:] = True, kind[1:] != kind[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        begin[inner] = True
        # The last character of a run of white space that something follows: a blank joins what follows, another stands alone.
        after = np.flatnonzero(begin)
        after = after[(after > 0) & (kind[after] != SPACE)]
        after = after[(kind[after - 1] == SPACE) & ~np.isin(after, inner)]
        last = after - 1
        while (tail := (data[last] & 0xC0) == 0x80).any():
            last[tail] -= 1
        begin[last] = True
        begin[after[data[after - 1] == 32]] = False
        # An apostrophe that begins a pre-token and a suffix after it are one.
        opens = np.zeros(n, bool)
        opens[inner] = True
        for q in np.flatnonzero(begin & (data == 39)).tolist():
            if q + 1 < n and kind[q + 1] == LETTER and begin[q + 1] and not opens[q + 1]:
                for size in (1, 2):
                    if bytes(data[q + 1 : q + 1 + size]) in SUFFIXES and not begin[q + 2 : q + 1 + size].any():
                        begin[q + 1] = False
                        if q + 1 + size < n:
                            begin[q + 1 + size] = True
                        break
        return np.flatnonzero(begin)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts in them."""
        data, offsets = bytes_of(column)
        n = len(offsets) - 1
        if not self.split or any(data.tobytes().find(s) >= 0 for s in self.special):
            each = [e.ids for e in self.tokenizer.encode_batch(column.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.array([i for e in each for i in e], np.int32), np.concatenate([[0], np.cumsum([len(e) for e in each], dtype=np.int64)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        begins = self.cuts(data, offsets)
        ends = np.append(begins[1:], len(data))
        first, which = alike(data, begins, ends, 11)
        raw = data.tobytes()
        words = [raw[b:e] for b, e in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.known) + len(words) > MOST_KNOWN:
            self.forget()
        got = list(map(self.known.get, words))
        new = [i for i, k in enumerate(got) if k is None]
        base = self.add([words[i] for i in new])
        number = np.array([-1 if k is None else k for k in got] if new else got, np.int64)
        number[new] = np.arange(base, base + len(new))
        number = number[which]
        bounds = self.ends
        lengths = bounds[number + 1] - bounds[number]
        at = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(bounds[number] - at[:-1], lengths) + np.arange(at[-1])]
        return ids, at[np.searchsorted(begins, offsets)]

    def add(self, words: list[bytes]) -> int:
        """Encode further pre-tokens; the number of the first."""
        base = len(self.known)
        if self.model is None:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        else:
            tokenize = self.model.tokenize
            lists = [[t.id for t in tokenize(w.decode("latin-1").translate(BYTE_CHARACTERS))] for w in words]
        ends = int(self.ends[base]) + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        if base + len(words) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(words) + 1), np.int64)])
        if len(lists):
            if ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), int(ends[-1])), np.int32)])
            self.flat[self.ends[base] : ends[-1]] = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1] - self.ends[base]))
        self.ends[base + 1 : base + 1 + len(words)] = ends
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        return base


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    out = np.full(len(ids) + n, end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = ids
    return out, at


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Write the ids of all documents to ``path``. ``tokenizer`` names a file that every executor has."""
    spark = docs.sparkSession
    if files is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, row = encoder(tokenizer), 0
        for b in by_size(batches, 1, PIECE):
            ids, at = with_end(*e.encode(b.column(1)), end_id)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), b.column(0), lists], names=["row", "doc_id", "ids"])
            row += b.num_rows

    ranges = text_frame(docs).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    ranges.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Documents of a range or a set of ids; the conditions reach the ORC reader's statistics and Bloom filters."""
    out = spark.read.schema(FILE_SCHEMA).orc(path)
    if low is not None:
        out = out.where(F.col("doc_id") >= low)
    if high is not None:
        out = out.where(F.col("doc_id") <= high)
    return out if ids is None else out.where(F.col("doc_id").isin(ids))


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        at = lists.offsets.to_numpy().astype(np.int64)
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["file", "row", "doc_id", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """Of each document in the files: where its ids start, their number and their checksum."""
    # Files ascend by the number in their names, which has five digits or more.
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    stored = spark.read.schema(FILE_SCHEMA).orc(path).select(number.alias("file"), "row", "doc_id", "ids")
    thin = scratch.table(stored.mapInArrow(checksums, "file long, row long, doc_id long, n_tokens long, ids_crc32 long"), "thin")
    placed = bounded_prefix(thin, [], [F.col("row")], F.col("n_tokens"), "start", 0, F.col("file"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write, read back and digest; the files go when their digest is known."""
    spark = docs.sparkSession
    with Scratch(spark, "token-orc") as scratch:
        write(docs, f"{scratch.path}/orc", tokenizer)
        return settled(digest(spark, f"{scratch.path}/orc", scratch))
