"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Blanks become the whitespace marker and one marker goes before the text. No piece holds a
marker after another character, so the best path of a text is that of its words, each with the
markers before it; distinct words of a buffer are solved once, all side by side: the trie
advances one byte for all open starts at a time, and the Viterbi recursion one start position
for all words at a time. A character that no piece begins with alone costs ``UNKNOWN_COST``
below the least score and is written as its UTF-8 bytes' pieces.

Scores: those of the model file if it is a unigram model; a merge-ranked vocabulary gives each
piece the log frequency of its rank under Zipf's law instead.

Cases: null and empty texts have no ids; a marker character in the text itself is written in
bytes, so decoding gives every text back exactly; words and texts of any length are solved
whole; repeated rows are encoded alike; other columns pass through ``encode`` except the text; columns
named ``ids`` or ``n_tokens`` are replaced by its own.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.llm.common import alike, by_size, bytes_of

PIECE = 2_000_000
UNKNOWN_COST = 10.0
#: Stands for the whitespace marker inside this module; no UTF-8 text holds this byte.
MARK = 0xFF
MARKER = "▁"


class Trie:
    """base/check arrays: from state s byte c leads to t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, words: list[bytes]):
        below: list[dict[int, int]] = [{}]
        value = {}
        for k, w in enumerate(words):
            node = 0
            for c in w:
                if c not in below[node]:
                    below[node][c] = len(below)
                    below.append({})
                node = below[node][c]
            value[node] = k
        size = 4 * len(below) + 70_000
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        low, queue = 0, deque([(0, 0)])
        while queue:
            node, state = queue.popleft()
            self.value[state] = value.get(node, -1)
            codes = np.array(sorted(below[node]), np.int64) + 1
            if not len(codes):
                continue
            # The first base from which all children fall on free places, looked for in blocks.
            low, at = low + int(np.argmin(used[low:])), max(0, low - int(codes[0]))
            while True:
                fits = np.ones(min(4096, size - at - 257), bool)
                for c in codes:
                    fits &= ~used[at + c : at + c + len(fits)]
                if fits.any():
                    break
                at += len(fits)
            base = at + int(np.argmax(fits))
            self.base[state] = base
            used[base + codes] = True
            self.check[base + codes] = state
            queue.extend((below[node][int(c) - 1], base + int(c)) for c in codes)
        # Every lookup from a used state stays inside the arrays.
        pad = np.full(258, -1, np.int32)
        self.base, self.check, self.value = np.append(self.base, pad), np.append(self.check, pad), np.append(self.value, pad)

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, word) of every stored word that begins at a start and ends by its limit."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        begin, at, limit, state = starts, starts, ends, np.zeros(len(starts), np.int32)
        while len(at):
            go = self.base[state] + data[at] + 1
            ok = self.check[go] == state
            begin, at, limit, state = begin[ok], at[ok] + 1, limit[ok], go[ok]
            word = self.value[state]
            hit = word >= 0
            found.append((begin[hit], at[hit], word[hit]))
            inside = at < limit
            begin, at, limit, state = begin[inside], at[inside], limit[inside], state[inside]
        zero = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (zero, zero, zero)


class Model:
    """Pieces, scores and the trie; small enough to broadcast (bounded by the vocabulary)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        unigram = any(sp.get_score(i) != int(sp.get_score(i)) for i in range(n))
        self.bytes_ids = np.full(256, -1, np.int32)
        self.raw: list[bytes] = [b""] * n
        ids, words, scores = [], [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.bytes_ids[b], self.raw[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = piece.replace(MARKER, " ").encode()
                ids.append(i)
                words.append(piece.encode().replace(MARKER.encode(), bytes([MARK])))
                scores.append(sp.get_score(i))
        if (self.bytes_ids < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        if not unigram:
            rank = np.argsort(np.argsort(-np.array(scores), kind="stable"), kind="stable")
            total = math.fsum(1 / (r + 1) for r in range(len(scores)))
            scores = [-math.log((r + 1) * total) for r in rank.tolist()]
        self.ids, self.scores = np.array(ids, np.int32), np.array(scores, np.float32)
        self.unknown = np.float32(min(scores) - UNKNOWN_COST)
        self.by_word = not any(bytes([MARK]) in w.lstrip(bytes([MARK])) for w in words)
        self.trie = Trie(words)
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def solve(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best path of each word, and the n + 1 offsets."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        is_start = (data & 0xC0) != 0x80
        starts = np.flatnonzero(is_start)
        word = np.searchsorted(offsets, starts, "right") - 1
        after = np.append(starts[1:], len(data))
        begin, end, piece = self.trie.matches(data, starts, offsets[1:][word])
        score = self.scores[piece]
        # Starts without a piece of exactly one character get an edge of their own.
        one = np.zeros(len(data) + 1, bool)
        follow = np.zeros(len(data) + 1, np.int64)
        follow[starts] = after
        one[begin[end == follow[begin]]] = True
        lone = starts[~one[starts]]
        begin, end = np.concatenate([begin, lone]), np.concatenate([end, follow[lone]])
        piece, score = np.concatenate([piece, np.full(len(lone), -1)]), np.concatenate([score, np.full(len(lone), self.unknown, np.float32)])
        # Places in front of and behind each byte; the place behind a word is its own.
        of = np.searchsorted(offsets, begin, "right") - 1
        source, target = begin + of, end + of
        best = np.full(len(data) + n + 1, -np.inf, np.float32)
        best[offsets[:-1] + np.arange(n)] = 0
        came, by = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        depth = begin - offsets[:-1][of]
        order = np.argsort(depth, kind="stable")
        source, target, piece, score = source[order], target[order], piece[order], score[order]
        cut = np.concatenate([[0], np.cumsum(np.bincount(depth))])
        for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if low == high:
                continue
            s, t = source[low:high], target[low:high]
            value = best[s] + score[low:high]
            better = value > best[t]
            t = t[better]
            best[t], came[t], by[t] = value[better], s[better], piece[low:high][better]
        # Walk all words backwards at once, then turn each round.
        at = offsets[1:] + np.arange(n)
        home = offsets[:-1] + np.arange(n)
        live = np.flatnonzero(at != home)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            here = at[live]
            steps.append((live, came[here], by[here]))
            at[live] = came[here]
            live = live[at[live] != home[live]]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        which, place, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(place, kind="stable")
        which, place, piece = which[order], place[order], piece[order]
        byte = place - which
        known = piece >= 0
        width = np.where(known, 1, follow[byte] - byte)
        spot = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int32)
        out[spot[known]] = self.ids[piece[known]]
        for k in range(4):
            some = ~known & (width > k)
            out[spot[some] + k] = self.bytes_ids[data[byte[some] + k]]
        counts = np.bincount(which, weights=width, minlength=n).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(counts)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and their n + 1 offsets."""
        n = len(offsets) - 1
        full = np.diff(offsets) > 0
        marked = np.insert(np.where(data == 32, np.uint8(MARK), data), offsets[:-1][full], MARK)
        at = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(marked):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        begin = np.zeros(len(marked), bool)
        begin[at[:-1][full]] = True
        if self.by_word:
            begin[1:] |= (marked[1:] == MARK) & (marked[:-1] != MARK)
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(marked))
        first, which = alike(marked, starts, ends, 41)
        sizes = (ends - starts)[first]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        pool = marked[np.repeat(starts[first] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        ids, cut = self.solve(pool, bounds)
        lengths = np.diff(cut)[which]
        to = np.concatenate([[0], np.cumsum(lengths)])
        out = ids[np.repeat(cut[:-1][which] - to[:-1], lengths) + np.arange(to[-1])]
        return out, to[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and their n + 1 offsets: markers become blanks, byte pieces bytes; the first blank goes."""
        sizes = self.sizes[ids]
        to = np.concatenate([[0], np.cumsum(sizes)])
        out = self.flat[np.repeat(self.places[ids] - to[:-1], sizes) + np.arange(to[-1])]
        at = to[offsets]
        full = np.diff(at) > 0
        keep = np.ones(len(out), bool)
        keep[at[:-1][full]] = out[at[:-1][full]] != 32
        return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def broadcast_model(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(Model(path))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, ``n_tokens`` and ``ids``. The model at ``path`` is read on the driver."""
    model = broadcast_model(docs, path)
    others = [c for c in docs.columns if c not in (text, "n_tokens", "ids")]
    rows = docs.select(*others, F.col(text).cast("string").alias("_uv_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, len(others), PIECE):
            ids, at = model.value.encode(*bytes_of(b.column(len(others))))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(np.diff(at)), lists], names=[*others, "n_tokens", "ids"])

    fields = [*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids."""
    model = broadcast_model(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            data, at = model.value.decode(lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64))
            text = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Of every document: numbers and checksum of its ids, and the digest of what they decode to."""
    model = broadcast_model(docs, path)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        is_byte = np.zeros(len(m.raw), bool)
        is_byte[m.bytes_ids] = True
        for b in by_size(batches, 1, PIECE):
            data, offsets = bytes_of(b.column(1))
            ids, at = m.encode(data, offsets)
            back, ends = m.decode(ids, at)
            raw, text = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B"), back.tobytes()
            fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])
            pairs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            digests = [hashlib.sha256(text[s:e]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            same = np.array_equal(back, data) and np.array_equal(ends, offsets)
            exact = [same or text[s:e] == bytes(data[x:y]) for s, e, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [pa.array(np.diff(at)), pa.array(np.diff(fallback[at])), pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in pairs], pa.int64()), pa.array(digests), pa.array(exact, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_sha256", "exact"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, exact boolean")
