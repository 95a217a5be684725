"""Results by plain means: components by comparing all pairs, repeats by a dictionary of all windows, benchmark hits by trying every word."""

from __future__ import annotations

import hashlib
import re

from meshwright.llm.suffix_index import MATCH


def brute_components(rows, size):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    sets, parent = {}, {}
    for d, t in rows:
        w = word.findall((t or "").encode().lower())
        sets.setdefault(d, []).append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
        parent[d] = d

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = [d for d in parent if d is not None]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def brute_repeats(docs):
    """The rows of op5."""
    first = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for s in range(len(b) - MATCH + 1) if d is not None else ():
            w = b[s : s + MATCH]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - MATCH + 1) if d is not None else ():
            if first[b[s : s + MATCH]] < d:
                gone[s : s + MATCH] = b"\x01" * MATCH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def brute_hits(text, items, size=13):
    """Words, hit words and sorted names of the items that occur in a text."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall((text or "").encode().lower())
    hit, names = set(), set()
    for item, other in items:
        own = word.findall((other or "").encode().lower())
        for k in range(max(1, len(own) - size + 1)) if own else ():
            w = own[k : k + size]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    names.update([item] if item is not None else [])
    return len(words), len(hit), sorted(names)


def items_sha256(names):
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
