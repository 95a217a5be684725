"""Secret scan, with DataFrame functions only.

Base kinds are found by pattern (assign, access, hex). The method adds spans of kind
``entropy``: over each candidate string a window slides, and its Shannon entropy follows from
the counts of the one character that leaves and the one that enters. A candidate whose highest
window entropy reaches the limit of its character class is a span, unless the allow-list
(placeholders, UUIDs, runs of the alphabet) knows it. The allow-list never drops base spans.

Cases: null and empty texts have no spans; positions are code points of the whole text; equal
rows give equal results, each for itself; a text without matches is only searched; columns
other than ``doc_id`` and ``text`` pass through ``redact`` and are not read by ``scan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.line_clean import bound

#: The base patterns, least lengths and the entropy rules.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12
#: Maximal runs; the look behind keeps the search from trying every place of a word. Only runs with a digit count.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
WINDOW = 24
#: Codes of the characters of a candidate: ``+`` is the first, ``z`` the last one.
FIRST_CODE, CODES = 43, 80
#: A window's counts are one byte for each code, from this byte on; c*log2(c) is held in units of 1/SCALE, so sums are exact.
ZERO, SCALE = 65, 2.0**44
#: Bits per character that the densest window must reach, by the candidate's characters.
MIN_ENTROPY = {"hex": 3.0, "alnum": 3.75, "base64": 3.9}
ALLOWED = r"(?i)(example|placeholder|changeme|your[_-]|xxxx|abcdefgh|01234567|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
KINDS = ("assign", "access", "hex", "entropy")
BLOCK = 128
#: Characters of a text that are cut out together when secrets are replaced.
CHUNK = 1024


def running(values: Column, join, zero: Column) -> Column:
    """Exclusive prefix values of an array under ``join`` (a sum, a maximum), from ``zero`` on. Blocks keep the
    cost near linear for very many values."""
    none = F.array().cast("array<int>")

    def inside(block: Column) -> Column:
        return F.aggregate(
            block, F.struct(zero.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        )

    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: inside(F.slice(x, b * BLOCK + 1, BLOCK)))
    starts = lambda b: F.zip_with(b, inside(F.transform(b, lambda x: x["at"]))["out"], lambda x, o: F.transform(x["out"], lambda v: join(v, o)))
    return F.when(F.size(values) == 0, none).otherwise(bound(values, lambda x: F.flatten(bound(blocks(x), starts))))


def found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the matches of a pattern that never matches nothing: what stands between
    two matches and the matches themselves give every position in two passes over the text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def spans(both: Column) -> Column:
        steps = F.zip_with(F.slice(both["g"], 1, F.size(both["m"])), both["m"], lambda g, m: F.length(g) + F.length(m))
        begun = F.zip_with(running(steps, lambda a, b: a + b, F.lit(0)), F.slice(both["g"], 1, F.size(both["m"])), lambda at, g: at + F.length(g))
        return F.zip_with(begun, both["m"], lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.when(text.rlike(pattern), bound(F.struct(gaps.alias("g"), hits.alias("m")), spans)).otherwise(none)


def top_entropy(token: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window of a token of candidate characters, rounded to ten digits.

    The state is the window's counts, one byte for each character, and the sum of c*log2(c) over
    them. A step changes two counts only, of the character that leaves and of the one that
    enters, so the cost is linear in the token's length.
    """
    clog = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]
    rise = F.array(*(F.lit(clog[c + 1] - clog[c]) for c in range(window)))
    place = lambda raw, i: F.ascii(F.substring(raw, i, F.lit(1)).cast("string")) - (FIRST_CODE - 1)
    count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1)).cast("string")) - ZERO
    put = lambda counts, at, c: F.overlay(counts, F.char(c + ZERO).cast("binary"), at, F.lit(1))

    def enter(acc: Column, at: Column) -> Column:
        return bound(F.struct(at.alias("at"), count(acc["counts"], at).alias("c")), lambda x: F.struct((acc["s"] + F.get(rise, x["c"])).alias("s"), put(acc["counts"], x["at"], x["c"] + 1).alias("counts")))

    def leave(acc: Column, at: Column) -> Column:
        return bound(F.struct(at.alias("at"), count(acc["counts"], at).alias("c")), lambda x: F.struct((acc["s"] - F.get(rise, x["c"] - 1)).alias("s"), put(acc["counts"], x["at"], x["c"] - 1).alias("counts")))

    def of(raw: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("s"), F.lit(chr(ZERO) * CODES).cast("binary").alias("counts"))
        first = F.aggregate(F.sequence(F.lit(1), F.lit(window)), none, lambda acc, i: enter(acc, place(raw, i)))
        steps = F.when(F.length(raw) > window, F.sequence(F.lit(1), F.length(raw) - window)).otherwise(F.array().cast("array<int>"))

        def step(acc: Column, i: Column) -> Column:
            moved = bound(leave(acc, place(raw, i)), lambda a: enter(a, place(raw, i + window)))
            return bound(moved, lambda a: F.struct(a["s"].alias("s"), a["counts"].alias("counts"), F.least(acc["least"], a["s"]).alias("least")))

        begun = lambda a: F.struct(a["s"].alias("s"), a["counts"].alias("counts"), a["s"].alias("least"))
        return bound(first, lambda a: F.aggregate(steps, begun(a), step, lambda acc: acc["least"]))

    return F.round(F.lit(math.log2(window)) - bound(token.cast("binary"), of) / (SCALE * window), 10)


def is_secret(token: Column) -> Column:
    limit = F.when(token.rlike("^[0-9a-fA-F-]+$"), MIN_ENTROPY["hex"]).when(token.rlike("^[A-Za-z0-9]+$"), MIN_ENTROPY["alnum"]).otherwise(MIN_ENTROPY["base64"])
    return token.rlike("[0-9]") & ~token.rlike(ALLOWED) & (top_entropy(token) >= limit)


def spans_of(text: Column) -> Column:
    """array<struct<start, kind (number), end>> of all spans, sorted."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1))
    parts = (
        F.filter(found(text, ASSIGN), lambda x: value(x["m"]) >= MIN_ASSIGN),
        found(text, ACCESS),
        found(text, HEX),
        F.filter(found(text, CANDIDATE), lambda x: is_secret(x["m"])),
    )
    as_span = lambda k: lambda x: F.struct(x["s"].alias("start"), F.lit(k).alias("kind"), x["e"].alias("end"))
    return F.sort_array(F.concat(*(F.transform(p, as_span(k)) for k, p in enumerate(parts))))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its sorted spans."""
    return docs.select("doc_id", spans_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("spans"))


def digest(found_spans: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found_spans.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each maximal run of overlapping spans replaced by ``mark``; ``n_chars``, if there is one, follows the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def merged(spans: Column) -> Column:
        """Runs of overlapping or touching spans, in one pass: a run begins where a span starts behind all ends before it."""

        def runs(x: Column) -> Column:
            marked = F.zip_with(x["spans"], x["before"], lambda a, b: F.struct(a["start"].alias("s"), b.alias("before")))
            return bound(F.filter(marked, lambda m: m["s"] > m["before"]), lambda m: F.zip_with(m, F.slice(m, 2, F.size(m)), lambda a, b: F.struct(a["s"].alias("s"), F.coalesce(b["before"], x["last"]).alias("e"))))

        ends = F.transform(spans, lambda a: a["end"])
        return bound(F.struct(spans.alias("spans"), running(ends, F.greatest, F.lit(-1)).alias("before"), F.array_max(ends).alias("last")), runs)

    def piece(chunks: Column, begin: Column, end: Column) -> Column:
        """The text between two places; only the chunks that hold it are walked through."""
        first = F.floor(begin / CHUNK).cast("int")
        some = F.slice(chunks, first + 1, F.when(end > begin, F.floor((end - 1) / CHUNK).cast("int") - first + 1).otherwise(F.lit(0)))
        low = lambda k: F.greatest(begin - (first + k) * CHUNK, F.lit(0))
        return F.array_join(F.transform(some, lambda c, k: F.substr(c, low(k) + 1, end - (first + k) * CHUNK - low(k))), "")

    def cut(runs: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["e"]))
        ends = F.concat(F.transform(runs, lambda r: r["s"]), F.array(F.length(text)))
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        return bound(chunks, lambda c: F.array_join(F.zip_with(begins, ends, lambda b, e: piece(c, b, e)), mark))

    new = docs.withColumn("_sc_spans", spans_of(text))
    new = new.withColumn("_sc_text", F.when(F.size("_sc_spans") == 0, F.col("text")).otherwise(bound(merged(F.col("_sc_spans")), cut)))
    put = {"text": F.col("_sc_text")} | ({"n_chars": F.when(F.size("_sc_spans") == 0, F.col("n_chars")).otherwise(F.length("_sc_text").cast("long"))} if "n_chars" in docs.columns else {})
    return new.withColumns(put).select(*docs.columns)
