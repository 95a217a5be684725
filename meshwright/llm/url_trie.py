"""URL filter: a trie over reversed host labels, then path segments.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the
rule's path. The rule at the deepest host node wins, and there the one with the longest path;
if both lists hold the same host and path, block wins.

Cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the
default verdict; hosts and paths are taken as they stand (ports, user names and dots at the end
belong to the host; only A-Z is lower-cased); repeated rules and rows do no harm, and a verdict
other than ``block`` allows; an empty rule list gives every URL the default; other columns are not read.

The trie is broadcast only up to ``max_rules`` rules of at most ``MAX_RULE_CHARS`` characters,
so its size has a bound; a larger list, or a longer rule, takes ``judge_by_join``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import Scratch, hot_join, settled

MAX_RULES = 1_000_000
MAX_RULE_CHARS = 200
DEFAULT = "allow"
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    clear = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.coalesce(F.substring_index(clear, "/", 1), F.lit(""))
    path = F.coalesce(F.substr(clear, F.length(host) + 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


class Node:
    """A host label; the paths of its rules, if it has any."""

    __slots__ = ("below", "paths")

    def __init__(self) -> None:
        self.below: dict[str, Node] | None = None
        self.paths: PathNode | None = None


class PathNode:
    """Whole segments lead to further nodes; the part after the last slash is a prefix of a segment. Those
    prefixes are found by their text, one look for each length that occurs (at most MAX_RULE_CHARS)."""

    __slots__ = ("below", "ends", "lengths")

    def __init__(self) -> None:
        self.below: dict[str, PathNode] | None = None
        self.ends: dict[str, bool] | None = None
        self.lengths: tuple[int, ...] = ()

    def put(self, rest: str, block: bool) -> None:
        if self.ends is None:
            self.ends = {}
        self.ends[rest] = block or self.ends.get(rest, False)
        if len(rest) not in self.lengths:
            self.lengths = tuple(sorted({*self.lengths, len(rest)}, reverse=True))


class Trie:
    """A rule's text is not stored: it is what the URL itself has on the way to its node."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = Node()
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                if node.below is None:
                    node.below = {}
                if label not in node.below:
                    node.below[label] = Node()
                node = node.below[label]
            if node.paths is None:
                node.paths = PathNode()
            at = node.paths
            *whole, rest = path.split("/")
            for segment in whole:
                if at.below is None:
                    at.below = {}
                if segment not in at.below:
                    at.below[segment] = PathNode()
                at = at.below[segment]
            at.put(rest, verdict == "block")

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match."""
        labels = host.split(".") if host else []
        node, found = self.root, []
        if node.paths:
            found.append((node.paths, 0))
        for depth, label in enumerate(reversed(labels), 1):
            node = node.below.get(label) if node.below else None
            if node is None:
                break
            if node.paths:
                found.append((node.paths, depth))
        if not found:
            return None
        parts = path.split("/")
        for top, depth in reversed(found):
            at, passed, best = top, 0, None
            for part in parts:
                for n in at.lengths:
                    if n <= len(part) and (block := at.ends.get(part[:n])) is not None:
                        best = (passed + n, block)
                        break
                at = at.below.get(part) if at.below else None
                if at is None:
                    break
                passed += len(part) + 1
            if best:
                suffix = ".".join(labels[len(labels) - depth :]) if depth else ""
                return suffix + path[: best[0]], "block" if best[1] else "allow"
        return None


def judge(urls: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = DEFAULT, max_rules: int = MAX_RULES) -> DataFrame:
    """(key, host, path, rule, verdict) for every row."""
    host, path = host_and_path(F.col(url).cast("string"))
    split = urls.select(F.col(key), host.alias("host"), path.alias("path"))
    if len(rules) > max_rules or any(len(h) + len(p) > MAX_RULE_CHARS for h, p, _ in rules):
        return judge_by_join(split, split.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), key, default)
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for f in frames:
            got = [find(h, p) or (None, default) for h, p in zip(f["host"], f["path"], strict=True)]
            yield f.assign(rule=pd.Series([g[0] for g in got], dtype=object, index=f.index), verdict=pd.Series([g[1] for g in got], dtype=object, index=f.index))

    kind = split.schema[key].dataType.simpleString()
    return split.mapInPandas(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def judge_by_join(split: DataFrame, rules: DataFrame, key: str, default: str) -> DataFrame:
    """The same for rule lists of any size, by equality joins only.

    A host meets those of its parents that have rules, and each URL the beginnings of its path
    whose length occurs there. So a URL makes at most (labels x lengths) keys however many rules a host
    has, and joins whose key may be hot (a host, ``com/``) go through ``hot_join``."""
    with Scratch(split.sparkSession, "url-rules") as scratch:
        verdict = F.max(F.when(F.col("verdict") == "block", "block").otherwise("allow")).alias("_verdict")
        # A rule whose host holds a slash fits no host.
        offered = rules.where(~F.contains("host", F.lit("/"))).groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(verdict)
        lengths = offered.groupBy("_h").agg(F.collect_set(F.length("_p")).alias("_n"))
        pairs = scratch.table(split.select("host", "path").distinct(), "pairs")
        hosts = pairs.groupBy("host").agg(F.count("*").alias("_w"))
        labels = F.split("host", r"\.")
        parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        asked = hosts.select("host", F.explode(F.array_distinct(F.array_append(parents, F.lit("")))).alias("_h"))
        weights = asked.groupBy("_h").agg(F.count("*").alias("_m"))
        near = hot_join(asked, scratch.table(weights.join(lengths, "_h"), "lengths"), "_h", "_m").groupBy("host").agg(F.collect_list(F.struct("_h", "_n")).alias("_near"))
        near = scratch.table(near.join(hosts, "host"), "near")
        beginnings = lambda x: F.transform(F.filter(x["_n"], lambda n: n <= F.length("path")), lambda n: F.struct(x["_h"].alias("h"), F.substr(F.col("path"), F.lit(1), n).alias("p")))
        met = hot_join(pairs, near, "host", "_w").select("host", "path", F.explode(F.flatten(F.transform("_near", beginnings))).alias("_c"))
        # A rule by one column, as a host has no slash: its host, a slash, its path.
        met = scratch.table(met.select("host", "path", F.concat_ws("/", "_c.h", "_c.p").alias("_k"), F.length("_c.h").alias("_a"), F.length("_c.p").alias("_b")), "met")
        counted = met.groupBy("_k").agg(F.count("*").alias("_w"))
        fitting = offered.select(F.concat_ws("/", "_h", "_p").alias("_k"), F.concat("_h", "_p").alias("rule"), "_verdict")
        fits = hot_join(met, scratch.table(counted.join(fitting, "_k"), "fitting"), "_k", "_w")
        best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", F.col("_verdict").alias("verdict")), F.struct("_a", "_b")).alias("_best"))
        whole = F.concat_ws("/", "host", "path").alias("_u")
        times = split.groupBy(whole).agg(F.count("*").alias("_w"))
        best = scratch.table(times.join(best.select(whole, "_best"), "_u"), "best")
        joined = hot_join(split.select(F.col(key), "host", "path", whole), best, "_u", "_w", "left")
        return settled(joined.select(key, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")))
