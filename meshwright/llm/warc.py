"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

Records have record_id, uri, ts, status and headers (a map of lower-case names). A record of
status 304 is a revisit; one of status 200 is a full response. Each revisit meets the latest
full response of its canonical URL that comes before it by (ts, record_id). Its validators are
then checked: entity tags by weak comparison if both have one, else Last-Modified, else the
payload digests. If they agree, the stored headers are updated by those of the revisit, but for
the fields that describe the stored body or one connection.

The join is one sort: records are dealt into ranges of (URL, ts, record_id), so a URL that holds
a third of all rows spans many ranges; inside a range a window carries the last full response
forward, and only URLs that cross ranges (at most one for each border) pass theirs on.

Cases: a null or empty URL, or a null time, leaves a revisit unresolved and makes a response no
candidate; null headers are empty; repeated rows are resolved each for itself; ties in time are
ordered by record_id, then by validators, and a response with time and record_id alike is not earlier;
responses are told apart by record_id (which may be null), URL, time and validators, and of those that
agree in all of them the one with the least headers counts; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.llm.common import Scratch, hot_join, settled

#: Header fields that a not-modified response may not update.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
EMPTY = "map<string,string>"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, a path of at least ``/``; null if empty."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.length(bare) > 0, F.concat(scheme, F.lit("://"), host, path))


def agreement(asked: Column, stored: Column) -> Column:
    """Which validator agrees, or ``mismatch`` or ``none``."""
    out = F.lit("none")
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    for name, same in (("digest", lambda a, b: a == b), ("last-modified", lambda a, b: a == b), ("etag", lambda a, b: weak(a) == weak(b))):
        a, b = asked[name.replace("-", "_")], stored[name.replace("-", "_")]
        out = F.when(a.isNotNull() & b.isNotNull(), F.when(same(a, b), F.lit(name)).otherwise(F.lit("mismatch"))).otherwise(out)
    return out


def as_of(thin: DataFrame, scratch: Scratch) -> DataFrame:
    """``thin`` (canon, ts, record_id, full, v, ...) with ``prior``: (record_id, ts, v) of the latest earlier full row of its URL."""
    parts = int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = thin.repartitionByRange(parts, "canon", "ts", "record_id", "full").withColumn("part", F.spark_partition_id())
    ranged = scratch.table(ranged, "ranged")
    own = F.when(F.col("full"), F.struct("record_id", "ts", "v"))
    near = F.last(own, ignorenulls=True).over(W.partitionBy("part", "canon").orderBy("ts", "record_id", "full", "v").rowsBetween(W.unboundedPreceding, -1))
    crossing = ranged.groupBy("canon").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("canon")
    ends = ranged.join(crossing, "canon", "left_semi").groupBy("canon", "part").agg(F.max_by(own, F.when(F.col("full"), F.struct("ts", "record_id", "v"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("canon").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # At most two rows for each border between ranges.
    carried = scratch.table(ends.withColumn("carried", before).where("carried IS NOT NULL").select("canon", "part", "carried"), "carried")
    return ranged.withColumn("near", near).join(F.broadcast(carried), ["canon", "part"], "left").withColumn("prior", F.coalesce("near", "carried")).drop("near", "carried", "part")


def resolve(records: DataFrame) -> DataFrame:
    """Of each revisit: record_id, canon, refers_to, check (etag, last-modified, digest, none, mismatch or
    no response), resolved, and the merged headers (its own if unresolved)."""
    headers = F.coalesce("headers", F.create_map().cast(EMPTY))
    base = records.select("record_id", canonical(F.col("uri")).alias("canon"), "ts", "status", headers.alias("headers"))
    of = lambda name: F.try_element_at("headers", F.lit(name))
    v = F.struct(of("etag").alias("etag"), of("last-modified").alias("last_modified"), of("warc-payload-digest").alias("digest"))
    whole = F.col("canon").isNotNull() & F.col("ts").isNotNull()
    # What tells responses apart, as one text, since nulls are values here.
    named_by = lambda i, canon, ts, v: F.to_json(F.struct(i.alias("i"), canon.alias("c"), ts.cast("string").alias("t"), v.alias("v")))
    with Scratch(records.sparkSession, "warc") as scratch:
        # Revisits carry their own headers, as a record_id may repeat or be null; those of responses stay behind.
        own = F.when(F.col("status") == 304, F.col("headers"))
        thin = base.where(whole & F.col("status").isin(200, 304)).select("canon", "ts", "record_id", (F.col("status") == 200).alias("full"), v.alias("v"), own.alias("headers"))
        asked = as_of(thin, scratch).where(~F.col("full"))
        check = F.when(F.col("prior").isNull(), F.lit("no response")).otherwise(agreement(F.col("v"), F.col("prior.v")))
        source = F.when(F.col("prior").isNotNull(), named_by(F.col("prior.record_id"), F.col("canon"), F.col("prior.ts"), F.col("prior.v")))
        rows = asked.select("record_id", "canon", F.col("prior.record_id").alias("refers_to"), source.alias("source"), check.alias("check"), "headers")
        rows = scratch.table(rows.withColumn("resolved", F.col("check").isin("etag", "last-modified", "digest")), "rows")
        stored = base.where("status = 200").groupBy(named_by(F.col("record_id"), F.col("canon"), F.col("ts"), v).alias("source"))
        stored = stored.agg(F.map_from_entries(F.min(F.array_sort(F.map_entries("headers")))).alias("stored"))
        counts = rows.where("resolved").groupBy("source").agg(F.count("*").alias("n"))
        named = scratch.table(counts.join(stored, "source"), "named")
        merged = F.map_zip_with("stored", "headers", lambda k, a, b: F.when(k.isin(*NOT_UPDATED), a).otherwise(F.coalesce(b, a)))
        merged = F.map_filter(merged, lambda k, x: x.isNotNull())
        keep = ["record_id", "canon", "refers_to", "check", "resolved", "headers"]
        done = hot_join(rows.where("resolved"), named, "source", "n").withColumn("headers", merged).select(*keep)
        lost = base.where((F.col("status") == 304) & ~whole).select("record_id", "canon", F.lit(None).cast(base.schema["record_id"].dataType).alias("refers_to"), F.lit("no response").alias("check"), F.lit(False).alias("resolved"), "headers")
        return settled(done.unionByName(rows.where(~F.col("resolved")).select(*keep)).unionByName(lost))


def captures_of(pages: DataFrame) -> DataFrame:
    """Two records for each page: its full response, and a revisit a little later (or, for some, before it).

    What validators a revisit brings follows from the length of the URL: the same tag, the weak form of
    it, the date only, another tag, or none."""
    kind = F.length("url") % 6
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    stamp = F.concat(F.lit("day "), F.floor(F.col("page_id") / 7).cast("string"))
    some = lambda *pairs: F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"), F.col("url").alias("uri"), (10 * F.col("page_id")).alias("ts"), F.lit(200).alias("status"),
        some(("etag", tag), ("last-modified", stamp), ("content-type", F.lit("text/html")), ("content-length", F.octet_length("html").cast("string")), ("cache-control", F.lit("max-age=60"))).alias("headers"),
    )
    sent = F.when(kind.isin(0, 5), tag).when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind == 3, F.lit('"other"'))
    revisit = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"),
        F.concat(F.upper(F.substring_index("url", "://", 1)), F.lit("://"), F.substring(F.col("url"), F.instr(F.col("url"), "://") + 3, F.length("url")), F.lit("#again")).alias("uri"),
        (10 * F.col("page_id") + F.when(kind == 5, -5).otherwise(5)).alias("ts"), F.lit(304).alias("status"),
        some(("etag", sent), ("last-modified", F.when(kind == 2, stamp)), ("content-length", F.lit("0")), ("cache-control", F.concat(F.lit("max-age="), F.col("page_id").cast("string")))).alias("headers"),
    )
    return full.unionByName(revisit)


def digest(resolved: DataFrame) -> DataFrame:
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return resolved.select("record_id", F.col("canon").alias("url"), "refers_to", "check", "resolved", F.array_join(lines, "; ").alias("headers"))
