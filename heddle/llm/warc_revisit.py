"""WARC revisit records (304 Not Modified) resolved to the response they confirm.

A revisit belongs to the latest full response of the same canonical URL (of the one it refers to, where it names one)
that is strictly earlier (of equal times the greatest record_id). The two validators must agree: entity tags where both
have one (compared weakly), else times of last modification where both have one (as times, where both are HTTP dates);
with neither in common the match is ``unchecked``. A revisit of the profile for identical payload digests is checked by
the digests. The resolved headers are the response's, with those a 304 may update taken from the revisit.

The as-of join runs over distinct pairs of URL and time, sorted into ranges of equal numbers of them whatever their
spread: inside of a range by a window, across ranges by the last response of each URL and range. So a URL with a third of
all records, or all of them at one time, is not one task. Revisits then meet their response by its id and a share of
their own id; a response is repeated only for the shares that ask for it, so neither a response that very many revisits
confirm nor the many unresolved ones are one task. Null URLs or times, and revisits before any response, are
``unresolved``. Repeated rows are resolved alike; of responses that repeat a record_id one counts. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .warc_records import SAME_DIGEST

#: Headers that a 304 response may update (RFC 9110, 15.4.5, and 9111, 3.2): fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Shares into which the revisits of one response, and those of none, are dealt when they meet their response.
SHARES = 256


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no tracking parameters, no slash at the end."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"([?&])&+", "$1"), r"[?&]+$", "")
    return F.concat(head, F.regexp_replace(rest, r"/$", ""))


def latest_earlier(records: DataFrame) -> DataFrame:
    """curl, ts, response_id and response_ts of each pair of URL and time: the latest response strictly before it, if any.

    ``records``: curl and ts (not null), record_id and is_response.
    """
    own = F.max(F.when(F.col("is_response"), F.struct("ts", "record_id")))
    points = records.groupBy("curl", "ts").agg(own.alias("own")).repartitionByRange("curl", "ts").withColumn("part", F.spark_partition_id())
    points = materialize(points)  # so that the ranges are those of one sample
    inside = F.max("own").over(Window.partitionBy("part", "curl").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    ends = points.groupBy("part", "curl").agg(F.max("own").alias("last"))
    ends = ends.withColumn("carried", F.max("last").over(Window.partitionBy("curl").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).filter("carried IS NOT NULL")
    found = points.withColumn("inside", inside).join(ends, ["part", "curl"], "left").withColumn("r", F.coalesce("inside", "carried"))
    return found.select("curl", "ts", F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"))


def same_time(a: Column, b: Column) -> Column:
    """Whether two HTTP dates name one time; texts that are none are compared as they are."""
    time = lambda c: F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return F.coalesce(time(a) == time(b), a == b)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, ts, response_id, response_ts, status and headers.

    ``records``: record_id, url, ts (long), kind (``response`` or ``revisit``), etag, last_modified, headers
    (map of lower-case names); optionally profile, payload_digest and refers_to_uri. Status is confirmed, unchecked,
    changed (a validator differs; the headers stay the revisit's) or unresolved.
    """
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    kept = [F.col(c) for c in ("record_id", "ts", "kind", "etag", "last_modified", "headers")]
    base = records.select(*kept, canonical(F.col("url")).alias("url"), canonical(has("refers_to_uri")).alias("refers"), has("profile").alias("profile"), has("payload_digest").alias("digest"))
    base = base.withColumns({"is_response": F.col("kind") == "response"}).filter("kind IN ('response', 'revisit')")
    base = base.withColumn("curl", F.when(F.col("is_response"), F.col("url")).otherwise(F.coalesce("refers", "url")))
    known = F.col("curl").isNotNull() & F.col("ts").isNotNull()
    at = latest_earlier(base.filter(known).select("record_id", "curl", "ts", "is_response"))
    share = F.pmod(F.xxhash64("record_id"), F.lit(SHARES))
    visits = base.filter(~F.col("is_response")).withColumn("share", share)
    none = at.schema
    lost = visits.filter(~known).select("*", *(F.lit(None).cast(none[c].dataType).alias(c) for c in ("response_id", "response_ts")))
    visits = visits.filter(known).join(at, ["curl", "ts"], "left").select(*visits.columns, "response_id", "response_ts").unionByName(lost)
    asked = visits.filter("response_id IS NOT NULL").select("response_id", "share").distinct()
    full = base.filter("is_response").dropDuplicates(["record_id"]).select(F.col("record_id").alias("response_id"), *(F.col(c).alias(f"r_{c}") for c in ("etag", "last_modified", "headers", "digest")))
    full = full.join(asked, "response_id")
    strong = lambda c: F.regexp_replace(c, r"^W/", "")
    by_validator = F.coalesce(strong(F.col("etag")) == strong(F.col("r_etag")), same_time(F.col("last_modified"), F.col("r_last_modified")))
    same = F.when(F.col("profile") == SAME_DIGEST, F.col("digest") == F.col("r_digest")).otherwise(by_validator)
    status = F.when(F.col("response_id").isNull(), "unresolved").when(same.isNull(), "unchecked").when(same, "confirmed").otherwise("changed")
    none = F.create_map().cast("map<string,string>")
    own, theirs = F.coalesce("headers", none), F.coalesce("r_headers", none)
    update = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k)), update)
    out = visits.join(full, ["response_id", "share"], "left").withColumn("status", status)
    return out.select("record_id", F.col("url").alias("canonical_url"), "ts", "response_id", "response_ts", "status", F.when(F.col("status").isin("confirmed", "unchecked"), merged).otherwise(own).alias("headers"))
