"""Resolution of not-modified WARC revisits by an as-of join on canonical URL.

A revisit takes the latest strictly earlier full response of its URL.  If a
validator (ETag, or Last-Modified where no ETag is given on both sides)
disagrees the revisit stays unresolved; where no validator is given on both
sides there is nothing to check, and it is resolved as ``unvalidated``.  Resolved
either way, its headers are merged over the stored ones where HTTP permits it.

The as-of search is a range-frame window per URL and block of time, followed by
a window over one row per block, so a URL with a third of all records is spread
over ``blocks`` tasks and its records are never in one.

Null URLs resolve to nothing; of responses with the same time the largest
record id holds; null times sort before all; repeated records count each;
empty input gives an empty result; extra columns are ignored.  Header names are
compared in lower case, and values of a field that comes several times under
names of different case are joined by a comma in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields a 304 response may update (RFC 9111 section 3.2 and RFC 9110 section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning")

#: Query parameters that tell where a visitor came from and never which resource is meant.
TRACKING = r"^(?i:utm_[a-z_]+|gclid|fbclid|msclkid|dclid|mc_cid|mc_eid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, www. and default port; path as written without final slash; of the query the sorted parameters, as written, but for those that only track; no fragment."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    page = F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(page, r"^([^/]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(page, r"^[^/]*(.*)$", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """The map with names in lower case; of names that then are equal, the values joined by a comma."""
    held = F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    lower = F.transform(F.map_keys(held), lambda k: F.lower(k))
    entries, names = F.array_sort(F.map_entries(held)), F.array_sort(F.array_distinct(lower))
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), ", "))
    return F.when(F.size(names) == F.size(lower), F.map_from_arrays(lower, F.map_values(held))).otherwise(F.map_from_arrays(names, values))


def resolve_revisits(records: DataFrame, blocks: int = 64) -> DataFrame:
    """records (record_id, url, ts long, kind, etag, last_modified, headers map, digest, length) to revisits.

    ``kind`` is ``response`` or ``revisit``.  Result: record_id, url_key, ts, outcome (``resolved``, ``unvalidated``,
    ``no_response`` or ``validator_mismatch``), response_id, response_ts, digest, length, headers.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.coalesce("ts", F.lit(-(2**62))).alias("t"), "ts", "kind", "etag", "last_modified", lower_names(F.col("headers")).alias("headers"), "digest", "length")
    span = r.where("ts is not null").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    width = max(1, -(-((span.hi or 0) - (span.lo or 0) + 1) // blocks)) if span.lo is not None else 1
    r = r.withColumn("block", F.floor((F.col("t") - F.lit(span.lo or 0)) / F.lit(width)).cast("long"))
    full = F.when(F.col("kind") == "response", F.struct("t", "record_id", "etag", "last_modified", "digest", "length", F.to_json("headers").alias("h")))
    # partitions by URL and block; a null URL has no partner and is dealt by record
    at = [F.coalesce("url_key", F.concat(F.lit("\x00"), F.col("record_id").cast("string"))), F.col("block")]
    near = r.withColumn("inside", F.max(full).over(Window.partitionBy(*at).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)))
    last = r.where("kind = 'response' and url_key is not null").groupBy("url_key", "block").agg(F.max(full).alias("own"))
    steps = near.where("kind = 'revisit' and inside is null and url_key is not null").select("url_key", "block").distinct()
    every = last.unionByName(steps.join(last, ["url_key", "block"], "left_anti").withColumn("own", F.lit(None).cast(last.schema["own"].dataType)))
    earlier = every.select(F.col("url_key").alias("_u"), F.col("block").alias("_b"), F.last("own", True).over(Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    v = near.where("kind = 'revisit'").join(earlier, (F.col("url_key") == F.col("_u")) & (F.col("block") == F.col("_b")), "left").withColumn("resp", F.coalesce("inside", "before"))
    both_tags = F.col("etag").isNotNull() & F.col("resp.etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("resp.last_modified").isNotNull()
    agrees = F.when(both_tags, F.regexp_replace("etag", "^W/", "") == F.regexp_replace("resp.etag", "^W/", "")).when(both_dates, F.col("last_modified") == F.col("resp.last_modified"))
    outcome = F.when(F.col("resp").isNull() | F.col("url_key").isNull(), "no_response").when(agrees.isNull(), "unvalidated").when(~agrees, "validator_mismatch").otherwise("resolved")
    v = v.withColumn("outcome", outcome)
    ok = F.col("outcome").isin("resolved", "unvalidated")
    stored = F.from_json("resp.h", "map<string,string>")
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    return v.select(
        "record_id", "url_key", "ts", "outcome", F.when(ok, F.col("resp.record_id")).alias("response_id"), F.when(ok, F.col("resp.t")).alias("response_ts"),
        F.when(ok, F.col("resp.digest")).alias("digest"), F.when(ok, F.col("resp.length")).alias("length"), F.when(ok, merged).alias("headers"),
    )
