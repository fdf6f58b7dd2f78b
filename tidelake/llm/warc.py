"""Resolution of not-modified revisits among web archive records.

A revisit (a stored 304 answer) holds no content. It is resolved by an as-of
join on the canonical URL to the latest full response captured strictly before
it, if the validators agree: entity tags compare weakly, and where the revisit
has no tag, Last-Modified must be equal. The resolved record has the payload of
the response and its headers, updated with those a 304 answer may change.

The as-of join forward-fills over the distinct (URL, time) points. These are
merged before the shuffle, and a URL with more points than the row budget of
``ordered.py`` is cut into buckets along time. Below that budget a URL's points
are one task.

Defined cases: a revisit with a null URL or time, or without an earlier
response, is ``no_response``; without any validator ``no_validator``; with a
different one ``changed``; these keep their own headers and have no payload. Of
responses with the same URL and time the one with the largest record_id counts;
of rows that repeat this response, the one with the least headers and then the
least payload. Null header lists are empty; null header names are dropped;
repeated revisits are resolved one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.scratch import written
from tidelake.operators.ordered import forward_fill
from tidelake.session import materialize

#: Headers that a 304 answer may renew in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment and final slash; query sorted, without ``utm_`` fields."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)https?://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _headers(headers: Column) -> Column:
    """Header list with lower-case names."""
    named = F.filter(F.coalesce(headers, F.array()), lambda h: h["name"].isNotNull())
    return F.transform(named, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))


def header(headers: Column, name: str) -> Column:
    """First value of a header, NULL if there is none."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def merged_headers(stored: Column, renewed: Column) -> Column:
    """Stored headers, in which the permitted ones of the 304 answer replace those of the same name."""
    new = F.filter(renewed, lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(new, lambda h: h["name"])
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), new)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit.

    ``records``: record_id bigint, kind ('response' or 'revisit'), url, time
    bigint, headers array<struct<name,value>>, payload. Returns record_id,
    url_key, time, status, response_id, headers, payload.
    """
    rows = records.select(
        "record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "time", _headers(F.col("headers")).alias("headers"), "payload"
    )
    known = F.col("url_key").isNotNull() & F.col("time").isNotNull()
    responses, revisits = rows.filter("kind = 'response'").filter(known), rows.filter("kind = 'revisit'")
    # at one time a revisit comes before a response: only earlier responses count
    full = responses.groupBy("url_key", "time").agg(F.max("record_id").cast("string").alias("found"))
    full = full.withColumn("found_time", F.when(F.col("found").isNotNull(), F.col("time").cast("string")))
    none = F.lit(None).cast("string")
    asked = revisits.filter(known).groupBy("url_key", "time").agg(none.alias("found"), none.alias("found_time"))
    points = full.withColumn("at", F.col("time") * 2 + 1).union(asked.withColumn("at", F.col("time") * 2))
    filled = forward_fill(materialize(points.drop("time"), "points"), ["url_key"], "at", ["found", "found_time"])
    found = filled.filter((F.col("at") % 2 == 0) & F.col("found").isNotNull()).select(
        "url_key", (F.col("at") / 2).cast("bigint").alias("time"), F.col("found").cast("bigint").alias("response_id"),
        F.col("found_time").cast("bigint").alias("response_time"),
    )
    linked = revisits.drop("kind", "payload").join(found, ["url_key", "time"], "left")
    # a response is one row, however often it is listed; written, as Spark splits no join whose side is an aggregate
    once = responses.groupBy(F.col("record_id").alias("response_id"), "url_key", F.col("time").alias("response_time")).agg(
        F.min(F.struct(F.col("headers").alias("stored"), F.col("payload").alias("stored_payload"))).alias("least")
    )
    stored = written(once.select("response_id", "url_key", "response_time", "least.*"), "responses")
    both = linked.join(stored, ["response_id", "url_key", "response_time"], "left")
    own_tag, own_date = header(F.col("headers"), "etag"), header(F.col("headers"), "last-modified")
    tag, date = header(F.col("stored"), "etag"), header(F.col("stored"), "last-modified")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    agree = F.when(own_tag.isNotNull(), weak(own_tag) == weak(tag)).otherwise(own_date == date)
    status = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(own_tag.isNull() & own_date.isNull(), "no_validator")
        .when(F.coalesce(agree, F.lit(False)), "resolved")
        .otherwise("changed")
    )
    done = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id", "url_key", "time", "status", F.when(done, F.col("response_id")).alias("response_id"),
        F.when(done, merged_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("stored_payload")).alias("payload"),
    )
