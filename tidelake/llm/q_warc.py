"""op10: revisits resolved among archive records that stand on the pages.

Each page gives a full response, unless its id leaves 3 divided by 7, and a
revisit three ticks later. Pages of odd id stand for their site's front page,
so one URL has as many records as its host has pages. Validators change every
fifty ticks; some revisits have a weak tag, only a date, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.registry import register, table
from tidelake.llm.warc import resolve_revisits


def _list(*pairs: tuple[str, Column]) -> Column:
    """Header list without the NULL values."""
    made = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs])
    return F.filter(made, lambda h: h["value"].isNotNull())


def archive_records(pages: DataFrame) -> DataFrame:
    page = F.col("page_id")
    front = F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), F.lit("/"))
    url = F.when(page % 2 == 1, front).otherwise(F.col("url"))
    version = lambda t: F.concat(F.lit('"v'), F.floor(t / 50), F.lit('"'))
    responses = pages.filter(page % 7 != 3).select(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), url.alias("url"), page.alias("time"),
        _list(("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length("html")), ("ETag", version(page)),
              ("Last-Modified", F.concat(F.lit("T"), F.floor(page / 50))), ("Date", page)).alias("headers"),
        F.col("html").alias("payload"),
    )
    tag = F.when(page % 5 < 3, version(page + 2)).when(page % 5 == 3, F.concat(F.lit("W/"), version(page + 2)))
    none = page % 11 == 0
    revisits = pages.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(url, F.lit("#again")).alias("url"), (page + 3).alias("time"),
        _list(("etag", F.when(~none, tag)), ("LAST-MODIFIED", F.when(~none & (page % 5 == 4), F.concat(F.lit("T"), F.floor((page + 2) / 50)))),
              ("Content-Length", F.lit(0)), ("Date", page + 3)).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return responses.unionByName(revisits)


def headers_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(headers, lambda h: F.concat(h["name"], F.lit("="), h["value"]))), "\n")


@register("op10_warc_revisits", sql=r"""
WITH base AS (
  SELECT page_id AS p, html, CASE WHEN page_id % 2 = 1 THEN regexp_extract(url, '^(https?://[^/]*)', 1) || '/' ELSE url END AS url FROM pages),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^(?i)https?://', '') AS rest FROM base),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query
  FROM keyed),
urls AS (SELECT p, html, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM parts),
responses AS (SELECT p AS rp, 2 * p AS response_id, html, url_key, p AS time, '"v' || (p // 50) || '"' AS tag, 'T' || (p // 50) AS modified FROM urls WHERE p % 7 <> 3),
revisits AS (
  SELECT p, 2 * p + 1 AS record_id, url_key, p + 3 AS time,
    CASE WHEN p % 11 = 0 OR p % 5 = 4 THEN NULL WHEN p % 5 = 3 THEN 'W/"v' || ((p + 2) // 50) || '"' ELSE '"v' || ((p + 2) // 50) || '"' END AS tag,
    CASE WHEN p % 11 <> 0 AND p % 5 = 4 THEN 'T' || ((p + 2) // 50) END AS modified FROM urls),
joined AS (
  SELECT v.*, r.response_id, r.html, r.rp, r.tag AS stored_tag, r.modified AS stored_modified
  FROM revisits v ASOF LEFT JOIN responses r ON v.url_key = r.url_key AND v.time > r.time),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN tag IS NULL AND modified IS NULL THEN 'no_validator'
    WHEN coalesce(CASE WHEN tag IS NOT NULL THEN replace(tag, 'W/', '') = stored_tag ELSE modified = stored_modified END, false) THEN 'resolved'
    ELSE 'changed' END AS status FROM joined)
SELECT record_id, url_key, time, status, CASE WHEN status = 'resolved' THEN response_id END AS response_id,
  array_to_string(list_sort(list_filter(CASE WHEN status = 'resolved' THEN
    ['content-length=' || strlen(html), 'content-type=text/html', 'date=' || time, 'etag=' || coalesce(tag, stored_tag), 'last-modified=' || coalesce(modified, stored_modified)]
    ELSE ['content-length=0', 'date=' || time, 'etag=' || tag, 'last-modified=' || modified] END, lambda x: x IS NOT NULL)), chr(10)) AS headers,
  CASE WHEN status = 'resolved' THEN sha256(html) END AS payload_sha256
FROM judged
""")
def op10_warc_revisits(spark: SparkSession, sf: str) -> DataFrame:
    resolved = resolve_revisits(archive_records(table(spark, sf, "pages")))
    return resolved.select(
        "record_id", "url_key", "time", "status", "response_id", headers_text(F.col("headers")).alias("headers"),
        F.sha2("payload", 256).alias("payload_sha256"),
    )
