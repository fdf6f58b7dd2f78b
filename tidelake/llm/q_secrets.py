"""op2: secret scans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.registry import register, table
from tidelake.llm.secrets import BASE, KINDS, NEEDS, PATTERNS, find_secrets, spans_text


def _either_case(pattern: str) -> str:
    """The pattern with classes of both cases for its bare letters, as the checking engine also folds other letters."""
    if not pattern.startswith("(?i)"):
        return pattern
    parts = re.split(r"(\[[^\]]*\]|\\x20)", pattern[4:])
    plain = [p if i % 2 else re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", p) for i, p in enumerate(parts)]
    return "".join(p.replace("[a-z0-9]", "[A-Za-z0-9]") if i % 2 else p for i, p in enumerate(plain))


def _kind_sql(kind: str) -> str:
    pattern, group, least, holds = PATTERNS[kind]
    regex = "'" + _either_case(pattern).replace("'", "''") + "'"
    return f"""
  SELECT doc_id, {KINDS.index(kind)} AS kind, gap, own, n, i FROM (
    SELECT doc_id, unnest(string_split_regex(text, {regex})[1:len(m)]) AS gap, unnest(m) AS own, unnest(v) AS val, unnest(range(len(m))) AS i
    FROM (SELECT doc_id, text, regexp_extract_all(text, {regex}, 0) AS m, regexp_extract_all(text, {regex}, {group}) AS v
          FROM docs WHERE regexp_matches(text, {regex}))),
    LATERAL (SELECT CASE WHEN regexp_matches(val, '{holds}') THEN length(val) ELSE 0 END AS n)"""


_NEEDS_SQL = " OR ".join(
    f"(w.kind = {KINDS.index(k)} AND o.kind IN ({', '.join(str(KINDS.index(x)) for x in v)}))" for k, v in NEEDS.items()
)
_LEAST_SQL = "[" + ", ".join(str(PATTERNS[k][2]) for k in KINDS) + "]"
_NAMES_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"

SPANS_SQL = f"""docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_kind_sql(k) for k in KINDS)}),
placed AS (
  SELECT doc_id, kind, n, length(own) AS own, sum(length(gap) + length(own)) OVER along AS stop,
         sum(len(string_split(gap, chr(10) || chr(10))) - 1) OVER along AS scope
  FROM found WINDOW along AS (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING)),
parts AS (SELECT doc_id, kind, stop - own AS start, stop, scope FROM placed WHERE n >= {_LEAST_SQL}[kind + 1]),
weak AS (
  SELECT DISTINCT w.doc_id, w.kind, w.start, w.stop FROM parts w JOIN parts o
    ON w.doc_id = o.doc_id AND w.scope = o.scope AND w.kind >= {len(BASE)} AND ({_NEEDS_SQL})
    AND (o.stop <= w.start OR o.start >= w.stop)),
spans AS (
  SELECT doc_id, kind, start, stop FROM parts WHERE kind < {len(BASE)}
  UNION ALL SELECT * FROM weak w WHERE NOT EXISTS (
    SELECT 1 FROM parts o WHERE o.doc_id = w.doc_id AND o.kind < {len(BASE)} AND o.start < w.stop AND w.start < o.stop)),
lists AS (
  SELECT doc_id, string_agg({_NAMES_SQL}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind, stop) AS spans,
         string_agg({_NAMES_SQL}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind, stop) FILTER (kind < {len(BASE)}) AS base,
         {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(BASE))}
  FROM spans GROUP BY doc_id)"""


@register("op2_secret_scan", sql=f"""
WITH {SPANS_SQL}
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (doc_id)
""")
def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = find_secrets(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )
