"""Registry of the catalogue's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is checked by tests instead."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# Independent statements of the shared inputs, for the SQL engine that checks the results.
FOLD = r"nullif(regexp_replace(regexp_replace(lower({0}), '[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+', '', 'g'), '^iksww[-_]*([0-9])', 'iksww-\1'), '')"
TIDY = """t AS (SELECT sample_id, path, regexp_extract(path, '[^/]*$') AS name, source, category_id, label, """ + FOLD.format('"group"') + """ AS grp, kind,
 coalesce(nullif(lower(trim(split)), ''), lower(split_part(path, '/', 1))) AS split,
 CASE WHEN trim(coalesce(category, '')) = '' THEN 'clean' ELSE regexp_replace(lower(trim(category)), '[ -]', '_', 'g') END AS category,
 CASE WHEN trim(coalesce(form_factor, '')) = '' THEN 'unknown' WHEN lower(trim(form_factor)) LIKE 'unidentif%' THEN 'unidentified' ELSE lower(trim(form_factor)) END AS form_factor,
 coalesce(nullif(lower(trim(orientation)), ''), 'unknown') AS orientation,
 coalesce(lower(trim(is_competitor)) = 'true', false) AS is_competitor, coalesce(lower(trim(has_boundbox)) = 'true', false) AS has_boundbox
 FROM labels)"""
STEM = "regexp_replace({0}, '(.)\\.[^.]*$', '\\1')"
SUFFIX = "lower(regexp_extract({0}, '.(\\.[^.]*)$', 1))"
TICKET = "nullif(upper(replace(regexp_extract({0}, '(?i)(IKSWW[-_][0-9]+)', 1), '_', '-')), '')"
SCORED = """v AS (SELECT event_id AS id, user_id AS g, event_type AS cat, CAST(event_type IN ('error', 'purchase') AS INTEGER) AS y, value, ts,
 value / (value + CAST(60 AS DOUBLE)) AS s, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""
SWEEP = """c AS (SELECT s, CAST(sum(y) AS DOUBLE) AS p1, CAST(count(*) AS DOUBLE) AS n1 FROM v GROUP BY s),
w AS (SELECT s, p1, sum(p1) OVER (ORDER BY s DESC) AS tp, sum(n1) OVER (ORDER BY s DESC) AS np FROM c),
tt AS (SELECT CAST(sum(y) AS DOUBLE) AS P, CAST(count(*) - sum(y) AS DOUBLE) AS N FROM v)"""
