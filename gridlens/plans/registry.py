"""Queries over the given tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Views that stand for meter tables; the same definitions as in ``fixtures``.
VIEWS = {
    "readings": """SELECT user_id AS rid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, ts, epoch_us(ts) AS ts_us,
        value AS p, (regexp_extract(props, '-?[0-9]+')::BIGINT - 50)::DOUBLE AS q, event_type, event_id FROM events""",
    "dirty": """SELECT *, CASE WHEN i % 9 = 4 OR i % 40 BETWEEN 20 AND 27 OR i % 40 < 2 THEN NULL WHEN event_id % 101 = 0 THEN 'Infinity'::DOUBLE
        WHEN event_id % 103 = 0 THEN 'NaN'::DOUBLE ELSE p END AS v FROM readings""",
    "gappy": "SELECT *, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS c FROM dirty",
    "phases": "SELECT *, 0.5 * p AS p1, 0.3 * p AS p2, 0.2 * p AS p3, 0.5 * q AS q1, 0.3 * q AS q2, 0.2 * q AS q3 FROM readings",
    "contributions": """SELECT l_orderkey AS scenario, l_partkey % 9 AS appliance, l_suppkey % 4 AS sample, l_extendedprice AS p, l_quantity AS q,
        l_linenumber % 4 AS phase FROM lineitem""",
    "predictions": """SELECT rid, i // 5 AS win, event_type AS family, p, least(1.0, p / 100) AS prob, (p > 50)::INT AS truth, (p + q > 50)::INT AS pred, q FROM readings""",
}


def sql_chance(seed: int, *keys: str) -> str:
    """``functions.draws.chance`` in DuckDB's SQL."""
    return f"(('0x' || md5(concat_ws('|', '{seed}', {', '.join(keys)}))[:12])::BIGINT / {1 << 48}::DOUBLE)"


def with_views(body: str) -> str:
    """``body`` after the views that it names, and those that these name."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, view in VIEWS.items():
            if name not in need and name in text.replace("(", " ").replace(")", " ").replace(",", " ").split():
                add(view)
                need.append(name)

    add(body)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = body.strip()
    if not views:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{views}, {body[len(start):]}"
    return f"WITH {views} {body}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql)
        return f

    return register
