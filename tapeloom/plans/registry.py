"""Queries over the derived tables, each with its oracle in DuckDB SQL.

An oracle names derived tables in braces-free form; with_tables() puts the definitions before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _bars(symbol: str, unit: str) -> str:
    key = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
    price = "l_extendedprice / l_quantity"
    return f"""SELECT {symbol} AS symbol, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS ts, arg_min({price}, {key}) AS open, max({price}) AS high,
        min({price}) AS low, arg_max({price}, {key}) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"""


#: DuckDB definitions of the tables in sources/adapters.py.
TABLES = {
    "bars_d": _bars("p_type", "day"),
    "bars_w": _bars("p_brand", "week"),
    "bars_h": """SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
    "bench_w": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, avg(l_extendedprice / l_quantity) AS bench FROM lineitem GROUP BY 1",
    "bench_d": "SELECT CAST(date_trunc('day', l_shipdate) AS DATE) AS ts, avg(l_extendedprice / l_quantity) AS bench FROM lineitem GROUP BY 1",
    "fund_q": """SELECT symbol, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, CAST(q + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS known_date, revenue,
        revenue * (0.05 + 0.002 * k) AS net_income, revenue * (0.08 + 0.002 * k) AS operating_income, revenue * (0.04 + 0.001 * k) AS free_cash_flow,
        revenue * (2.0 + 0.01 * k) AS total_assets, revenue * (0.9 + 0.01 * k) AS total_equity, revenue * (0.5 + 0.02 * k) AS total_debt,
        revenue * (0.35 + 0.004 * k) AS gross_profit, 1000.0::DOUBLE + k AS shares_out
        FROM (SELECT 'Brand#' || (c_nationkey + 1) AS symbol, c_nationkey::DOUBLE AS k, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, sum(o_totalprice) AS revenue
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""",
    "members": """SELECT symbol, CAST(lo + to_days(28 * k) AS DATE) AS start_date, CASE WHEN k % 2 = 1 THEN CAST(hi - INTERVAL 364 DAY AS DATE) END AS end_date
        FROM (SELECT DISTINCT symbol, CAST(substr(symbol, 7) AS INT) - 1 AS k FROM bars_w), (SELECT min(ts) AS lo, max(ts) AS hi FROM bars_w)""",
    "macro": """SELECT series_id, asof_date, asof_date AS release_date, 0 AS revision_n, value FROM macro_d UNION ALL
        SELECT series_id, asof_date, CAST(asof_date + INTERVAL 3 DAY AS DATE), 1, value * 1.01 FROM macro_d WHERE dayofyear(asof_date) % 7 = 0""",
    "macro_d": "SELECT event_type AS series_id, CAST(ts AS DATE) AS asof_date, avg(value) AS value FROM events GROUP BY 1, 2",
    "flows": """SELECT event_id, 'U' || user_id AS symbol, CAST(ts AS DATE) AS ts, event_type AS investor, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS net_value,
        CASE WHEN event_id % 5 = 0 THEN 'estimate' ELSE 'reported_value' END AS value_kind, CASE WHEN event_id % 10 = 5 THEN 'low' ELSE 'high' END AS confidence,
        CASE WHEN event_id % 3 > 0 THEN CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS DATE) END AS release_date FROM events""",
    "book": """SELECT symbol, ts, close, [{'price': close * (1 - 0.001 * i), 'size': volume * i + (hour(ts) * 7 + i * 5) % 11} FOR i IN range(1, 11)] AS bids,
        [{'price': close * (1 + 0.001 * i), 'size': volume * i + (hour(ts) * 7 + i * 3) % 11} FOR i IN range(1, 11)] AS asks FROM bars_h""",
}
NEEDS = {"members": ["bars_w"], "macro": ["macro_d"], "book": ["bars_h"]}


def _no_negative_zero(sql: str) -> str:
    """sql with ``+ 0.0`` behind every round(): a rounded -0.0 compares as 0.0 everywhere."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(f"{sql[at : m.start()]}(round({_no_negative_zero(sql[m.end() : end - 1])}) + 0.0)")
        at = end
    return "".join(out) + sql[at:]


def with_tables(sql: str) -> str:
    """sql, with the definitions of the derived tables it names before it."""
    sql = _no_negative_zero(sql)
    named = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    order: list[str] = []
    for t in named:
        order += [x for x in [*NEEDS.get(t, []), t] if x not in order]
    ctes = ", ".join(f"{t} AS ({TABLES[t]})" for t in order)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def query(oracle: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its oracle."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = with_tables(oracle)
        return f

    return add
