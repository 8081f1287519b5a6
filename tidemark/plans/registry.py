"""How queries and their oracles are registered.

Oracles name the shared table expressions that they use; `sql()` prefixes those, in dependency order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import SUBJECTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_SUBJECTS = "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in SUBJECTS) + "]"

#: Shared table expressions of the oracles; each may use those above it.
TABLES = {
    "bars": """SELECT symbol, trade_date, arg_min(u, k) AS open, max(u) AS high, min(u) AS low, arg_max(u, k) AS close,
        sum(q) AS volume, sum(p) AS traded_value, count(*) AS trades FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
        l_extendedprice / l_quantity AS u, l_quantity AS q, l_extendedprice AS p, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey} AS k FROM lineitem) GROUP BY symbol, trade_date""",
    "sessions": "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM (SELECT DISTINCT trade_date FROM bars)",
    "weekly": "SELECT max(trade_date) AS trade_date FROM sessions GROUP BY date_trunc('week', trade_date)",
    "rets": "SELECT *, lag(close) OVER w AS prev_close, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)",
    "market": "SELECT trade_date, avg(ret) AS mret FROM rets WHERE ret IS NOT NULL GROUP BY trade_date",
    "universe": """SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY trade_date, eligible ORDER BY mtv DESC, symbol) END AS liquidity_rank FROM (
        SELECT symbol, trade_date, close, traded_value, mtv, listed_days, coalesce(mtv >= 20000 AND listed_days >= 126 AND close >= 1, false) AS eligible FROM (
        SELECT symbol, trade_date, close, traded_value, CASE WHEN count(*) OVER w63 = 63 THEN quantile_cont(traded_value, 0.5) OVER w63 END AS mtv,
        row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS listed_days FROM bars
        WINDOW w63 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)))""",
    "momentum": """SELECT * FROM (SELECT symbol, trade_date, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS score FROM bars
        WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) WHERE score IS NOT NULL""",
    "strategy": """SELECT trade_date, avg(ret) AS r FROM (SELECT r.*, m.score, row_number() OVER (PARTITION BY r.trade_date ORDER BY m.score DESC, r.symbol) AS n
        FROM rets r JOIN momentum m USING (symbol, trade_date) WHERE r.ret IS NOT NULL) WHERE n <= 5 GROUP BY trade_date""",
    "announcements": f"SELECT event_id, user_id % 40 AS symbol, ts AS announced_at, ({_SUBJECTS})[CAST(event_id % {len(SUBJECTS)} AS INTEGER) + 1] AS subject FROM events",
    "order_symbols": "SELECT *, o_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS symbol FROM orders",
    "order_announcements": f"""SELECT o_orderkey AS event_id, symbol, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER)) AS announced_at,
        ({_SUBJECTS})[CAST(o_orderkey % {len(SUBJECTS)} AS INTEGER) + 1] AS subject FROM order_symbols""",
}


def sql(body: str) -> str:
    """The body with the shared table expressions that it uses, directly or through each other."""
    used: list[str] = []

    def add(text: str) -> None:
        for name in TABLES:
            if name not in used and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(TABLES[name])
                if name not in used:
                    used.append(name)

    add(body)
    heads = [f"{n} AS MATERIALIZED ({TABLES[n]})" for n in used]  # each is computed once, however often it is named
    body = body.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body):
        return "WITH RECURSIVE " + ", ".join([*heads, body[len("WITH RECURSIVE") :].strip()])
    if body.startswith("WITH "):
        return "WITH " + ", ".join([*heads, body[5:]])
    return ("WITH " + ", ".join(heads) + " " if heads else "") + body


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLE_SQL[key] = sql(oracle)
        return f

    return register
