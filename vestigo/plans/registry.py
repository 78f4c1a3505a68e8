"""Registered queries: a Spark callable and, where SQL can say it, the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(expr: str, places: int) -> str:
    """SQL twin of functions.numbers.rnd."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,12)), {places}) AS DOUBLE)"


def xsum(expr: str) -> str:
    """SQL twin of functions.numbers.exact_sum."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(28,12))) AS DOUBLE)"


_BLOCK = """list_max(flatten(list_transform(range(1, length({x})+1), lambda i: flatten(list_transform(range(1, length({y})+1), lambda j:
  list_transform(list_filter(range(1, least(length({x})-i, length({y})-j)+2), lambda k: substr({x},i,k)=substr({y},j,k)), lambda k: {{'k': k, 'i': -i, 'j': -j}}))))))"""


def matching_sql(pairs: str) -> str:
    """SQL twin of functions.text.matching_characters: CTEs ending in matching(a, b, matched) over a query of pairs (a, b)."""
    return f"""pairs AS ({pairs}), seg AS (SELECT a, b, a AS x, b AS y, {_BLOCK.format(x='a', y='b')} AS m FROM pairs
    UNION ALL SELECT a, b, x, y, {_BLOCK.format(x='x', y='y')} AS m FROM (SELECT a, b,
        unnest([substr(x, 1, (-m.i-1)::BIGINT), substr(x, (-m.i+m.k)::BIGINT)]) AS x, unnest([substr(y, 1, (-m.j-1)::BIGINT), substr(y, (-m.j+m.k)::BIGINT)]) AS y
      FROM seg WHERE m IS NOT NULL) WHERE x <> '' AND y <> ''),
    matching AS (SELECT a, b, coalesce(sum(m.k), 0)::DOUBLE AS matched FROM seg GROUP BY a, b)"""
