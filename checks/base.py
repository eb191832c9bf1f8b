"""Tables, shared fixture SQL and the registry used by the query modules.

A fixture is one SELECT that both engines understand: `{lineitem}` and the like
stand for the given tables (or for other fixtures).  Spark runs it with
`spark.sql`; the oracle uses the same text as a CTE.  Only the inputs are shared
this way - the operators under test are written separately in each engine.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

FIXTURES: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _refs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table or a fixture as a Spark DataFrame."""
    if name in TABLES:
        return read(spark, sf, name)
    sql = FIXTURES[name].replace("list_value(", "array(").replace("string_split(", "split(")
    return spark.sql(sql, **{r: fixture(spark, sf, r) for r in _refs(sql)})


def ctes(*names: str) -> str:
    """The fixtures (and what they need) as 'a AS (...), b AS (...)' for the oracle."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        if n in TABLES or n in done:
            return
        for r in _refs(FIXTURES[n]):
            add(r)
        done[n] = re.sub(r"\{(\w+)\}", r"\1", FIXTURES[n])

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({sql})" for n, sql in done.items())


def oracle(fixtures: tuple[str, ...] | list[str], body: str, extra: str = "") -> str:
    """WITH <fixtures>, <extra> <body>."""
    parts = [p for p in (ctes(*fixtures), extra) if p]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def ratio_sql(pairs: str) -> str:
    """Recursive CTEs: gr(a, b, ratio) for the pairs (a, b) of a CTE, by longest common substrings.  Needs WITH RECURSIVE."""
    run = "len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k)))"
    return f"""gs(a, b, todo, m) AS (SELECT a, b, [[0::BIGINT, length(a), 0, length(b)]], 0::BIGINT FROM (SELECT DISTINCT a, b FROM {pairs}) UNION ALL
 SELECT a, b, list_concat(todo[2:], CASE WHEN best[1] = 0 THEN [] ELSE list_filter([[alo, -best[2], blo, -best[3]], [best[1] - best[2], ahi, best[1] - best[3], bhi]], lambda s: s[1] < s[2] AND s[3] < s[4]) END), m + best[1]
 FROM (SELECT *, list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: [{run}, -i, -j])))) AS best
  FROM (SELECT *, todo[1][1] AS alo, todo[1][2] AS ahi, todo[1][3] AS blo, todo[1][4] AS bhi FROM gs WHERE len(todo) > 0))),
gr AS (SELECT a, b, 2.0::DOUBLE * max(m) / (length(a) + length(b)) AS ratio FROM gs WHERE len(todo) = 0 GROUP BY a, b)"""


def query(name: str, sql: str | None = None):
    """Register a query function and, where there is one, its oracle SQL."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
