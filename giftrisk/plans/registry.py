"""Registry of named queries: a Spark callable (spark, sf_dir) -> DataFrame and,
when the operator is expressible in SQL, the DuckDB oracle text."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, Callable[[], str] | str] = {}


def query(name: str, sql: Callable[[], str] | str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round a double for comparison; adding 0.0 turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def q6(expr: str, digits: int = 6) -> str:
    """SQL twin of ``r6``."""
    return f"(round({expr}, {digits}) + CAST(0.0 AS DOUBLE))"


def bigint_counts(sql: str) -> str:
    """DuckDB types count_if as HUGEINT; wrap each call in CAST(... AS BIGINT)
    so oracle counts have Spark's bigint type."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append("CAST(" + key + bigint_counts(sql[j + len(key):k]) + ") AS BIGINT)")
        i = k + 1
