"""Registration of a query and its SQL with one shared output list."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


class Case(NamedTuple):
    run: Run
    sql: str | None


CASES: dict[str, Case] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _uses(body: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", body))
    return [name for name in CTES if name in words]


def with_ctes(body: str) -> str:
    """``body`` preceded by every common table it refers to, in order."""
    needed: dict[str, None] = {}
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in _uses(text):
            if name not in seen:
                seen.add(name)
                visit(CTES[name])
                needed[name] = None

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body


def words(text: str) -> list[str]:
    return text.split()


def case(
    name: str,
    run: Run,
    body: str | None = None,
    keep: str = "",
    ints: str = "",
    nums: str = "",
    digits: int = 6,
) -> None:
    """Register a query.

    Both sides return ``keep`` columns as they are, ``ints`` as BIGINT and ``nums``
    rounded to ``digits`` (adding zero removes a negative zero).
    """
    k, i, n = words(keep), words(ints), words(nums)

    def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        if not (k or i or n):
            return df
        return df.select(
            *k,
            *[F.col(c).cast("bigint").alias(c) for c in i],
            *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in n],
        )

    sql = None
    if body is not None:
        cols = [*k, *(f"CAST({c} AS BIGINT) AS {c}" for c in i)]
        cols += [f"round(CAST({c} AS DOUBLE), {digits}) + 0e0 AS {c}" for c in n]
        sql = with_ctes(f"SELECT {', '.join(cols) if cols else '*'} FROM ({body}) q")
    if name in CASES:
        raise ValueError(f"query {name!r} is registered twice")
    CASES[name] = Case(shaped, sql)
