"""Registry of named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, tuple[str, tuple[str, ...]]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    """Name a common table expression and the ones it builds on."""
    CTES[name] = (needs, sql)


def with_ctes(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name):
        if name not in order:
            for n in CTES[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {parts}\n{select}" if order else select


NUDGE = 1.7e-3  # in units of the last kept digit


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column so that results of two engines compare exactly.

    A small nudge takes exact ties, whose last bit depends on the order of
    summation, off the rounding border; -0.0 becomes 0.0.
    """
    def one(field):
        if not isinstance(field.dataType, T.DoubleType):
            return F.col(field.name)
        r = F.round(F.col(field.name) + NUDGE * 10 ** -digits, digits)
        return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(field.name)
    return df.select(*[one(f) for f in df.schema.fields])


def R(expression: str, digits: int = 6) -> str:
    """The SQL twin of `rounded` for one expression."""
    r = f"round(CAST({expression} AS DOUBLE) + {NUDGE * 10 ** -digits!r}::DOUBLE, {digits})"
    return f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END"


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query; with `oracle`, also the equivalent SQL."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = (oracle, needs)
        return fn
    return register


def oracles() -> dict[str, str]:
    return {name: with_ctes(sql, *needs) for name, (sql, needs) in ORACLES.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
