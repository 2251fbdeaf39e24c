"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def r6(name: str | Column, alias: str | None = None, digits: int = 6) -> Column:
    """Rounded output column; adding zero turns -0.0 into 0.0.

    As SQL rounds doubles: the scaled value goes to its nearest whole number, halves away from zero. Rounding
    the decimal text of a value instead differs where only the scaled value is a half.
    """
    col = F.col(name) if isinstance(name, str) else name
    scale = 10.0**digits
    return (F.round(col.cast("double") * scale, 0) / scale + 0.0).alias(alias or name)


def s6(expr: str, digits: int = 6) -> str:
    return f"(round({expr},{digits})+0.0e0)"
