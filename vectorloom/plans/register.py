"""Registration of queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; negative zero becomes zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[(r(c, digits).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])
