"""Column expressions over ``array<float>`` vectors; everything is computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    """The vector with double components."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    length = norm(a)
    safe = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(a, lambda x: x / safe)


def literal(values) -> Column:
    """A vector constant from driver-side numbers."""
    return F.array(*[F.lit(float(v)) for v in values])


def components_of(df: DataFrame, vector: str, *keys: str, out: str = "x") -> DataFrame:
    """Long form: the keys, pos (from 0) and the component."""
    return df.select(*keys, F.posexplode(doubles(vector)).alias("pos", out))


def assemble(long: DataFrame, keys: list[str], value: str, out: str = "v") -> DataFrame:
    """Vectors from long form, components in order of pos."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", value)))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(out))
