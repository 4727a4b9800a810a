"""Vector functions callable from SQL text, as temporary SQL functions: Catalyst inlines them, no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate({0}, 0D, (acc, x) -> acc + x)"
_DOT = _SUM.format("zip_with({0}, {1}, (x, y) -> x * y)")

#: name -> (parameters, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "vl_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _DOT.format("a", "b")),
    "vl_norm": ("a ARRAY<DOUBLE>", "DOUBLE", f"sqrt({_DOT.format('a', 'a')})"),
    "vl_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"sqrt({_SUM.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')})"),
    "vl_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"{_DOT.format('a', 'b')} / nullif(sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}), 0D)"),
    "vl_jaccard": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", "coalesce(size(array_intersect(a, b)) / nullif(size(array_union(a, b)), 0), 0D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session under their names, which are returned.

    A zero vector has no cosine (null); two empty sets have a Jaccard index of 0.
    """
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
