"""First and second moments of vector tables, and the affine operators fitted from them.

Moments are the only thing that leaves the executors: each task adds up (n, sum x, sum x x^T) of its
rows in blocks and puts out one partial per Arrow stream; partials are summed on the driver, which holds
one d x d matrix. Fitted operators are small immutable objects; applying one is a projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.vectors import components_of, doubles, unit


def matrix_of(column: pa.Array) -> np.ndarray:
    """n x d float64 matrix of an Arrow list column of equal-length vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def list_array(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


@dataclass(frozen=True)
class Moments:
    """n, sum of x and sum of x y^T (y = x unless a second vector was given)."""

    n: int
    left: np.ndarray
    right: np.ndarray
    cross: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.left / max(1, self.n)

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return (self.cross - np.outer(self.left, self.right) / max(1, self.n)) / max(1, self.n - ddof)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.left + other.left, self.right + other.right, self.cross + other.cross)


def moments(df: DataFrame, x: str, y: str | None = None) -> Moments:
    """One pass over the rows. Components are shifted by nothing: inputs are cast to double first."""
    other = y or x

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, left, right, cross = 0, 0.0, 0.0, 0.0
        for batch in batches:
            a = matrix_of(batch.column(0))
            b = a if y is None else matrix_of(batch.column(1))
            if len(a):
                n, left, right, cross = n + len(a), left + a.sum(axis=0), right + b.sum(axis=0), cross + a.T @ b
        if n:
            values = [[float(n)], left, right, np.ravel(cross)]
            yield pa.RecordBatch.from_arrays([pa.array([list(v)], pa.list_(pa.float64())) for v in values], names=["n", "l", "r", "c"])

    columns = [doubles(x).alias("x")] + ([] if y is None else [doubles(other).alias("y")])
    rows = df.select(*columns).mapInArrow(partial, "n array<double>, l array<double>, r array<double>, c array<double>").collect()  # one row a task
    total: Moments | None = None
    for r in rows:
        left, right = np.array(r["l"]), np.array(r["r"])
        one = Moments(int(r["n"][0]), left, right, np.array(r["c"]).reshape(len(left), len(right)))
        total = one if total is None else total + one
    return total if total is not None else Moments(0, np.zeros(0), np.zeros(0), np.zeros((0, 0)))


def covariance_long(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov) with n - 1 in the denominator, as a relational aggregation; for tables of few dimensions."""
    v = doubles(vector)
    pairs = df.select(F.posexplode(v).alias("i", "x"), v.alias("v")).select("i", "x", F.posexplode("v").alias("j", "y"))
    return pairs.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def correlation_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """(i, j, r): Pearson correlation of each component of a with each of b, 0 where one is constant."""
    left = df.select(F.posexplode(doubles(a)).alias("i", "x"), doubles(b).alias("v"))
    pairs = left.select("i", "x", F.posexplode("v").alias("j", "y"))
    stats = pairs.groupBy("i", "j").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return stats.select("i", "j", F.when((F.col("sx") == 0) | (F.col("sy") == 0), F.lit(0.0)).otherwise(F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))


def component_stats(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Per key and component: n, mean, population variance, minimum and maximum."""
    long = components_of(df, vector, *keys)
    return long.groupBy(*keys, "pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.min("x").alias("lo"), F.max("x").alias("hi"))


NORMALISATIONS = ("standard", "minmax", "l2")


def normalise(df: DataFrame, vector: str, method: str, out: str | None = None) -> DataFrame:
    """Replace a vector by its normalised form.

    standard: (x - mean) / population deviation, a deviation of 0 counts as 1; minmax: to [0, 1], a range
    of 0 counts as 1; l2: over the length. The statistics are one row of d numbers, attached as constants.
    """
    if method not in NORMALISATIONS:
        raise ValueError(f"unknown normalisation {method!r}; known: {', '.join(NORMALISATIONS)}")
    out, v = out or vector, doubles(vector)
    if method == "l2":
        return df.withColumn(out, unit(v))
    rows = component_stats(df, vector).orderBy("pos").collect()  # d rows
    if method == "standard":
        shift, scale = [r["mean"] for r in rows], [r["var"] ** 0.5 for r in rows]
    else:
        shift, scale = [r["lo"] for r in rows], [r["hi"] - r["lo"] for r in rows]
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b or 1.0).alias("b")) for a, b in zip(shift, scale)])
    return df.withColumn(out, F.zip_with(v, pairs, lambda x, p: (x - p["a"]) / p["b"]))


def affine(df: DataFrame, vector: str, matrix: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, out: str | None = None) -> DataFrame:
    """(x - before) M + after for every row, in blocks; other columns are kept."""
    out = out or vector
    kept = [c for c in df.columns if c != out]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(1))
            if not len(x):
                continue
            x = x if before is None else x - before
            x = x @ matrix
            x = x if after is None else x + after
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(x)], names=["row", "y"])

    inputs = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), doubles(vector).alias("x"))
    schema = f"row {inputs.schema['row'].dataType.simpleString()}, y array<double>"
    return inputs.mapInArrow(apply, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("y").alias(out))


class NotFittedError(RuntimeError):
    """An operator was applied before it was fitted."""


@dataclass(frozen=True)
class Whitening:
    """x -> L^-1 (x - mean) with covariance + ridge I = L L^T, and back."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factor: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def fit(cls, df: DataFrame, vector: str, ridge: float = 1e-6) -> Whitening:
        m = moments(df, vector)
        return cls(m.mean, np.linalg.cholesky(m.covariance() + ridge * np.eye(len(m.mean))))

    def _check(self) -> None:
        if not len(self.mean):
            raise NotFittedError("the whitening is not fitted")

    @property
    def forward(self) -> np.ndarray:
        return np.linalg.inv(self.factor).T

    def whiten(self, df: DataFrame, vector: str, out: str | None = None) -> DataFrame:
        self._check()
        return affine(df, vector, self.forward, before=self.mean, out=out)

    def dewhiten(self, df: DataFrame, vector: str, out: str | None = None) -> DataFrame:
        self._check()
        return affine(df, vector, self.factor.T, after=self.mean, out=out)


@dataclass(frozen=True)
class Frame:
    """Analysis operator F (k x d) from prototypes; synthesis is its transpose. Parseval: F = U V^T of their SVD."""

    analysis: np.ndarray

    @classmethod
    def of(cls, prototypes: np.ndarray, parseval: bool = True) -> Frame:
        if not prototypes.size:
            raise NotFittedError("a frame needs prototypes")
        if not parseval:
            return cls(np.asarray(prototypes, dtype=np.float64))
        u, _, vt = np.linalg.svd(np.asarray(prototypes, dtype=np.float64), full_matrices=False)
        return cls(u @ vt)

    @property
    def synthesis(self) -> np.ndarray:
        return self.analysis.T

    def analyse(self, df: DataFrame, vector: str, out: str | None = None, whitening: Whitening | None = None) -> DataFrame:
        if whitening is None:
            return affine(df, vector, self.analysis.T, out=out)
        return affine(df, vector, whitening.forward @ self.analysis.T, before=whitening.mean, out=out)

    def synthesise(self, df: DataFrame, vector: str, out: str | None = None) -> DataFrame:
        return affine(df, vector, self.analysis, out=out)
