"""Distances between two clouds of vectors, and between paired clouds.

All are exact, sinkhorn on all rows unless a sample is asked for. Those that compare all pairs run in blocks (``blocks``); the others are rewritten so that one
pass per cloud suffices: the mean cosine distance is 1 minus the product of the mean unit vectors, and
the Procrustes residual follows from the norms and the singular values of A^T B.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.numerics import sinkhorn_plan
from vectorloom.functions.vectors import components_of, doubles, norm, squared_distance, unit
from vectorloom.operators import blocks
from vectorloom.operators.moments import moments


def euclidean(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean of all pairwise distances."""
    return blocks.pair_sums(a, b, key, vector).select((F.col("total") / F.col("pairs")).alias("distance"))


def cosine(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean cosine distance of all pairs without a zero vector."""

    def means(df: DataFrame, name: str) -> DataFrame:
        v = doubles(vector)
        rows = df.where(norm(v) > 0).select(F.posexplode(unit(v)).alias("pos", "x"))
        return rows.groupBy("pos").agg(F.avg("x").alias(name))

    return means(a, "x").join(means(b, "y"), "pos").agg((1 - F.sum(F.col("x") * F.col("y"))).alias("distance"))


def mahalanobis(a: DataFrame, b: DataFrame, key: str, vector: str, covariance: np.ndarray | None = None) -> float:
    """Distance of the centroids under the covariance of both clouds stacked, or a given one."""
    ma, mb = moments(a, vector), moments(b, vector)
    c = (ma + mb).covariance() if covariance is None else covariance
    gap = ma.mean - mb.mean
    inverse = np.linalg.pinv(c) if np.linalg.matrix_rank(c) < len(c) else np.linalg.inv(c)
    return float(np.sqrt(max(0.0, gap @ inverse @ gap)))


def _ranked(df: DataFrame, vector: str, name: str, buckets: int) -> DataFrame:
    """(rank, value) of all components in ascending order, ranked by value ranges instead of one sort task."""
    values = df.select(F.explode(doubles(vector)).alias(name))
    bounds = values.agg(F.min(name).alias("lo"), F.max(name).alias("hi")).first()
    if bounds["lo"] is None:
        return values.select(F.lit(0).cast("long").alias("rank"), name)
    width = (bounds["hi"] - bounds["lo"]) / buckets or 1.0
    placed = values.withColumn("range", F.least(F.lit(buckets - 1), F.floor((F.col(name) - bounds["lo"]) / width)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # at most ``buckets`` rows
    within = Window.partitionBy("range").orderBy(name)
    return placed.join(F.broadcast(firsts), "range").select((F.col("first") + F.row_number().over(within)).alias("rank"), name)


def wasserstein_1d(a: DataFrame, b: DataFrame, key: str, vector: str, buckets: int = 256) -> DataFrame:
    """Mean absolute difference of the sorted components; both sides must have as many."""
    both = _ranked(a, vector, "x", buckets).join(_ranked(b, vector, "y", buckets), "rank")
    return both.agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("distance"))


def chamfer(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean distance to the nearest point of the other side, both ways added."""
    one = blocks.row_minimum(a, b, key, vector).agg(F.avg("d").alias("p")).withColumn("u", F.lit(1))
    two = blocks.row_minimum(b, a, key, vector).agg(F.avg("d").alias("q")).withColumn("u", F.lit(1))
    return one.join(two, "u").select((F.col("p") + F.col("q")).alias("distance"))


def hausdorff(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Largest distance to the nearest point of the other side."""
    both = blocks.row_minimum(a, b, key, vector).union(blocks.row_minimum(b, a, key, vector))
    return both.agg(F.max("d").alias("distance"))


def procrustes(a: DataFrame, b: DataFrame, key: str, vector: str) -> float:
    """Mean squared row residual after the best orthogonal map of a onto b, rows paired by key."""
    pairs = a.select(key, doubles(vector).alias("x")).join(b.select(key, doubles(vector).alias("y")), key)
    m = moments(pairs, "x", "y")
    sizes = pairs.agg(F.sum(norm(F.col("x")) ** 2).alias("xx"), F.sum(norm(F.col("y")) ** 2).alias("yy")).first()
    return float((sizes["xx"] + sizes["yy"] - 2 * np.linalg.svd(m.cross, compute_uv=False).sum()) / m.n)


def sinkhorn(a: DataFrame, b: DataFrame, key: str, vector: str, epsilon: float = 0.1, converge: bool = False, max_points: int | None = None, limit: int = 5000) -> float:
    """Entropic transport cost between uniform marginals, of all rows or of max_points hash-sampled ones a side.

    The plan is a dense matrix on the driver, so a side of more than ``limit`` rows raises unless max_points is given.
    The plain form scales rows and columns once, as the comparable tool's stop test does; converge=True
    goes on until the scaling settles.
    """
    sides = []
    for df in (a, b):
        rows = (sample(df, key, max_points) if max_points else df.limit(limit + 1)).select(doubles(vector).alias("v")).collect()
        if not max_points and len(rows) > limit:
            raise ValueError(f"a side has more than {limit} rows; give max_points to compare samples")
        sides.append(np.array([r["v"] for r in rows]))
    cost = np.sqrt(blocks.squared(*sides))
    plan = sinkhorn_plan(cost, epsilon, 1000 if converge else 1)
    return float((plan * cost).sum())


def sinkhorn_cost(a: DataFrame, b: DataFrame, key: str, vector: str, epsilon: float = 0.1, converge: bool = False, dense: int = 5000) -> float:
    """``sinkhorn`` of tables of any size: by blocks where a side has more than ``dense`` rows."""
    from vectorloom.operators import transport

    if max(a.count(), b.count()) <= dense:
        return sinkhorn(a, b, key, vector, epsilon, converge, limit=dense)
    return transport.sinkhorn(a, b, key, vector, epsilon, 1000 if converge else 1).cost


def foscttm(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Fraction of rows closer than the true match, a to b, b to a and their mean; null for a single row."""

    def way(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        closer = blocks.closer_than_match(x, y, key, vector)
        return closer.agg((F.sum("n_closer") / F.nullif(F.count("*") * (F.count("*") - 1), F.lit(0))).alias(name)).withColumn("u", F.lit(1))

    both = way(a, b, "a_to_b").join(way(b, a, "b_to_a"), "u")
    return both.select("a_to_b", "b_to_a", ((F.col("a_to_b") + F.col("b_to_a")) / 2).alias("score"))


def reconstruction_mse(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean squared difference over all components of rows paired by key."""
    pairs = a.select(key, doubles(vector).alias("x")).join(b.select(key, doubles(vector).alias("y")), key)
    return pairs.agg((F.sum(squared_distance(F.col("x"), F.col("y"))) / F.sum(F.size("x"))).alias("mse"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: those with the smallest md5 of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))).limit(n)


DISTANCES: dict[str, Callable] = {
    "euclidean": euclidean,
    "cosine": cosine,
    "mahalanobis": mahalanobis,
    "wasserstein": wasserstein_1d,
    "sinkhorn": sinkhorn,
    "procrustes": procrustes,
    "chamfer": chamfer,
    "hausdorff": hausdorff,
}


def distance(name: str, a: DataFrame, b: DataFrame, key: str, vector: str, **options) -> float:
    """A named distance as a number; unknown names raise."""
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(DISTANCES)}")
    found = DISTANCES[name](a, b, key, vector, **options)
    return float(found.first()["distance"]) if isinstance(found, DataFrame) else found


def flattened(df: DataFrame, vector: str) -> DataFrame:
    """All components in one column."""
    return components_of(df, vector).select("x")
