"""Exact all-pairs kernels in blocks: nearest neighbours, nearest anchors, mean, minimum and rank distances.

Rows are dealt into blocks by a hash of their id. Each pair of blocks meets in one group of a cogroup, which
puts out at most a few rows per point, so neither side is ever broadcast or collected, and there is no join that
lists pairs of rows. A row is copied once per block of the other side, so blocks are as large as BLOCK_BYTES and
MOST_ROWS allow, or smaller where that leaves cores idle; inside a group distances are made in strips of bounded size.
So the memory and the work of a group are bounded whatever the table's size. Work is quadratic, as the operators
are; the number of groups grows with it, and each is dealt to a partition of its own as far as there are any.
Vectors of floats travel as floats.

The expansion |a|^2 + |b|^2 - 2 ab picks candidates; distances put out are recomputed from differences.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.vectors import doubles
from vectorloom.operators.moments import matrix_of

BLOCK_BYTES, MOST_ROWS, LEAST_ROWS, MOST_TASKS = 16 << 20, 1 << 15, 512, 4096


def block_counts(a: DataFrame, b: DataFrame, vector: str, rows: int | None = None) -> tuple[int, int]:
    """Blocks of each side: of ``rows`` rows, or as few as fit in BLOCK_BYTES and MOST_ROWS and keep all cores busy."""
    shapes = [df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first() for df in (a, b)]
    if rows is None:
        most = max(1, min(MOST_ROWS, BLOCK_BYTES // (8 * max(1, *((s["width"] or 1) for s in shapes)))))
        side = math.ceil(math.sqrt(2 * a.sparkSession.sparkContext.defaultParallelism))
        return tuple(max(1, -(-s["n"] // most), min(side, s["n"] // LEAST_ROWS)) for s in shapes)
    return tuple(max(1, -(-s["n"] // rows)) for s in shapes)


def packed(df: DataFrame, vector: str) -> Column:
    """The vector as it travels: floats stay floats, all else becomes doubles."""
    return F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else doubles(vector)


def _dealt(df: DataFrame, key: str, vector: str, blocks: int, others: int, own: str, other: str) -> DataFrame:
    block = F.pmod(F.xxhash64(F.lit(17), key), F.lit(blocks)).cast("int")
    rows = df.select(F.col(key).cast("long").alias("id"), packed(df, vector).alias("v"), block.alias(own))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def pairwise(a: DataFrame, b: DataFrame, key: str, vector: str, kernel: Callable, schema: str, rows: int | None = None) -> DataFrame:
    """kernel(ids_a, A, ids_b, B) -> pa.Table for each pair of blocks, all put together."""
    na, nb = block_counts(a, b, vector, rows)
    tasks = min(na * nb, MOST_TASKS)  # groups are heavy for their bytes, so a number of partitions is asked for that stays
    left = _dealt(a, key, vector, na, nb, "i", "j").repartition(tasks, "i", "j").groupBy("i", "j")
    right = _dealt(b, key, vector, nb, na, "j", "i").repartition(tasks, "i", "j").groupBy("i", "j")

    def run(_key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.sort_by("id"), y.sort_by("id")
        return kernel(x.column("id").to_numpy(), _matrix(x), y.column("id").to_numpy(), _matrix(y))

    return left.cogroup(right).applyInArrow(run, schema)


def _matrix(table: pa.Table) -> np.ndarray:
    return matrix_of(table.column("v").combine_chunks()) if table.num_rows else np.zeros((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, not below 0."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _strips(n: int, m: int, budget: int = 1 << 20):
    step = max(1, budget // max(1, m))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def nearest(a: DataFrame, b: DataFrame, key: str, vector: str, k: int, exclude_self: bool = False, rows: int | None = None) -> DataFrame:
    """(src, dst, rank, d): the k nearest rows of b for each row of a; ties go to the smaller id.

    exclude_self leaves out the row with the same id.
    """

    def kernel(ids_a, x, ids_b, y) -> pa.Table:
        src, dst, dist = [], [], []
        for strip in _strips(len(x), len(y)):
            d = squared(x[strip], y)
            if exclude_self:
                d[ids_a[strip, None] == ids_b[None]] = np.inf
            if not d.shape[1]:
                continue
            # a few more than k by the expansion, so that exact recomputation decides near ties
            take = min(d.shape[1], k + 8)
            near = np.argpartition(d, take - 1, axis=1)[:, :take] if take < d.shape[1] else np.broadcast_to(np.arange(take), d.shape)
            exact = np.sqrt(((x[strip, None] - y[near]) ** 2).sum(-1))
            if exclude_self:
                exact[ids_a[strip, None] == ids_b[near]] = np.inf
            order = np.lexsort((ids_b[near], exact), axis=1)[:, :k]
            exact, near = np.take_along_axis(exact, order, 1), np.take_along_axis(near, order, 1)
            good = np.isfinite(exact)
            src.append(np.repeat(ids_a[strip], good.sum(1)))
            dst.append(ids_b[near][good])
            dist.append(exact[good])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"src": join(src, pa.int64()), "dst": join(dst, pa.int64()), "d": join(dist, pa.float64())})

    found = pairwise(a, b, key, vector, kernel, "src long, dst long, d double", rows)
    # at most k rows per point and block reach this step
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("d", "dst"))), 1, k)
    best = found.groupBy("src").agg(ranked.alias("near")).select("src", F.posexplode("near").alias("rank", "n"))
    return best.select("src", F.col("n.dst").alias("dst"), F.col("rank"), F.col("n.d").alias("d"))


def row_minimum(a: DataFrame, b: DataFrame, key: str, vector: str, rows: int | None = None) -> DataFrame:
    """(id, d): distance of each row of a to its nearest row of b."""
    return nearest(a, b, key, vector, 1, rows=rows).select(F.col("src").alias("id"), "d")


def pair_sums(a: DataFrame, b: DataFrame, key: str, vector: str, rows: int | None = None) -> DataFrame:
    """One row: number of pairs, sum and maximum of all distances between a and b."""

    def kernel(ids_a, x, ids_b, y) -> pa.Table:
        total, top = 0.0, 0.0
        for strip in _strips(len(x), len(y)):
            d = np.sqrt(squared(x[strip], y))
            close = d < 1e-6
            if close.any():
                i, j = np.nonzero(close)
                d[i, j] = np.sqrt(((x[strip][i] - y[j]) ** 2).sum(-1))
            total, top = total + float(d.sum()), max(top, float(d.max(initial=0.0)))
        return pa.table({"pairs": pa.array([len(x) * len(y)], pa.int64()), "total": pa.array([total]), "top": pa.array([top])})

    parts = pairwise(a, b, key, vector, kernel, "pairs long, total double, top double", rows)
    return parts.agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.max("top").alias("top"))


def closer_than_match(a: DataFrame, b: DataFrame, key: str, vector: str, rows: int | None = None) -> DataFrame:
    """(id, n_closer): for each row of a, how many rows of b are closer than the one with its own id."""
    match = a.select(F.col(key).alias("id"), packed(a, vector).alias("v")).join(b.select(F.col(key).alias("id"), packed(b, vector).alias("w")), "id")
    with_match = match.select("id", F.concat("v", "w").alias("v2"))

    def kernel(ids_a, x, ids_b, y) -> pa.Table:
        half = x.shape[1] // 2 if x.size else 0
        own, mate = x[:, :half], x[:, half:]
        y = y[:, : y.shape[1] // 2] if y.size else y
        limit = np.sqrt(((own - mate) ** 2).sum(1))
        count = np.zeros(len(x), dtype=np.int64)
        for strip in _strips(len(x), len(y)):
            d = np.sqrt(squared(own[strip], y))
            unsure = np.abs(d - limit[strip, None]) < 1e-6
            i, j = np.nonzero(unsure)
            if len(i):
                d[i, j] = np.sqrt(((own[strip][i] - y[j]) ** 2).sum(-1))
            count[strip] = ((d < limit[strip, None]) & (ids_a[strip, None] != ids_b[None])).sum(1)
        return pa.table({"id": pa.array(ids_a, pa.int64()), "n": pa.array(count)})

    other = b.select(F.col(key).alias("id"), F.concat(packed(b, vector), packed(b, vector)).alias("v2"))
    parts = pairwise(with_match, other, "id", "v2", kernel, "id long, n long", rows)
    return parts.groupBy("id").agg(F.sum("n").alias("n_closer"))
