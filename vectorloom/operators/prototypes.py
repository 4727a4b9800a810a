"""Clusterings, anchors and prototypes of a vector table.

A clustering is a table (id, cluster); prototypes are a table (cluster, v). Centroids that are applied to
rows number k, a parameter, so they travel as constants.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.vectors import assemble, components_of, doubles
from vectorloom.operators import blocks
from vectorloom.operators.distances import sample
from vectorloom.operators.graph import connected_components, knn_edges, laplacian_matrix, row_ids
from vectorloom.operators.moments import Frame, Whitening, matrix_of
from vectorloom.session import checkpoint, discard


def centroids(df: DataFrame, key: str, vector: str, assigned: DataFrame, n_samples: int | None = None, seed: int = 42) -> DataFrame:
    """(cluster, pos, x): mean of each cluster's members, or of the n_samples with the smallest md5 of seed + cluster and key.

    Noise labelled -1 is a cluster like any other. ``assigned``: (key, cluster); rows of another table with
    the same keys may be averaged, which injects one table's clusters into another.
    """
    rows = df.select(key, doubles(vector).alias("v")).join(assigned.select(key, "cluster"), key)
    if n_samples is not None:
        order = Window.partitionBy("cluster").orderBy(F.md5(F.concat((F.lit(seed) + F.col("cluster")).cast("string"), F.lit("-"), F.col(key).cast("string"))))
        rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_samples)
    return components_of(rows, "v", "cluster").groupBy("cluster", "pos").agg(F.avg("x").alias("x"))


def prototype_vectors(long: DataFrame) -> DataFrame:
    """(cluster, v) from the long form."""
    return assemble(long, ["cluster"], "x")


def as_matrix(long: DataFrame) -> tuple[list[int], np.ndarray]:
    """Cluster labels in order and the k x d matrix of their prototypes, on the driver."""
    rows = prototype_vectors(long).orderBy("cluster").collect()  # k rows
    return [r["cluster"] for r in rows], np.array([r["v"] for r in rows])


def assign_nearest(df: DataFrame, key: str, vector: str, centres: np.ndarray, labels: list[int] | None = None) -> DataFrame:
    """(key, cluster, d): nearest of k given centres; the first of equals wins."""
    names = np.array(labels if labels is not None else range(len(centres)), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(1))
            if not len(x):
                continue
            d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(-1)) if x.size * len(centres) < 1 << 24 else np.sqrt(blocks.squared(x, centres))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[near]), pa.array(d[np.arange(len(x)), near])], names=[key, "cluster", "d"])

    return df.select(F.col(key).cast("long"), doubles(vector).alias("v")).mapInArrow(run, f"{key} long, cluster long, d double")


def lloyd(df: DataFrame, key: str, vector: str, k: int, iterations: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """Deterministic k-means: the k rows with the smallest md5 of seed and key start, a fixed number of rounds.

    Each round is one aggregation; only k centroids are kept. Returns the last assignment and the centroids
    it was made with.
    """
    first = sample(df, key, k, seed).select(key, doubles(vector).alias("v")).orderBy(key).collect()
    if len(first) < k:
        raise ValueError(f"{k} clusters need as many rows; there are {len(first)}")
    centres = np.array([r["v"] for r in first])
    for _ in range(iterations):
        assigned = assign_nearest(df, key, vector, centres)
        names, fresh = as_matrix(centroids(df, key, vector, assigned))
        centres = centres.copy()
        centres[names] = fresh
    return assign_nearest(df, key, vector, centres), centres


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42, iterations: int = 300) -> DataFrame:
    """(key, cluster) by Spark's own k-means||."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(key), array_to_vector(doubles(vector)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(rows)
    return model.transform(rows).select(key, F.col("prediction").cast("long").alias("cluster"))


def dbscan(df: DataFrame, key: str, vector: str, eps: float, min_samples: int) -> DataFrame:
    """(key, cluster): core points within eps of each other connect, border points join one, the rest is -1.

    Three passes of the block kernels, of which none lists the pairs within eps: neighbours are counted; each pair of
    blocks of cores puts out a forest that connects what it connects; the other points take the least cluster of
    the cores near them. Forests are joined by label propagation. Clusters are numbered by their smallest core key.
    """

    def near(x, y):
        for strip in blocks._strips(len(x), len(y)):
            yield strip, np.sqrt(blocks.squared(x[strip], y)) <= eps + 1e-12

    def count(ids_a, x, _, y) -> pa.Table:
        n = np.zeros(len(x), dtype=np.int64)
        for strip, hit in near(x, y):
            n[strip] = hit.sum(1)
        return pa.table({"a": pa.array(ids_a, pa.int64()), "n": pa.array(n)})

    def forest(ids_a, x, ids_b, y) -> pa.Table:
        ids, root = np.concatenate([ids_a, ids_b]).astype(np.int64), np.arange(len(ids_a) + len(ids_b))
        for strip, hit in near(x, y):
            i, j = np.nonzero(hit)
            root = _united(root, i + strip.start, j + len(ids_a))
        return pa.table({"src": pa.array(ids), "dst": pa.array(ids[root])}).filter(pa.array(ids != ids[root]))

    def least(ids_a, x, _, y) -> pa.Table:
        found = np.full(len(x), np.inf)
        if len(x) and len(y):
            for strip, hit in near(x[:, :-1], y[:, :-1]):
                found[strip] = np.where(hit, y[None, :, -1], np.inf).min(1)
        good = np.isfinite(found)
        return pa.table({"id": pa.array(ids_a[good], pa.int64()), "cluster": pa.array(found[good].astype(np.int64))})

    points = df.select(F.col(key).cast("long").alias("id"), blocks.packed(df, vector).alias("v"))
    counts = blocks.pairwise(points, points, "id", "v", count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    core = checkpoint(points.join(counts.where(F.col("n") >= min_samples).select(F.col("a").alias("id")), "id"))
    links = blocks.pairwise(core, core, "id", "v", forest, "src long, dst long")
    roots = connected_components(links, core.select("id"))
    numbers = row_ids(roots.select("component").distinct(), "component").withColumnRenamed("id", "cluster")
    placed = checkpoint(roots.join(numbers, "component").select("id", "cluster"))
    ends = core.join(placed, "id").select("id", F.concat(doubles("v"), F.array(F.col("cluster").cast("double"))).alias("v"))
    others = points.join(placed, "id", "left_anti").select("id", F.concat(doubles("v"), F.array(F.lit(0.0))).alias("v"))
    border = blocks.pairwise(others, ends, "id", "v", least, "id long, cluster long").groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = placed.unionByName(border).withColumnRenamed("id", key)
    return df.select(key).join(found, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def _united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of a forest (each the least of its tree) after the links i - j."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def agglomerative(df: DataFrame, key: str, vector: str, k: int, max_rows: int = 2000) -> DataFrame:
    """(key, cluster) by Ward linkage, numbered by first member: on the driver up to max_rows rows, above that by tables.

    Ward's linkage is reducible, so all pairs of clusters that are each other's nearest merge in one round, and the merges
    are those of one merge at a time. A round is one pass of the block kernels over (id, size, centroid); what is left at
    max_rows clusters is agglomerated on the driver. Undoing the k - 1 last merges by height leaves the clusters.
    Equal rows merge first and are grouped before any round. The closest pair always merges, so rounds come to an
    end, but their number depends on the data. Where distances tie other than at 0, one of the
    possible trees comes out.
    """
    rows = checkpoint(df.select(F.col(key).cast("long").alias("id"), doubles(vector).alias("v")))
    if rows.count() > max_rows:
        return _ward_table(rows, k, max_rows).withColumnRenamed("id", key)
    local = rows.orderBy("id").collect()
    labels = ward(np.array([r["v"] for r in local]), k)
    return df.sparkSession.createDataFrame([(r["id"], int(c)) for r, c in zip(local, labels)], f"{key} long, cluster long")


def _ward_table(rows: DataFrame, k: int, most: int) -> DataFrame:
    """(id, cluster) of rows (id, v); a merge is a row (height, step, up, id): id joins the cluster of the smaller id up."""
    grouped = checkpoint(rows.groupBy("v").agg(F.min("id").alias("up"), F.count("*").cast("double").alias("size")))
    clusters = grouped.select(F.col("up").alias("id"), "v", "size", F.lit(0.0).alias("top"))
    merges = [checkpoint(rows.join(grouped, "v").where("id <> up").select(F.lit(0.0).alias("height"), F.lit(0).alias("step"), "up", "id"))]
    held, step = grouped, 0
    while clusters.count() > most:
        step += 1
        near = checkpoint(_ward_nearest(clusters))
        back = near.select(F.col("id").alias("to"), F.col("to").alias("id"))
        tops = clusters.select("id", "top"), clusters.select(F.col("id").alias("to"), F.col("top").alias("top_to"))
        mutual = near.join(back, ["id", "to"], "left_semi").where("id < to").join(tops[0], "id").join(tops[1], "to")
        made = checkpoint(mutual.select(F.greatest("d", "top", "top_to").alias("height"), F.lit(step).alias("step"), F.col("id").alias("up"), F.col("to").alias("id")))
        other = clusters.select("id", F.col("v").alias("w"), F.col("size").alias("more")).join(made, "id").select(F.col("up").alias("id"), "w", "more", "height")
        both = clusters.join(made, "id", "left_anti").join(other, "id", "left")
        mean = F.zip_with("v", "w", lambda x, y: (x * F.col("size") + y * F.col("more")) / (F.col("size") + F.col("more")))
        fresh = checkpoint(both.select("id", F.coalesce(mean, "v").alias("v"), (F.col("size") + F.coalesce("more", F.lit(0.0))).alias("size"), F.coalesce("height", "top").alias("top")))
        discard(near)
        discard(held)
        held = clusters = fresh
        merges.append(made)
    last = clusters.orderBy("id").collect()  # at most ``most`` rows
    ids = [r["id"] for r in last]
    steps = _ward_steps(np.array([r["v"] for r in last]), np.array([r["size"] for r in last]), 1)
    top, listed = [r["top"] for r in last], []
    for at, (height, i, j) in enumerate(steps):
        top[i] = max(height, top[i], top[j])
        listed.append((float(top[i]), step + 1 + at, ids[i], ids[j]))
    merges.append(rows.sparkSession.createDataFrame(listed, "height double, step int, up long, id long"))
    every = functools.reduce(DataFrame.unionByName, merges)
    undone = every.orderBy(F.desc("height"), F.desc("step"), F.desc("up"), F.desc("id")).limit(max(0, k - 1)).select("id")
    ups = every.join(undone, "id", "left_anti").select("id", "up")
    held = placed = checkpoint(rows.select("id").join(ups, "id", "left").select("id", F.coalesce("up", "id").alias("up")))
    while True:  # pointers are doubled until all lead to their first member
        doubled = placed.join(placed.select(F.col("id").alias("up"), F.col("up").alias("next")), "up")
        fresh = checkpoint(doubled.select("id", F.col("next").alias("up"), (F.col("up") != F.col("next")).alias("moved")))
        discard(held)
        held, placed = fresh, fresh.select("id", "up")
        if fresh.where("moved").isEmpty():
            break
    numbers = row_ids(placed.select("up").distinct(), "up").select("up", F.col("id").alias("cluster"))
    return placed.join(numbers, "up").select("id", "cluster")


def _ward_nearest(clusters: DataFrame) -> DataFrame:
    """(id, to, d): the cluster whose merge with each one adds least to the sum of squares, the smaller id of equals."""

    def kernel(ids_a, x, ids_b, y) -> pa.Table:
        to, least = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
        for strip in blocks._strips(len(x), len(y)) if len(y) else ():
            cost = lambda s, t: s * t / (s + t)
            d = blocks.squared(x[strip, :-1], y[:, :-1]) * cost(x[strip, -1:], y[None, :, -1])
            d[ids_a[strip, None] == ids_b[None]] = np.inf
            take = min(d.shape[1], 8)
            near = np.argpartition(d, take - 1, axis=1)[:, :take] if take < d.shape[1] else np.broadcast_to(np.arange(take), d.shape)
            # from differences, so that both sides of a pair see the very same number
            exact = ((x[strip, None, :-1] - y[near][:, :, :-1]) ** 2).sum(-1) * cost(x[strip, -1:], y[near][:, :, -1])
            exact[ids_a[strip, None] == ids_b[near]] = np.inf
            first = np.lexsort((ids_b[near], exact), axis=1)[:, :1]
            to[strip], least[strip] = ids_b[np.take_along_axis(near, first, 1)[:, 0]], np.take_along_axis(exact, first, 1)[:, 0]
        good = np.isfinite(least)
        return pa.table({"id": pa.array(ids_a[good], pa.int64()), "to": pa.array(to[good]), "d": pa.array(least[good])})

    sized = clusters.select("id", F.concat("v", F.array("size")).alias("v"))
    found = blocks.pairwise(sized, sized, "id", "v", kernel, "id long, to long, d double")
    return found.groupBy("id").agg(F.min(F.struct("d", "to")).alias("near")).select("id", "near.to", "near.d")


def _ward_steps(x: np.ndarray, size: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """Merges (height, i, j) of clusters with given centroids and sizes down to k; j joins i < j (Lance-Williams updates)."""
    n = len(x)
    d = blocks.squared(x, x) * (size[:, None] * size[None] / (size[:, None] + size[None]))
    np.fill_diagonal(d, np.inf)
    size, alive, steps = size.copy(), np.ones(n, dtype=bool), []
    for _ in range(max(0, n - k)):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        steps.append((float(d[i, j]), int(i), int(j)))
        others = alive.copy()
        others[[i, j]] = False
        s = size[others]
        d[i, others] = ((size[i] + s) * d[i, others] + (size[j] + s) * d[j, others] - s * d[i, j]) / (size[i] + size[j] + s)
        d[others, i] = d[i, others]
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
    return steps


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of Ward's agglomeration into k clusters, numbered by first member."""
    label = np.arange(len(x))
    for _, i, j in _ward_steps(x, np.ones(len(x)), k):
        label[label == j] = i
    _, out = np.unique(label, return_inverse=True)
    return out


def spectral(df: DataFrame, key: str, vector: str, n_clusters: int, k: int = 10, seed: int = 42) -> DataFrame:
    """(key, cluster): kNN graph, symmetric Laplacian, smallest eigenvectors, unit rows, k-means.

    Up to spectral.DENSE rows the matrix is on the driver; above, vectors stay a table and k-means runs on it.
    """
    from vectorloom.functions.numerics import lloyd as local_lloyd
    from vectorloom.operators import spectral as pairs

    edges, nodes = checkpoint(knn_edges(df, key, vector, k)), df.select(F.col(key).cast("long").alias("id"))
    if nodes.count() > pairs.DENSE:
        return _spectral_table(pairs.laplacian_pairs(edges, nodes, n_clusters).vectors, n_clusters, seed).select(F.col("id").alias(key), "cluster")
    ids, lap = laplacian_matrix(edges, nodes, "symmetric")
    _, vectors = np.linalg.eigh(lap)
    x = vectors[:, :n_clusters]
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(length == 0, 1, length)
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < n_clusters:  # farthest-first start
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    labels, _ = local_lloyd(x, np.array(centres))
    return df.sparkSession.createDataFrame([(int(i), int(c)) for i, c in zip(ids, labels)], f"{key} long, cluster long")


def _spectral_table(vectors: DataFrame, n_clusters: int, seed: int, rounds: int = 50) -> DataFrame:
    """(id, cluster) of eigenvectors (id, v): unit rows, farthest-first start, k-means rounds until the centres stay."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = checkpoint(vectors.select("id", F.transform("v", lambda x: x / F.when(length == 0, 1.0).otherwise(length)).alias("v")))
    centres = np.array([rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").first()["v"]])
    while len(centres) < n_clusters:
        far = assign_nearest(rows, "id", "v", centres).agg(F.max(F.struct("d", (-F.col("id")).alias("minus")))).first()[0]
        centres = np.vstack([centres, rows.where(F.col("id") == -far["minus"]).first()["v"]])
    for _ in range(rounds):
        names, found = as_matrix(centroids(rows, "id", "v", assign_nearest(rows, "id", "v", centres)))
        fresh = centres.copy()
        fresh[names] = found
        moved, centres = np.abs(fresh - centres).max(), fresh
        if moved < 1e-9:
            break
    return assign_nearest(rows, "id", "v", centres).select("id", "cluster")


CLUSTERERS: dict[str, Callable[..., DataFrame]] = {
    "kmeans": kmeans,
    "lloyd": lambda df, key, vector, k, iterations=10, seed=42: lloyd(df, key, vector, k, iterations, seed)[0].select(key, "cluster"),
    "dbscan": dbscan,
    "agglomerative": agglomerative,
    "spectral": spectral,
}


def cluster(df: DataFrame, key: str, vector: str, *, clusters: DataFrame | None = None, clusterer: Callable | None = None, method: str | None = None, **options) -> DataFrame:
    """(key, cluster) from exactly one of: a given clustering, a callable, or the name of a known method."""
    if sum(x is not None for x in (clusters, clusterer, method)) != 1:
        raise ValueError("exactly one of clusters, clusterer and method is needed")
    if clusters is not None:
        return clusters.select(key, "cluster")
    if clusterer is not None:
        return clusterer(df, key, vector, **options)
    if method not in CLUSTERERS:
        raise ValueError(f"unknown clusterer {method!r}; known: {', '.join(CLUSTERERS)}")
    return CLUSTERERS[method](df, key, vector, **options)


def random_anchors(df: DataFrame, key: str, vector: str, n: int, seed: int = 42) -> tuple[list[int], np.ndarray, DataFrame]:
    """n hash-sampled rows as anchors (ids in order, matrix) and each row's nearest anchor (Voronoi cells)."""
    rows = sample(df, key, n, seed).select(key, doubles(vector).alias("v")).orderBy(key).collect()
    if len(rows) < n:
        raise ValueError(f"{n} anchors need as many rows; there are {len(rows)}")
    ids, matrix = [r[key] for r in rows], np.array([r["v"] for r in rows])
    return ids, matrix, assign_nearest(df, key, vector, matrix, ids)


@dataclass(frozen=True)
class Prototypes:
    """A fitted prototype space: labels, centroids in the original space, the frame and the whitening, if any."""

    labels: list[int]
    matrix: np.ndarray
    frame: Frame
    whitening: Whitening | None
    assigned: DataFrame

    def represent(self, df: DataFrame, vector: str, out: str = "relative") -> DataFrame:
        """Analysis coordinates of every row."""
        return self.frame.analyse(df, vector, out=out, whitening=self.whitening)


def compute_prototypes(df: DataFrame, key: str, vector: str, *, prewhiten: bool = False, parseval: bool = True, n_samples: int | None = None, seed: int = 42, **clustering) -> Prototypes:
    """Cluster (on whitened vectors if asked, averaging the original ones), average, and build the frame.

    With prewhiten the frame is that of the whitened prototypes.
    """
    whitening = Whitening.fit(df, vector) if prewhiten else None
    space = whitening.whiten(df, vector) if whitening else df
    assigned = cluster(space, key, vector, **clustering)
    labels, matrix = as_matrix(centroids(df, key, vector, assigned, n_samples, seed))
    base = (matrix - whitening.mean) @ whitening.forward if whitening else matrix
    return Prototypes(labels, matrix, Frame.of(base, parseval), whitening, assigned)
