"""Overlap of two clusterings and the matching of their clusters.

A clustering is a table (id, cluster). The Jaccard table has a row for every pair of clusters; its size is
the product of two cluster counts, which are parameters of the clusterings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.numerics import assignment, lloyd
from vectorloom.operators.graph import connected_components


def jaccard_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ca, cb, j) for all pairs of clusters, 0 where they share no id."""
    one = F.lit(1).alias("u")
    na = a.groupBy(F.col("cluster").alias("ca")).agg(F.count("*").alias("na")).select("*", one)
    nb = b.groupBy(F.col("cluster").alias("cb")).agg(F.count("*").alias("nb")).select("*", one)
    shared = a.select("id", F.col("cluster").alias("ca")).join(b.select("id", F.col("cluster").alias("cb")), "id").groupBy("ca", "cb").agg(F.count("*").alias("both"))
    full = na.join(nb, "u").join(shared, ["ca", "cb"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return full.select("ca", "cb", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("j"))


def jaccard_sets(a: set, b: set) -> float:
    """Intersection over union, 0 for two empty sets."""
    return len(a & b) / len(a | b) if a or b else 0.0


def scores(matrix: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best-match mean, good-match ratio, precision, recall, F1 at a threshold, and mean row entropy."""
    eps = F.lit(1e-10)
    rows = matrix.groupBy("ca").agg(F.max("j").alias("best"), F.sum("j").alias("total"))
    cols = matrix.groupBy("cb").agg(F.max("j").alias("best"))
    by_row = rows.agg(F.avg("best").alias("jaccard_mean"), F.avg((F.col("best") >= threshold).cast("double")).alias("precision"), F.lit(1).alias("u"))
    by_col = cols.agg(F.avg((F.col("best") >= threshold).cast("double")).alias("recall"), F.lit(1).alias("u"))
    p = F.col("j") / (F.col("total") + eps)
    entropy = matrix.join(rows.select("ca", "total"), "ca").groupBy("ca").agg((-F.sum(p * F.ln(p + eps))).alias("h")).agg(F.avg("h").alias("entropy"), F.lit(1).alias("u"))
    full = by_row.join(by_col, "u").join(entropy, "u")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return full.select("jaccard_mean", F.col("precision").alias("good_ratio"), "precision", "recall", f1.alias("f1"), "entropy")


def dense(matrix: DataFrame) -> tuple[list, list, np.ndarray]:
    """Row labels, column labels and the matrix on the driver; cells number ca x cb."""
    cells = matrix.collect()
    rows, cols = sorted({r["ca"] for r in cells}), sorted({r["cb"] for r in cells})
    at, bt = {v: k for k, v in enumerate(rows)}, {v: k for k, v in enumerate(cols)}
    out = np.zeros((len(rows), len(cols)))
    for r in cells:
        out[at[r["ca"]], bt[r["cb"]]] = r["j"]
    return rows, cols, out


def hungarian_score(matrix: DataFrame) -> float:
    """Mean Jaccard index over the best one-to-one assignment."""
    _, _, j = dense(matrix)
    rows, cols = assignment(-j)
    return float(j[rows, cols].mean()) if len(rows) else 0.0


def hungarian_permutation(matrix: DataFrame) -> dict:
    """Cluster of a -> cluster of b in the best assignment."""
    a, b, j = dense(matrix)
    return {a[r]: b[c] for r, c in zip(*assignment(-j))}


Group = tuple[list, list, float]


def _groups_by_hungarian(matrix: DataFrame, threshold: float = 0.0, **_) -> list[Group]:
    a, b, j = dense(matrix)
    return [([a[r]], [b[c]], float(j[r, c])) for r, c in zip(*assignment(-j)) if j[r, c] >= threshold]


def component_groups(matrix: DataFrame, threshold: float) -> DataFrame:
    """(component, side, cluster) of the bipartite graph of cells above the threshold; both sides must occur."""
    edges = matrix.where(F.col("j") > threshold)
    ids = lambda c, offset: (F.col(c).cast("long") * 2 + offset)
    links = edges.select(ids("ca", 0).alias("src"), ids("cb", 1).alias("dst"))
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    roots = connected_components(links, nodes)
    return roots.select("component", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("side"), F.shiftright("id", 1).alias("cluster"))


def _groups_by_components(matrix: DataFrame, threshold: float = 0.3, **_) -> list[Group]:
    _, _, j = dense(matrix)
    a, b, _ = dense(matrix)
    at, bt = {v: k for k, v in enumerate(a)}, {v: k for k, v in enumerate(b)}
    members: dict[int, tuple[list, list]] = {}
    for r in component_groups(matrix, threshold).collect():
        members.setdefault(r["component"], ([], []))[r["side"] == "b"].append(r["cluster"])
    out = []
    for rows, cols in members.values():
        rows, cols = sorted(rows), sorted(cols)
        out.append((rows, cols, float(j[np.ix_([at[r] for r in rows], [bt[c] for c in cols])].mean())))
    return out


def _groups_by_spectrum(matrix: DataFrame, threshold: float = 0.0, max_groups: int | None = None, **_) -> list[Group]:
    a, b, j = dense(matrix)
    n, m = j.shape
    full = np.zeros((n + m, n + m))
    full[:n, n:], full[n:, :n] = j, j.T
    deg = full.sum(1)
    root = np.sqrt(np.where(deg > 0, deg, 1))
    values, vectors = np.linalg.eigh(np.eye(n + m) - full / root[:, None] / root[None])
    most = min(max_groups or min(n, m), n + m - 1)
    k = int(np.argmax(np.diff(values[: most + 1]))) + 1
    x = vectors[:, :k]
    x = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    centres = [x[0]]
    while len(centres) < k:
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    labels, _ = lloyd(x, np.array(centres))
    out = []
    for g in range(k):
        rows, cols = np.flatnonzero(labels[:n] == g), np.flatnonzero(labels[n:] == g)
        if len(rows) and len(cols):
            score = float(j[np.ix_(rows, cols)].mean())
            if score >= threshold:
                out.append(([a[r] for r in rows], [b[c] for c in cols], score))
    return out


def _groups_by_modularity(matrix: DataFrame, threshold: float = 0.0, **_) -> list[Group]:
    """Greedy modularity moves (the local phase of Louvain) on the bipartite graph."""
    a, b, j = dense(matrix)
    n, m = j.shape
    full = np.zeros((n + m, n + m))
    full[:n, n:], full[n:, :n] = np.where(j > threshold, j, 0), np.where(j > threshold, j, 0).T
    deg, total = full.sum(1), full.sum()
    label = np.arange(n + m)
    moved = total > 0
    while moved:
        moved = False
        for i in range(n + m):
            near = np.unique(label[full[i] > 0])
            own = label[i]
            label[i] = -1
            gain = lambda c: full[i, label == c].sum() - deg[i] * deg[label == c].sum() / total  # noqa: B023, E731
            best = max([own, *near], key=lambda c: (round(gain(c), 12), c == own))
            label[i] = best
            moved |= best != own
    out = []
    for g in np.unique(label):
        rows, cols = np.flatnonzero(label[:n] == g), np.flatnonzero(label[n:] == g)
        if len(rows) and len(cols):
            out.append(([a[r] for r in rows], [b[c] for c in cols], float(j[np.ix_(rows, cols)].mean())))
    return out


METHODS: dict[str, Callable[..., list[Group]]] = {
    "hungarian": _groups_by_hungarian,
    "components": _groups_by_components,
    "spectral": _groups_by_spectrum,
    "modularity": _groups_by_modularity,
}


def match(matrix: DataFrame, method: str = "hungarian", **options) -> list[Group]:
    """[(clusters of a, clusters of b, score)], best first; unknown methods raise."""
    if method not in METHODS:
        raise ValueError(f"unknown matching method {method!r}; known: {', '.join(METHODS)}")
    return sorted(METHODS[method](matrix, **options), key=lambda g: (-g[2], g[0]))


def all_scores(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> dict[str, float]:
    """Every overlap score as one record."""
    matrix = jaccard_matrix(a, b).cache()
    try:
        return scores(matrix, threshold).first().asDict() | {"hungarian": hungarian_score(matrix)}
    finally:
        matrix.unpersist()


def match_edges(matrix: DataFrame, threshold: float) -> DataFrame:
    """Edges to draw: cells above the threshold with opacity 0.2 + 0.8 j and width max(0.5, 8 j)."""
    return matrix.where(F.col("j") > threshold).select("ca", "cb", "j", (0.2 + 0.8 * F.col("j")).alias("alpha"), F.greatest(F.lit(0.5), 8 * F.col("j")).alias("width"))


def best_partner(matrix: DataFrame) -> DataFrame:
    """(ca, cb, j): each row's best column, the smaller label of equals."""
    order = Window.partitionBy("ca").orderBy(F.desc("j"), "cb")
    return matrix.withColumn("place", F.row_number().over(order)).where("place = 1").select("ca", "cb", "j")


def k_sweep(a: DataFrame, b: DataFrame, key: str, vector_a: str, vector_b: str, ks: list[int], iterations: int = 5, threshold: float = 0.5) -> list[dict]:
    """Scores of both tables clustered into k groups, and FOSCTTM of their prototypes, for each k."""
    from vectorloom.operators import distances, prototypes

    out = []
    for k in ks:
        left, _ = prototypes.lloyd(a, key, vector_a, k, iterations)
        right, _ = prototypes.lloyd(b, key, vector_b, k, iterations)
        record = {"k": k} | all_scores(left.withColumnRenamed(key, "id"), right.withColumnRenamed(key, "id"), threshold)
        pa_ = prototypes.prototype_vectors(prototypes.centroids(a, key, vector_a, left)).withColumnRenamed("cluster", "id")
        pb_ = prototypes.prototype_vectors(prototypes.centroids(b, key, vector_b, left)).withColumnRenamed("cluster", "id")
        record["foscttm_prototypes"] = distances.foscttm(pa_, pb_, "id", "v").first()["score"]
        out.append(record)
    return out
