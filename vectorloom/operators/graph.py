"""Neighbour graphs and their metrics.

A graph is a table of edges (src, dst, w) with both directions of every undirected edge, and a table of
nodes (id). Counts, degrees, Laplacian entries, components, spanning forests and their cycles are relational. Weighted
shortest paths run from blocks of sources; matrices hold at most MAX_DENSE nodes. ``signature`` uses tables only above the
size from which ``spectral`` does.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators import blocks
from vectorloom.session import checkpoint, discard

MAX_DENSE = 10_000
KINDS = ("unnormalized", "symmetric", "random_walk")


def knn_edges(df: DataFrame, key: str, vector: str, k: int, mode: str = "union", gaussian: bool = False) -> DataFrame:
    """(src, dst, w) of the k-nearest-neighbour graph, both directions.

    union keeps a pair if either side lists the other, mutual if both do. Weights are 1, or
    exp(-d^2 / (2 sigma^2)) with sigma the mean distance to the k-th neighbour (0 counts as 1).
    """
    if mode not in ("union", "mutual"):
        raise ValueError(f"unknown mode {mode!r}")
    near = blocks.nearest(df, df, key, vector, k, exclude_self=True)
    if gaussian:
        near = checkpoint(near)
        sigma = near.where(F.col("rank") == k - 1).agg(F.avg("d")).first()[0] or 1.0
        near = near.withColumn("w", F.exp(-F.col("d") * F.col("d") / (2.0 * sigma * sigma)))
    else:
        near = near.withColumn("w", F.lit(1.0))
    both = near.select("src", "dst", "w").union(near.select("dst", "src", "w"))
    grouped = both.groupBy("src", "dst").agg(F.max("w").alias("w"), F.count("*").alias("n"))
    return (grouped.where("n = 2") if mode == "mutual" else grouped).select("src", "dst", "w")


def degrees(edges: DataFrame, nodes: DataFrame, weighted: bool = True) -> DataFrame:
    """(id, degree), 0 for isolated nodes."""
    own = edges.groupBy(F.col("src").alias("id")).agg((F.sum("w") if weighted else F.count("*").cast("double")).alias("degree"))
    return nodes.join(own, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def degree_distribution(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(degree, share) for every whole degree from 0 to the largest."""
    counts = degrees(edges, nodes).select(F.floor("degree").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))
    span = counts.agg(F.max("degree").alias("top"), F.sum("n").alias("total")).select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("degree"), "total")
    return span.join(counts, "degree", "left").select("degree", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def laplacian(edges: DataFrame, nodes: DataFrame, kind: str = "unnormalized") -> DataFrame:
    """(i, j, value) of the Laplacian's non-zero entries; nodes of degree 0 have none but in the unnormalised form's zero diagonal."""
    if kind not in KINDS:
        raise ValueError(f"unknown Laplacian {kind!r}; known: {', '.join(KINDS)}")
    deg = degrees(edges, nodes)
    di, dj = deg.select(F.col("id").alias("i"), F.col("degree").alias("di")), deg.select(F.col("id").alias("j"), F.col("degree").alias("dj"))
    off = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w").join(di, "i").join(dj, "j")
    if kind == "unnormalized":
        off, diagonal = off.select("i", "j", (-F.col("w")).alias("value")), di.select("i", F.col("i").alias("j"), F.col("di").alias("value"))
    else:
        scale = F.sqrt(F.col("di") * F.col("dj")) if kind == "symmetric" else F.col("di")
        off = off.select("i", "j", (-F.col("w") / scale).alias("value"))
        diagonal = di.where("di > 0").select("i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
    return diagonal.union(off)


def laplacian_matrix(edges: DataFrame, nodes: DataFrame, kind: str = "unnormalized") -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) on the driver, for at most MAX_DENSE nodes."""
    ids, adjacency = adjacency_matrix(edges, nodes)
    deg = adjacency.sum(1)
    if kind == "unnormalized":
        return ids, np.diag(deg) - adjacency
    safe = np.where(deg > 0, deg, 1)
    if kind == "symmetric":
        root = np.sqrt(safe)
        return ids, np.diag((deg > 0).astype(float)) - adjacency / root[:, None] / root[None]
    return ids, np.diag((deg > 0).astype(float)) - adjacency / safe[:, None]


def adjacency_matrix(edges: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = [r["id"] for r in nodes.select("id").orderBy("id").limit(MAX_DENSE + 1).collect()]
    if len(rows) > MAX_DENSE:
        raise ValueError(f"dense graph operators take at most {MAX_DENSE} nodes")
    place = {v: k for k, v in enumerate(rows)}
    matrix = np.zeros((len(rows), len(rows)))
    found = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double")).toArrow()  # at most the square of the nodes
    src, dst = (np.fromiter((place[x] for x in found.column(c).to_pylist()), dtype=np.int64, count=found.num_rows) for c in ("src", "dst"))
    matrix[src, dst] = found.column("w").to_numpy()
    return np.array(rows), matrix


def smallest_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return values[:k], vectors[:, :k]


def eigengap(values: np.ndarray, k: int) -> float:
    """lambda_k - lambda_(k-1) of the sorted magnitudes (k counted from 0); the last gap if there are fewer."""
    v = np.sort(np.abs(values))
    if len(v) < 2:
        return 0.0
    k = min(k, len(v) - 1)
    return float(v[k] - v[k - 1])


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): smallest node id reachable. Min-label propagation with pointer jumps, checkpointed."""
    both = checkpoint(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    held = labels = checkpoint(nodes.select("id", F.col("id").alias("component")))
    while True:
        seen = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("component").alias("least"))
        lower = labels.join(seen, labels.id == seen.src, "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        fresh = checkpoint(lower.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("further", "component")).alias("component")))
        discard(held)
        held, labels = fresh, fresh.select("id", "component")
        if fresh.where("was <> component").isEmpty():
            discard(both)
            return labels


def _adjacency_lists(edges: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted ids, neighbours and weights by position; at most MAX_DENSE nodes, so its size is bounded."""
    ids, matrix = adjacency_matrix(edges, nodes)
    near = [np.flatnonzero(row) for row in matrix]
    return ids, near, [matrix[k, n] for k, n in enumerate(near)]


def shortest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, d) of all connected ordered pairs; weights are lengths. Sources are dealt over tasks.

    The graph itself is a constant of the tasks, so it may have at most MAX_DENSE nodes.
    """
    ids, near, weights = _adjacency_lists(edges, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {v: k for k, v in enumerate(ids)}
        for batch in batches:
            for source in batch.column(0).to_pylist():
                d = _distances(place[source], near, weights)
                hit = np.flatnonzero(np.isfinite(d) & (np.arange(len(d)) != place[source]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), source), pa.int64()), pa.array(ids[hit], pa.int64()), pa.array(d[hit])], names=["src", "dst", "d"])

    return nodes.select("id").repartition(_tasks(nodes)).mapInArrow(run, "src long, dst long, d double")


def _dijkstra(start: int, near: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    d = np.full(len(near), np.inf)
    d[start] = 0
    heap = [(0.0, start)]
    while heap:
        reached, i = heapq.heappop(heap)
        if reached > d[i]:
            continue
        for j, w in zip(near[i], weights[i]):
            if reached + w < d[j]:
                d[j] = reached + w
                heapq.heappush(heap, (reached + w, j))
    return d


def path_indices(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """wiener, schultz, gutman (unordered sums over connected pairs, weighted degrees) and diameter.

    Each task sums over the paths from its sources, so one row per source is put out instead of one per pair.
    """
    ids, near, weights = _adjacency_lists(edges, nodes)
    degree = np.array([w.sum() for w in weights])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {v: k for k, v in enumerate(ids)}
        for batch in batches:
            rows = []
            for source in batch.column(0).to_pylist():
                own = place[source]
                d = _distances(own, near, weights)
                hit = np.isfinite(d)
                d, other = d[hit], degree[hit]
                rows.append((d.sum(), ((degree[own] + other) * d).sum(), (degree[own] * other * d).sum(), d.max(initial=0.0)))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], names=["wiener", "schultz", "gutman", "diameter"])

    sums = nodes.select("id").repartition(_tasks(nodes)).mapInArrow(run, "wiener double, schultz double, gutman double, diameter double")
    half = lambda c: F.coalesce(F.sum(c) / 2, F.lit(0.0)).alias(c)
    return sums.agg(half("wiener"), half("schultz"), half("gutman"), F.coalesce(F.max("diameter"), F.lit(0.0)).alias("diameter"))


def _tasks(nodes: DataFrame) -> int:
    return nodes.sparkSession.sparkContext.defaultParallelism * 2


def _distances(start: int, near: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Distances from a node: by levels if all weights are 1, else by Dijkstra's algorithm."""
    if any((w != 1).any() for w in weights):
        return _dijkstra(start, near, weights)
    d = np.full(len(near), np.inf)
    d[start], level, front = 0, 0, np.array([start])
    while len(front):
        level += 1
        front = np.unique(np.concatenate([near[i] for i in front]))
        front = front[np.isinf(d[front])]
        d[front] = level
    return d


def disorder(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sum over edges of the difference of unweighted degrees."""
    deg = degrees(edges, nodes, weighted=False)
    a, b = deg.select(F.col("id").alias("src"), F.col("degree").alias("p")), deg.select(F.col("id").alias("dst"), F.col("degree").alias("q"))
    return edges.where("src < dst").join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(F.abs(F.col("p") - F.col("q"))), F.lit(0.0)).alias("disorder"))


def counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_nodes, n_edges, connected_components, number_of_cycles (m - n + c) and density, in one row."""
    one = F.lit(1).alias("u")
    n = nodes.agg(F.count("*").alias("n_nodes")).withColumn("u", F.lit(1))
    m = edges.where("src < dst").agg(F.count("*").alias("n_edges")).withColumn("u", F.lit(1))
    c = connected_components(edges, nodes).agg(F.countDistinct("component").alias("connected_components")).select("*", one)
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return n.join(m, "u").join(c, "u").select(
        "n_nodes",
        "n_edges",
        "connected_components",
        (F.col("n_edges") - F.col("n_nodes") + F.col("connected_components")).alias("number_of_cycles"),
        F.when(pairs > 0, 2.0 * F.col("n_edges") / pairs).otherwise(F.lit(0.0)).alias("density"),
    )


def square_clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, c4): squares through a node over possible ones, by pairs of neighbours.

    For neighbours u < w of v: q is the number of their common neighbours other than v, theta 1 if they are
    linked; c4 = sum q / sum (q + (deg u - 1 - q - theta) + (deg w - 1 - q - theta)). The second sum is
    (deg v - 1) * sum of the neighbours' degrees - sum q - deg v * (deg v - 1) - 2 * triangles at v, so only
    squares and triangles are counted. Each is found once, from its node of highest (degree, id), along paths
    v - u - x to lower ones: a hub is the middle of paths from still larger hubs only.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    own = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    ranked = lambda c: own.select(F.col("id").alias(c), F.struct("deg", "id").alias(f"r_{c}"))
    placed = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(ranked("a"), "a").join(ranked("b"), "b")
    down = placed.where("r_b < r_a")
    first = down.select(F.col("a").alias("v"), F.col("r_a").alias("r_v"), F.col("b").alias("u"))
    paths = first.join(placed.select(F.col("a").alias("u"), F.col("b").alias("x"), "r_b"), "u").where("r_b < r_v").select("v", "u", "x")
    paths = checkpoint(paths)  # read by three of the sums below
    common = paths.groupBy("v", "x").agg(F.count("*").alias("c")).where("c > 1")
    square = (F.col("c") * (F.col("c") - 1) / 2).alias("n")
    squares = common.select(F.col("v").alias("id"), square).union(common.select("x", square))
    squares = squares.union(paths.join(common, ["v", "x"]).select("u", (F.col("c") - 1).cast("double")))
    closed = paths.join(down.select(F.col("a").alias("v"), F.col("b").alias("x")), ["v", "x"])
    triangles = closed.select(F.col("v").alias("id"), F.lit(0.5).alias("n")).union(closed.select("u", F.lit(1.0)))
    total = lambda rows, name: rows.groupBy("id").agg(F.sum("n").alias(name))
    around = placed.groupBy(F.col("a").alias("id")).agg(F.sum("r_b.deg").alias("around"), F.first("r_a.deg").alias("deg"))
    full = nodes.select("id").join(around, "id", "left").join(total(squares, "q"), "id", "left").join(total(triangles, "t"), "id", "left").na.fill(0)
    possible = (F.col("deg") - 1) * F.col("around") - F.col("q") - F.col("deg") * (F.col("deg") - 1) - 2 * F.col("t")
    return full.select("id", F.when(possible > 0, F.col("q") / possible).otherwise(F.lit(0.0)).alias("c4"))


def minimum_spanning_tree(ids: np.ndarray, edges: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Kruskal's tree in (weight, u, v) order."""
    root = {int(i): int(i) for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree = []
    for w, u, v in sorted(edges):
        a, b = find(u), find(v)
        if a != b:
            root[a] = b
            tree.append((w, u, v))
    return tree


def mean_cycle_length(edges: DataFrame, nodes: DataFrame) -> float:
    """Mean length (in edges) of the fundamental cycles of a minimum spanning forest; 0 without cycles."""
    ids, matrix = adjacency_matrix(edges, nodes)
    listed = [(float(matrix[i, j]), int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(matrix)))]
    tree = minimum_spanning_tree(np.arange(len(ids)), listed)
    near: list[list[int]] = [[] for _ in ids]
    for _, u, v in tree:
        near[u].append(v)
        near[v].append(u)
    parent, depth = [-1] * len(ids), [-1] * len(ids)
    for start in range(len(ids)):
        if depth[start] >= 0:
            continue
        depth[start], queue = 0, [start]
        for u in queue:
            for v in near[u]:
                if depth[v] < 0:
                    parent[v], depth[v] = u, depth[u] + 1
                    queue.append(v)
    lengths = []
    for _, u, v in set(listed) - set(tree):
        a, b, steps = u, v, 1
        while a != b:
            if depth[a] < depth[b]:
                a, b = b, a
            a, steps = parent[a], steps + 1
        lengths.append(steps)
    return float(np.mean(lengths)) if lengths else 0.0


def spanning_forest(listed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, w) of the minimum spanning forest of edges (u, v, w), and the nodes' (id, component), smallest id in it.

    The order (w, u, v) has no ties, so the forest is Kruskal's. Rounds of Boruvka: every component takes its first edge to
    another one, and components that hang together by these become one, so a round halves their number at least.
    """
    labels, rest, taken = checkpoint(nodes.select("id", F.col("id").alias("component")).distinct()), listed, []
    held = None
    while True:
        of = lambda c, name: labels.select(F.col("id").alias(c), F.col("component").alias(name))
        rest = checkpoint(rest.select("u", "v", "w").join(of("u", "cu"), "u").join(of("v", "cv"), "v").where("cu <> cv"))
        if held is not None:
            discard(held)
        held = rest
        sides = [rest.select(F.col(c).alias("c"), F.struct("w", "u", "v", F.col(o).alias("other")).alias("e")) for c, o in (("cu", "cv"), ("cv", "cu"))]
        first = checkpoint(sides[0].union(sides[1]).groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"))
        taken.append(first.select("u", "v", "w"))
        if first.isEmpty():
            break
        met = connected_components(first.select(F.col("c").alias("src"), F.col("other").alias("dst")), first.select(F.col("c").alias("id")))
        fresh = checkpoint(labels.join(met.select(F.col("id").alias("component"), F.col("component").alias("into")), "component", "left").select("id", F.coalesce("into", "component").alias("component")))
        discard(labels)
        labels = fresh
    discard(held)
    forest = checkpoint(functools.reduce(DataFrame.union, taken).distinct())
    return forest, labels


def rooted(forest: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(id, parent, depth) of a forest's nodes below the smallest id of each tree (its own parent), and the largest depth.

    Level by level: a level joins the nodes of the last one with the edges, and there are as many as the forest is deep.
    """
    both = checkpoint(forest.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(forest.select("v", "u")))
    level = checkpoint(labels.where("id = component").select("id", F.col("id").alias("parent"), F.lit(0).alias("depth")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        below = level.select(F.col("id").alias("src"), "parent").join(both, "src").where("dst <> parent")
        level = checkpoint(below.select(F.col("dst").alias("id"), F.col("src").alias("parent"), F.lit(len(levels)).alias("depth")))
    placed = checkpoint(functools.reduce(DataFrame.union, levels, level))
    for made in (both, level, *levels):
        discard(made)
    return placed, max(0, len(levels) - 1)


def fundamental_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, length): the fundamental cycle, in edges, of each edge outside the minimum spanning forest.

    The two ends climb to their first common node in steps of halving size, each by a join with the nodes' ancestors so far up.
    """
    listed = checkpoint(edges.where("src <= dst and w <> 0").groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.max("w").alias("w")))
    forest, labels = spanning_forest(listed, nodes)
    placed, deep = rooted(forest, labels)
    up = [placed.select("id", F.col("parent").alias("to"))]
    for _ in range(deep.bit_length() - 1):
        last = up[-1]
        up.append(checkpoint(last.join(last.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to"))))
    at = lambda c: placed.select(F.col("id").alias(c), F.col("depth").alias(f"d{c}"))
    pairs = listed.join(forest, ["u", "v"], "left_anti").select("u", "v").join(at("u"), "u").join(at("v"), "v")
    lower = F.col("du") >= F.col("dv")
    pairs = pairs.select("u", "v", F.when(lower, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(lower, F.col("v")).otherwise(F.col("u")).alias("b"), F.abs(F.col("du") - F.col("dv")).alias("gap"))
    pairs = held = checkpoint(pairs.withColumn("length", F.col("gap") + 1))
    climbs = [(k, False) for k in range(len(up))] + [(k, True) for k in reversed(range(len(up)))]
    for k, together in climbs:
        to = lambda c, k=k: up[k].select(F.col("id").alias(c), F.col("to").alias(f"up_{c}"))
        if together:
            moves = F.col("up_a") != F.col("up_b")
            moved = pairs.join(to("a"), "a").join(to("b"), "b").select("u", "v", F.when(moves, F.col("up_a")).otherwise(F.col("a")).alias("a"), F.when(moves, F.col("up_b")).otherwise(F.col("b")).alias("b"), "gap", (F.col("length") + F.when(moves, 2 << k).otherwise(0)).alias("length"))
        else:
            moves = F.expr(f"(gap >> {k}) % 2 = 1")
            moved = pairs.join(to("a"), "a").select("u", "v", F.when(moves, F.col("up_a")).otherwise(F.col("a")).alias("a"), "b", "gap", "length")
        pairs = checkpoint(moved)
        discard(held)
        held = pairs
    for made in (listed, forest, labels, placed, *up[1:]):
        discard(made)
    # both ends are below their first common node by one step, unless one was the other's ancestor
    return pairs.select("u", "v", (F.col("length") + F.when(F.col("a") != F.col("b"), 2).otherwise(0)).cast("long").alias("length"))


def girth(edges: DataFrame, nodes: DataFrame) -> float:
    """Length of the shortest cycle, infinite for a forest; breadth-first from every node."""
    ids, near, _ = _adjacency_lists(edges, nodes)
    best = np.inf
    for start in range(len(ids)):
        depth, parent, queue = {start: 0}, {start: -1}, [start]
        for u in queue:
            if 2 * depth[u] + 1 >= best:
                break
            for v in near[u]:
                v = int(v)
                if v not in depth:
                    depth[v], parent[v] = depth[u] + 1, u
                    queue.append(v)
                elif parent[u] != v:
                    best = min(best, depth[u] + depth[v] + 1)
    return float(best)


def signature(edges: DataFrame, nodes: DataFrame, k: int = 1) -> dict[str, object]:
    """All graph metrics as one record; girth is null for a forest.

    Above spectral.DENSE nodes no matrix or list of neighbours is made, but for the paths of a graph with weights other than 1.
    """
    from vectorloom.operators import hops, spectral

    edges, nodes = checkpoint(edges), checkpoint(nodes.select("id"))
    large = nodes.count() > spectral.DENSE
    paths = hops.path_sums if large and edges.where("w <> 1").isEmpty() else path_indices
    row = counts(edges, nodes).first().asDict() | paths(edges, nodes).first().asDict() | disorder(edges, nodes).first().asDict()
    row["square_clustering"] = square_clustering(edges, nodes).agg(F.avg("c4")).first()[0] or 0.0
    if large:
        row["cycle_length"] = float(fundamental_cycles(edges, nodes).agg(F.avg("length")).first()[0] or 0.0)
        row["girth"] = hops.girth(edges, nodes)
        row["eigengap"] = eigengap(spectral.laplacian_pairs(edges, nodes, k + 1).values, k)
    else:
        row["cycle_length"] = mean_cycle_length(edges, nodes)
        shortest = girth(edges, nodes)
        row["girth"] = None if np.isinf(shortest) else shortest
        row["eigengap"] = eigengap(np.linalg.eigvalsh(laplacian_matrix(edges, nodes, "symmetric")[1]), k)
    row["degree_distribution"] = [r["share"] for r in degree_distribution(edges, nodes).orderBy("degree").collect()]
    return row


def spectral_layout(edges: DataFrame, nodes: DataFrame, dims: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """ids and coordinates from the Laplacian's eigenvectors after the first, signs fixed."""
    from vectorloom.functions.numerics import fix_signs

    ids, lap = laplacian_matrix(edges, nodes, "symmetric")
    return ids, fix_signs(smallest_eigenpairs(lap, dims + 1)[1][:, 1:])


def k_lowest_edges(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs (model_a, model_b, distance) of smallest distance, ties by name."""
    return pairs.orderBy("distance", "model_a", "model_b").limit(k)


def distance_layout(pairs: DataFrame, method: str = "mds", seed: int = 42) -> list[tuple[str, float, float]]:
    """Coordinates of the names in a distance table: classical MDS, circular or random.

    Pairs that are missing count as the largest distance; unknown methods raise.
    """
    if method not in ("mds", "circular", "random"):
        raise ValueError(f"unknown layout {method!r}")
    rows = pairs.select("model_a", "model_b", "distance").collect()
    names = sorted({r[c] for r in rows for c in ("model_a", "model_b")})
    n = len(names)
    if method == "circular":
        angle = 2 * np.pi * np.arange(n) / max(1, n)
        xy = np.column_stack([np.cos(angle), np.sin(angle)])
    elif method == "random":
        xy = np.random.default_rng(seed).uniform(-1, 1, (n, 2))
    else:
        place = {v: k for k, v in enumerate(names)}
        d = np.full((n, n), max((r["distance"] for r in rows), default=0.0))
        np.fill_diagonal(d, 0)
        for r in rows:
            i, j = place[r["model_a"]], place[r["model_b"]]
            d[i, j] = d[j, i] = r["distance"]
        centre = np.eye(n) - 1 / max(1, n)
        values, vectors = np.linalg.eigh(-centre @ (d**2) @ centre / 2)
        xy = np.zeros((n, 2))
        top = vectors[:, ::-1][:, :2] * np.sqrt(np.maximum(values[::-1][:2], 0))
        xy[:, : top.shape[1]] = top
    return [(name, float(x), float(y)) for name, (x, y) in zip(names, xy)]


def row_ids(df: DataFrame, *order: str) -> DataFrame:
    """A running id from 0 in the given order; rows that are equal in it get theirs in any order.

    Rows are dealt by ranges of the order and counted per range, so no task sorts the whole table.
    """
    placed = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n")).collect()  # one row per range
    offsets, before = [], 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        offsets.append((r["_range"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(offsets, "_range int, _start long")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(starts), "_range").withColumn("id", F.col("_start") + number - 1).drop("_range", "_start")
