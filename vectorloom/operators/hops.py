"""All hop distances of a graph at once, sources as bits of longs, and what follows from them.

Sources are numbered; each group of 64 has one bit a source. The state is a table (grp, id, seen, front): which sources
of the group have reached the node, and which did in the last level. A level sends fronts along the edges, joins them
with ``bit_or`` per group and node, with partial results in each task, and takes off what was seen. The sums take
``WORDS`` longs a row, so that a row's keys are moved once for 512 sources, and keep nothing that only the girth needs. Sums over pairs
come from bit counts, so no pair is ever a row: wiener and schultz from plain ones, gutman from one count for
each binary digit of the sources' degrees.

Where a task can hold the edges, at most ``EDGES`` of them, the sums come from groups of sources that each take all edges and search
in arrays of bits, STATE bytes of them; groups go through in passes of at most ``COPIES`` copied edges.

Else the graph is in no single place, and never in a closure or on the driver. As all pairs are asked for, the state has nodes * nodes bits seen and
as many in front; groups go through in passes of at most ``ROWS`` longs of each, each level of a pass is a table. What a
pass holds on disk, two states and the fronts sent along the edges, is thus bounded by ROWS and the mean degree, whatever the
number of nodes; the number of passes grows with its square.

The shortest cycle shows when two fronts of one source meet: at level d two ends of an edge (length 2d + 1) or two
ways into a node (2d + 2). Sources on a shortest cycle see it first, and others see no shorter one.

Edge cases: edges (src, dst) stand in both directions; loops and repeated edges are passed over; nodes without edges
have no paths; without edges all sums are 0 and the girth is null.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.graph import row_ids
from vectorloom.session import checkpoint, discard

ROWS, WORDS = 16_000_000, 8
EDGES, STATE, COPIES, GATHERED = 8_000_000, 64 << 20, 200_000_000, 1 << 20


def _simple(edges: DataFrame) -> DataFrame:
    return checkpoint(edges.where("src <> dst").select("src", "dst").distinct())


def _numbered(nodes: DataFrame, words: int = 1) -> DataFrame:
    """(id, grp, word, bit) of all nodes as sources, ``words`` * 64 in a group."""
    numbered = row_ids(nodes.select(F.col("id").alias("node")).distinct(), "node").select(F.col("node").alias("id"), F.col("id").alias("number"))
    return checkpoint(numbered.select("id", F.expr(f"number div {64 * words}").alias("grp"), F.expr(f"number div 64 % {words}").alias("word"), F.expr("shiftleft(1L, cast(number % 64 as int))").alias("bit")))


def _passes(sources: DataFrame, words: int = 1) -> list[tuple[int, int]]:
    """Ranges of groups whose states stay below ROWS longs, one group at least."""
    row = sources.agg(F.count("*").alias("n"), F.max("grp").alias("top")).first()
    if not row["n"]:
        return []
    step = max(1, ROWS // (words * row["n"]))
    return [(a, min(a + step, row["top"] + 1)) for a in range(0, row["top"] + 1, step)]


def _level(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(grp, id, seen, front, fresh count, ways into fresh ones, met): the state after one more level.

    ways counts the bits that come in and were not seen before this level; more ways than fresh bits mean that a
    source comes in twice. met: bits whose front held this very node.
    """
    sent = state.where("front <> 0").select("grp", F.col("id").alias("src"), "front").join(edges, "src").select("grp", F.col("dst").alias("id"), F.col("front").alias("got"))
    # the node's own state meets what comes in by a join on (grp, id); unreached nodes have none yet
    placed = sent.join(state.select("grp", "id", "seen", F.col("front").alias("held")), ["grp", "id"], "left")
    new = F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0))))
    met = F.col("got").bitwiseAND(F.coalesce("held", F.lit(0)))
    reached = placed.select("grp", "id", new.alias("new"), met.alias("met")).groupBy("grp", "id")
    reached = reached.agg(F.bit_or("new").alias("new"), F.sum(F.bit_count("new")).alias("ways"), F.bit_or("met").alias("met"))
    return state.select("grp", "id", "seen").join(reached, ["grp", "id"], "full").select(
        "grp", "id", F.coalesce("seen", F.lit(0)).bitwiseOR(F.coalesce("new", F.lit(0))).alias("seen"), F.coalesce("new", F.lit(0)).alias("front"),
        F.coalesce("ways", F.lit(0)).alias("ways"), F.coalesce("met", F.lit(0)).alias("met"),
    )


def _levels(edges: DataFrame, sources: DataFrame):
    """(level, state) of one pass until no front is left; each state is deleted when the next is asked for."""
    state = checkpoint(sources.select("grp", "id", F.col("bit").alias("seen"), F.col("bit").alias("front"), F.lit(0).cast("long").alias("ways"), F.lit(0).cast("long").alias("met")))
    level = 0
    while True:
        fresh = checkpoint(_level(edges, state))
        discard(state)
        state, level = fresh, level + 1
        try:
            yield level, state
        except GeneratorExit:
            discard(state)
            raise
        if state.where("front <> 0").isEmpty():
            discard(state)
            return


def _wide_level(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(grp, id, s0, .., f0, ..), words seen and words of the front, after one more level."""
    seen, front = [f"s{w}" for w in range(WORDS)], [f"f{w}" for w in range(WORDS)]
    any_front = functools.reduce(Column.bitwiseOR, map(F.col, front)) != 0
    sent = state.where(any_front).select("grp", F.col("id").alias("src"), *front).join(edges, "src")
    got = sent.groupBy("grp", F.col("dst").alias("id")).agg(*[F.bit_or(c).alias(c) for c in front])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    new = [zero(f).bitwiseAND(F.bitwise_not(zero(s))) for s, f in zip(seen, front)]
    return state.select("grp", "id", *seen).join(got, ["grp", "id"], "full").select("grp", "id", *[zero(s).bitwiseOR(zero(f)).alias(s) for s, f in zip(seen, front)], *[n.alias(f) for n, f in zip(new, front)])


def _wide_levels(edges: DataFrame, sources: DataFrame):
    """(level, rows of the state that have a front) of one pass until there is none; each state is deleted when the next is asked for."""
    start = [F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long")) for w in range(WORDS)]
    state = checkpoint(sources.select("grp", "id", *[b.alias(f"s{w}") for w, b in enumerate(start)], *[b.alias(f"f{w}") for w, b in enumerate(start)]))
    any_front = functools.reduce(Column.bitwiseOR, [F.col(f"f{w}") for w in range(WORDS)]) != 0
    level = 0
    while True:
        fresh = checkpoint(_wide_level(edges, state))
        discard(state)
        state, level = fresh, level + 1
        reached = state.where(any_front)
        if reached.isEmpty():
            discard(state)
            return
        yield level, reached


def _weighed(bits: Column, planes: list[str]) -> Column:
    """Sum of the degrees of the sources whose bits are set, by the planes of the degrees' digits."""
    total = F.lit(0).cast("long")
    for p, plane in enumerate(planes):
        total = total + F.bit_count(bits.bitwiseAND(F.col(plane))).cast("long") * (1 << p)
    return total


def path_sums(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """wiener, schultz, gutman (unordered sums over connected pairs) and diameter of an unweighted graph, in one row."""
    simple = _simple(edges)
    if simple.count() <= EDGES:
        return _searched(simple, nodes)
    degree = checkpoint(nodes.select("id").distinct().join(simple.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").na.fill(0))
    sources = _numbered(nodes, WORDS)
    digits = max(1, int(degree.agg(F.max("degree")).first()[0] or 0).bit_length())
    planes = [[f"plane{p}_{w}" for p in range(digits)] for w in range(WORDS)]
    digit = lambda p, w: F.bit_or(F.when(F.expr(f"word = {w} AND (degree >> {p}) % 2 = 1"), F.col("bit")).otherwise(F.lit(0)))
    of_groups = sources.join(degree, "id").groupBy("grp").agg(*[digit(p, w).alias(c) for w, own in enumerate(planes) for p, c in enumerate(own)])
    of_groups = checkpoint(of_groups)
    totals = {"wiener": 0, "schultz": 0, "gutman": 0, "diameter": 0}
    fronts = [F.col(f"f{w}") for w in range(WORDS)]
    pairs = functools.reduce(Column.__add__, [F.bit_count(f).cast("long") for f in fronts])
    weighed = functools.reduce(Column.__add__, [_weighed(f, own) for f, own in zip(fronts, planes)])
    for a, b in _passes(sources, WORDS):
        for level, reached in _wide_levels(simple, sources.where((F.col("grp") >= a) & (F.col("grp") < b))):
            ends = reached.join(degree, "id").join(of_groups, "grp")
            # a sum over ordered pairs counts each end once, so both ends' degrees in schultz are one end's here
            row = ends.agg(F.sum(pairs), F.sum(pairs * F.col("degree")), F.sum(weighed * F.col("degree"))).first()
            if row[0]:
                totals["wiener"] += level * row[0]
                totals["schultz"] += level * row[1]
                totals["gutman"] += level * row[2]
                totals["diameter"] = max(totals["diameter"], level)
    for made in (simple, degree, sources, of_groups):
        discard(made)
    found = (totals["wiener"] / 2, float(totals["schultz"]), totals["gutman"] / 2, float(totals["diameter"]))
    return edges.sparkSession.createDataFrame([found], "wiener double, schultz double, gutman double, diameter double")


def _searched(simple: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same row from groups of sources that hold all edges."""
    spark = simple.sparkSession
    numbers = checkpoint(row_ids(nodes.select(F.col("id").alias("node")).distinct(), "node"))
    n, m = numbers.count(), simple.count()
    of = lambda c: numbers.select(F.col("node").alias(c), F.col("id").cast("int").alias(f"{c}_number"))
    edges = checkpoint(simple.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_number").alias("s"), F.col("dst_number").alias("d")))
    # as many sources as the state allows, fewer where that leaves cores idle
    most = -(-n // (2 * spark.sparkContext.defaultParallelism))
    size = 64 * max(1, min(-(-most // 64), STATE // (8 * max(1, n))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("d", "ascending"), ("s", "ascending")])
        first = key[0].as_py() * size
        found = _from_sources(table.column("s").to_numpy(), table.column("d").to_numpy(), n, first, min(size, n - first))
        return pa.table({c: pa.array([v], pa.int64()) for c, v in zip(("wiener", "schultz", "gutman", "diameter"), found)})

    groups, step = -(-n // size), max(1, COPIES // max(1, m))
    rows = []
    for a in range(0, groups if m else 0, step):
        b = min(a + step, groups)
        copied = edges.withColumn("g", F.explode(F.sequence(F.lit(a), F.lit(b - 1)))).repartition(b - a, "g").groupBy("g")
        done = checkpoint(copied.applyInArrow(run, "wiener long, schultz long, gutman long, diameter long"))
        rows += done.collect()  # one a group
        discard(done)
    for made in (simple, numbers, edges):
        discard(made)
    total = lambda c: sum(r[c] for r in rows)
    found = (total("wiener") / 2, float(total("schultz")), total("gutman") / 2, float(max((r["diameter"] for r in rows), default=0)))
    return spark.createDataFrame([found], "wiener double, schultz double, gutman double, diameter double")


def _from_sources(src: np.ndarray, dst: np.ndarray, n: int, first: int, count: int) -> tuple[int, int, int, int]:
    """Sums over ordered pairs from ``count`` sources: lengths, lengths by the other end's degree, by both degrees; and the longest.

    Edges are sorted by dst. A node has a bit a source, of those that reached it and of those that did in the last level.
    """
    degree = np.bincount(dst, minlength=n)
    k = np.arange(count)
    own = degree[first : first + count]
    words = -(-count // 64)
    bit = np.left_shift(np.uint64(1), (k % 64).astype(np.uint64))
    planes = np.zeros((max(1, int(own.max(initial=0)).bit_length()), words), dtype=np.uint64)
    for p, plane in enumerate(planes):
        np.bitwise_or.at(plane, k // 64, np.where(own >> p & 1, bit, np.uint64(0)))
    seen = np.zeros((n, words), dtype=np.uint64)
    seen[first + k, k // 64] = bit
    front, ids = seen.copy(), first + k
    sums, level, longest = [0, 0, 0], 0, 0
    while len(ids):
        level += 1
        active = np.zeros(n, dtype=bool)
        active[ids] = True
        take = active[src]
        s, d = src[take], dst[take]
        starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, dtype=np.int64)
        ends = np.r_[starts[1:], len(d)]
        found, fresh, a = [], [], 0
        while a < len(starts):  # runs of whole targets
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + GATHERED // words, side="right")))
            at = d[starts[a:b]]
            new = np.bitwise_or.reduceat(front[s[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], axis=0) & ~seen[at]
            some = new.any(axis=1)
            at, new, a = at[some], new[some], b
            if not len(at):
                continue
            seen[at] |= new
            found.append(at)
            fresh.append(new)
            bits = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            weighed = sum(np.bitwise_count(new & plane).sum(axis=1, dtype=np.int64) << p for p, plane in enumerate(planes))
            for c, v in enumerate((bits.sum(), (bits * degree[at]).sum(), (weighed * degree[at]).sum())):
                sums[c] += level * int(v)
            longest = level
        front[ids] = 0
        ids = np.concatenate(found) if found else ids[:0]
        for at, new in zip(found, fresh):
            front[at] = new
    return *sums, longest


def _short_cycle(simple: DataFrame) -> int | None:
    """3 or 4 if there is a cycle of that length, else None.

    Each such cycle shows at its node of highest (degree, id) as paths over a neighbour to lower nodes: one that is
    closed by an edge, or two with the same end. A hub is the middle of paths from still larger hubs only, so there are
    at most edges ** 1.5 of them. A few of the nodes go first, so a graph with many such cycles counts few paths for them.
    """
    own = simple.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    rank = lambda c: own.select(F.col("id").alias(c), F.struct("deg", "id").alias(f"r_{c}"))
    placed = checkpoint(simple.join(rank("src"), "src").join(rank("dst"), "dst"))
    down = placed.where("r_dst < r_src")
    first = down.select(F.col("src").alias("v"), F.col("r_src").alias("r_v"), F.col("dst").alias("u"))
    paths = first.join(placed.select(F.col("src").alias("u"), F.col("dst").alias("x"), "r_dst"), "u").where("r_dst < r_v").select("v", "u", "x")
    closed = paths.join(down.select(F.col("src").alias("v"), F.col("dst").alias("x")), ["v", "x"], "left_semi")
    few = F.pmod(F.xxhash64("v"), F.lit(64)) == 0
    twice = lambda rows: not rows.groupBy("v", "x").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if not closed.isEmpty():
        found = 3
    else:
        found = 4 if twice(paths.where(few)) or twice(paths) else None
    discard(placed)
    return found


def girth(edges: DataFrame, nodes: DataFrame) -> int | None:
    """Length of the shortest cycle, None for a forest."""
    simple = _simple(edges)
    short = _short_cycle(simple)
    if short:
        discard(simple)
        return short
    sources = _numbered(nodes)
    best = None
    for a, b in _passes(sources):
        levels = _levels(simple, sources.where((F.col("grp") >= a) & (F.col("grp") < b)))
        for level, state in levels:
            if best is not None and 2 * level - 1 >= best:
                levels.close()
                break
            row = state.agg(F.max((F.col("met") != 0).cast("int")), F.max((F.col("ways") > F.bit_count("front")).cast("int"))).first()
            if row[0] or row[1]:
                best = 2 * level - 1 if row[0] else 2 * level
                levels.close()
                break
    for made in (simple, sources):
        discard(made)
    return best
