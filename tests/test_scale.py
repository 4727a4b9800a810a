"""Eigenpairs, hop searches and the kNN index against dense or exact versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vectorloom.functions.numerics import sinkhorn_plan
from vectorloom.operators import blocks, distances, graph, hops, ivf, prototypes, spectral, transport
from vectorloom.plans import graph_queries, scale_queries
from vectorloom.plans.vector_queries import embeddings
from vectorloom.session import checkpoint


def graph_of(spark, pairs, more=()):
    rows = [(*p, 1.0) for a, b in pairs for p in ((a, b), (b, a))]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    nodes = spark.createDataFrame([(n,) for n in sorted({x for p in pairs for x in p} | set(more))], "id long")
    return edges, nodes


@pytest.fixture(scope="module")
def near(spark):
    edges, nodes = graph_queries._graph(spark, SF_SMALL)
    return checkpoint(edges), checkpoint(nodes)


@pytest.mark.parametrize("kind", ["unnormalized", "random_walk"])  # the latter comes from the symmetric one
def test_eigenpairs_match_the_dense_ones(near, kind):
    found = spectral.laplacian_pairs(*near, 4, kind)
    ids, matrix = graph.laplacian_matrix(*near, kind)
    assert np.allclose(found.values, np.sort(np.linalg.eigvals(matrix).real)[:4], atol=1e-6)
    vectors = {r.id: r.v for r in found.vectors.collect()}
    v = np.array([vectors[i] for i in ids])
    assert np.abs(matrix @ v - v * found.values).max() < 1e-4 and found.residuals.max() < 1e-4


def test_eigenpairs_of_small_and_broken_graphs(spark):
    edges, nodes = graph_of(spark, [(1, 2), (3, 4), (4, 5)], more=(9,))
    found = spectral.laplacian_pairs(edges, nodes, 10)
    dense = np.linalg.eigvalsh(graph.laplacian_matrix(edges, nodes, "symmetric")[1])
    assert np.allclose(found.values, dense, atol=1e-7) and found.vectors.count() == 6
    none = nodes.limit(0)
    assert len(spectral.laplacian_pairs(edges.limit(0), none, 3).values) == 0
    assert np.allclose(spectral.laplacian_pairs(edges.limit(0), nodes, 2).values, 0)
    with pytest.raises(ValueError, match="unknown Laplacian"):
        spectral.laplacian_pairs(edges, nodes, 2, "odd")


def test_eigenpairs_in_one_task_equal_those_from_tables(spark, near, monkeypatch):
    edges, nodes = near
    used, one = [], spectral._in_one_task
    monkeypatch.setattr(spectral, "_in_one_task", lambda *given: used.append(1) or one(*given))
    monkeypatch.setattr(spectral, "TERMS", 50)
    found = spectral.laplacian_pairs(edges, nodes, 3)
    monkeypatch.setattr(spectral, "ENTRIES", 0)
    tables = spectral.laplacian_pairs(edges, nodes, 3)
    assert used == [1] and np.allclose(found.values, tables.values, atol=1e-8)
    rows = lambda pairs: np.array([r.v for r in pairs.vectors.orderBy("id").collect()])
    assert np.allclose(np.abs(rows(found).T @ rows(tables)), np.eye(3), atol=1e-4)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="ask for another degree"):
        spectral.laplacian_pairs(edges, nodes, 3, tolerance=0.0)


def test_signs_do_not_depend_on_the_start(spark):
    rows = [(1, [0.5, -0.9]), (2, [-0.8, 0.1]), (3, [0.8, 0.9])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    turned = vectors.select("id", F.transform("v", lambda x: -x).alias("v"))
    one, other = ({r.id: r.v for r in spectral.fixed_signs(d, 2).collect()} for d in (vectors, turned))
    assert one == other and one[2][0] == 0.8 and one[1][1] == 0.9


def test_hop_sums_and_girth_match_the_dense_ones(spark, near, monkeypatch):
    rng = np.random.default_rng(8)
    graphs = [near] + [graph_of(spark, {tuple(map(int, rng.integers(0, 90, 2))) for _ in range(n)} | {(200, 201)}, more=(300,)) for n in (60, 110)]
    for edges, nodes in graphs:
        plain = edges.where("src <> dst").distinct()
        want, shortest = graph.path_indices(plain, nodes).first(), graph.girth(plain, nodes)
        assert hops.path_sums(edges, nodes).first() == want
        assert hops.girth(edges, nodes) == (None if np.isinf(shortest) else int(shortest))
    monkeypatch.setattr(hops, "ROWS", 100)  # one group a pass
    assert hops.path_sums(*graphs[1]).first() == graph.path_indices(graphs[1][0].where("src <> dst").distinct(), graphs[1][1]).first()


@pytest.mark.parametrize("n", [3, 4, 7, 8])
def test_girth_of_cycles(spark, n):
    edges, nodes = graph_of(spark, [(k, (k + 1) % n) for k in range(n)] + [(0, 50), (50, 51)])
    assert hops.girth(edges, nodes) == n


def test_hops_without_paths(spark):
    edges, nodes = graph_of(spark, [], more=(1, 2))
    assert tuple(hops.path_sums(edges, nodes).first()) == (0, 0, 0, 0) and hops.girth(edges, nodes) is None
    assert tuple(hops.path_sums(edges, nodes.limit(0)).first()) == (0, 0, 0, 0) and hops.girth(edges, nodes.limit(0)) is None
    tree = graph_of(spark, [(1, 2), (2, 3), (2, 4)])
    assert hops.girth(*tree) is None


def test_index_reaches_its_recall(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "PART", 16)  # cells of several parts
    base = embeddings(spark, SF_SMALL)
    index = ivf.build(base, "vec_id", "embedding", f"{tmp_path}/index")
    assert spark.read.parquet(index.path).count() == base.count() and max(index.parts.values()) > 1
    exact = checkpoint(blocks.nearest(base, base, "vec_id", "embedding", 5, exclude_self=True))
    probes, reached = ivf.calibrated_probes(index, base, "vec_id", "embedding", 5, queries=50)
    found = ivf.search(index, base, base, "vec_id", "embedding", 5, probes, exclude_self=True)
    assert reached >= 0.9 and ivf.recall(found, exact) >= 0.85
    whole = ivf.search(index, base, base, "vec_id", "embedding", 5, len(index.centroids), exclude_self=True)
    assert ivf.recall(whole, exact) == 1.0 and whole.count() == exact.count()
    assert ivf.search(index, base, base.limit(0), "vec_id", "embedding", 5, 2).count() == 0


def test_index_edges(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0]), (4, None), (None, [5.0, 5.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = ivf.build(base, "vec_id", "embedding", f"{tmp_path}/a")
    found = ivf.search(index, base, base, "vec_id", "embedding", 2, 9, exclude_self=True)
    assert sorted((r.src, r.dst, r["rank"], r.d) for r in found.collect()) == [(1, 2, 0, 0.0), (1, 3, 1, 1.0), (2, 1, 0, 0.0), (2, 3, 1, 1.0), (3, 1, 0, 1.0), (3, 2, 1, 1.0)]
    empty = ivf.build(base.limit(0), "vec_id", "embedding", f"{tmp_path}/b")
    assert ivf.search(empty, base.limit(0), base, "vec_id", "embedding", 2, 3).count() == 0


def test_supply_graph_has_both_directions(spark):
    edges, nodes = scale_queries.supply_graph(spark, SF_SMALL)
    assert edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).count() == edges.count() and nodes.count() > 50


def test_block_transport_matches_the_dense_plan(spark):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(45, 3)) + 0.5
    a, b = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(side)] + [(None, [0.0, 0.0, 0.0])], "id long, v array<double>") for side in (x, y))
    cost = np.sqrt(blocks.squared(x, y))
    plan = sinkhorn_plan(cost, 0.5, 2000, 1e-13)
    found = transport.sinkhorn(a, b, "id", "v", epsilon=0.5)
    assert found.cost == pytest.approx(float((plan * cost).sum()), rel=1e-5) and found.error < 1e-6
    f, g = ({r.id: r.value for r in side.collect()} for side in (found.left, found.right))
    made = np.exp((np.array([f[k] for k in range(60)])[:, None] + np.array([g[k] for k in range(45)])[None] - cost) / 0.5) / (60 * 45)
    assert np.allclose(made.sum(0), 1 / 45, rtol=1e-9) and np.allclose(made.sum(1), 1 / 60, rtol=1e-5)
    once = transport.sinkhorn(a, b, "id", "v", epsilon=0.5, iterations=1)
    assert once.cost == pytest.approx(float((sinkhorn_plan(cost, 0.5, 1) * cost).sum()), rel=1e-9)
    assert transport.sinkhorn(a.limit(0), b, "id", "v").cost == 0.0


def test_blocks_are_bounded_and_floats_stay_floats(spark, monkeypatch):
    base = embeddings(spark, SF_SMALL)
    assert dict(base.select(blocks.packed(base, "embedding").alias("v")).dtypes)["v"] == "array<float>"
    monkeypatch.setattr(blocks, "MOST_ROWS", 40)
    n = base.count()
    assert blocks.block_counts(base, base, "embedding") == (-(-n // 40), -(-n // 40))


def test_dbscan_lists_no_pairs(spark, monkeypatch):
    """500 rows within eps of each other are 250,000 pairs; the kernels put out a few rows a point and block."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(500, 2)) * 0.01, rng.normal(size=(40, 2)) * 0.01 + 9, [[5.0, 5.0], [0.0, 0.1], [9.0, 9.15]]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(blocks, "MOST_ROWS", 128)
    made, pairwise = [], blocks.pairwise
    monkeypatch.setattr(blocks, "pairwise", lambda *a, **b: made.append(pairwise(*a, **b)) or made[-1])
    found = {r.id: r.cluster for r in prototypes.dbscan(df, "id", "v", 0.12, 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.12 + 1e-12
    core = d.sum(1) >= 4
    assert [found[k] >= 0 for k in range(len(x))] == list((d & core[None]).any(1)) and set(found.values()) == {-1, 0, 1}
    assert all(found[i] == found[j] for i, j in zip(*np.nonzero(d & core[:, None] & core[None])))
    assert max(t.count() for t in made) <= len(x) * 2 * 5


def test_large_graphs_leave_the_driver(spark, monkeypatch):
    """Eigenpairs above DENSE nodes come from the iteration and equal the dense ones."""
    path = graph_of(spark, [(k, k + 1) for k in range(11)] + [(0, 4)])
    dense = spectral.eigenpairs(*path, 4)
    monkeypatch.setattr(spectral, "DENSE", 10)
    monkeypatch.setattr(graph, "MAX_DENSE", 10)
    found = spectral.eigenpairs(*path, 4)
    assert np.allclose(found.values, dense.values, atol=1e-6)
    a, b = ({r.id: r.v for r in side.vectors.collect()} for side in (dense, found))
    assert all(np.allclose(a[k], b[k], atol=1e-4) for k in a)


def test_spectral_clusters_without_a_matrix(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, [float(v) for v in np.eye(3)[k % 3] * (1 + k) + rng.normal(size=3) * 0.01]) for k in range(60)]
    found = {r.id: r.cluster for r in prototypes._spectral_table(spark.createDataFrame(vectors, "id long, v array<double>"), 3, 42).collect()}
    assert len(set(found.values())) == 3 and all(found[k] == found[k % 3] for k in found)


def test_transport_above_the_dense_size(spark):
    rng = np.random.default_rng(12)
    a, b = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, 2)))], "id long, v array<double>") for n in (30, 25))
    assert distances.sinkhorn_cost(a, b, "id", "v", 0.5, dense=10) == pytest.approx(distances.sinkhorn(a, b, "id", "v", 0.5), rel=1e-6)


def test_short_cycles_need_no_search(spark, monkeypatch):
    monkeypatch.setattr(hops, "_numbered", lambda nodes: pytest.fail("searched"))
    assert hops.girth(*graph_of(spark, [(k, (k + 1) % 4) for k in range(4)] + [(0, k) for k in range(10, 30)])) == 4
    assert hops.girth(*graph_of(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])) == 3


def test_diagram_hausdorff_meets_repeated_points_once(spark):
    from vectorloom.operators import pairs, topology

    rows = [("a", 0, 0.0, 1.0), ("a", 0, 0.5, 2.0), ("b", 0, 0.0, 1.5), ("b", 1, 0.0, 1.0)]
    one = spark.createDataFrame(rows, topology.DIAGRAM)
    many = one.crossJoin(spark.range(20000)).drop("id")
    # without taking repeated points once, 4 * 10^8 pairs would meet
    found = [topology.diagram_hausdorff(d, pairs.unordered_pairs(one)).first().distance for d in (one, many)]
    assert found[0] == found[1] == pytest.approx(np.hypot(0.5, 0.5) + 1.0)


def test_hop_sums_in_many_passes(spark, monkeypatch):
    from vectorloom.operators import graph, hops

    n = 600  # two groups of 512 sources
    pairs = {tuple(sorted(p)) for p in np.random.default_rng(1).integers(0, n - 5, (1500, 2)).tolist() if p[0] != p[1]}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src long, dst long, w double")
    nodes = spark.range(n).select("id")
    want = graph.path_indices(edges, nodes).first()
    monkeypatch.setattr(hops, "ROWS", hops.WORDS * n)
    assert hops._passes(hops._numbered(nodes, hops.WORDS), hops.WORDS) == [(0, 1), (1, 2)]
    assert tuple(hops.path_sums(edges, nodes).first()) == tuple(want)


def test_hop_sums_of_groups_that_hold_the_edges(spark, monkeypatch):
    from vectorloom.operators import graph, hops

    n = 300
    pairs = {tuple(sorted(p)) for p in np.random.default_rng(2).integers(0, n - 40, (420, 2)).tolist() if p[0] != p[1]} | {(k, k + 1) for k in range(n - 40, n - 10)}
    edges = spark.createDataFrame([(3 * a, 3 * b, 1.0) for p in pairs for a, b in (p, p[::-1])], "src long, dst long, w double")
    nodes = spark.range(n).select((F.col("id") * 3).alias("id"))
    want = tuple(graph.path_indices(edges, nodes).first())
    searched, calls = hops._searched, []
    monkeypatch.setattr(hops, "_searched", lambda *given: calls.append(1) or searched(*given))
    for most, state, copies, gathered in ((8_000_000, 1 << 26, 1 << 27, 1 << 20), (8_000_000, 1, 2 * len(pairs), 7), (len(pairs), 1, 1, 1)):
        for name, value in (("EDGES", most), ("STATE", state), ("COPIES", copies), ("GATHERED", gathered)):
            monkeypatch.setattr(hops, name, value)
        assert tuple(hops.path_sums(edges, nodes).first()) == want
    assert len(calls) == 2


def test_ivf_queries_go_to_a_bin_once(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(4).normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    index = ivf.build(df, "id", "v", str(tmp_path / "index"), cells=12)
    exact = sorted(map(tuple, blocks.nearest(df, df, "id", "v", 3, exclude_self=True).collect()))
    monkeypatch.setattr(ivf, "ASKED", 100)
    for size in (1 << 16, 70):
        monkeypatch.setattr(ivf, "BIN", size)
        found = ivf.search(index, df, df, "id", "v", 3, 12, exclude_self=True)
        assert sorted(map(tuple, found.collect())) == exact
