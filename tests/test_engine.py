"""Unit tests of the engine: hand-computed values, invariants and error paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import numerics
from vectorloom.operators import alignment, blocks, cloud, distances, explore, graph, matching, moments, pairs, probing, prototypes, reduce, registry, regression, topology
from vectorloom.plans import topology_queries
from vectorloom.sources import tables

CORNERS = [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5), (2, 2), (3, 2), (2, 3), (3, 3), (2.5, 2.5)]


def cloud_df(spark, rows, schema="id long, v array<float>"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def simple(spark):
    return cloud_df(spark, CORNERS).cache()


@pytest.fixture(scope="module")
def shifted(spark):
    return cloud_df(spark, [(a + 0.1, b + 0.1) for a, b in CORNERS]).cache()


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(42)
    rows = np.concatenate([rng.normal(c, 0.4, (10, 5)) for c in rng.uniform(-6, 6, (10, 5))])
    return cloud_df(spark, rows).cache()


def test_cloud_metrics_of_known_points(simple):
    found = cloud.compute_metrics(simple, "id", "v")
    expected = {"total_spread": 2.4, "mean_distance_to_centroid": 1.480984, "std_distance_to_centroid": 0.454629, "participation_ratio_fast": 2.0, "isotropy": 1.0, "density": 4.166667, "n_components_90pct": 1, "explained_var_ratio_top1": 0.916667, "spectral_entropy": 0.541277, "effective_rank": 1.718200, "participation_ratio": 1.180328}
    for name, value in expected.items():
        assert found[name] == pytest.approx(value, abs=1e-5), name
    assert cloud.participation_ratio(simple, "v").first()[0] == pytest.approx(found["participation_ratio"])


def test_unknown_metric_raises(simple):
    with pytest.raises(ValueError):
        cloud.compute_metrics(simple, "id", "v", ["nonsense"])


@pytest.mark.parametrize("name, value", [("euclidean", 1.852023), ("cosine", 0.115890), ("mahalanobis", 0.092827), ("wasserstein", 0.1), ("sinkhorn", 0.145775), ("procrustes", 0.02), ("chamfer", 0.282843), ("hausdorff", 0.141421)])
def test_distances_of_known_points(simple, shifted, name, value):
    assert distances.distance(name, simple, shifted, "id", "v") == pytest.approx(value, abs=1e-5)


def test_distance_properties(spark, simple, shifted):
    a, b = cloud_df(spark, [(0, 0)]), cloud_df(spark, [(3, 4)])
    assert distances.distance("euclidean", a, b, "id", "v") == pytest.approx(5.0)
    zero, other = cloud_df(spark, [(0, 0), (1, 0)]), cloud_df(spark, [(0, 0), (0, 1)])
    assert distances.distance("cosine", zero, other, "id", "v") == pytest.approx(1.0)
    for name in ("euclidean", "chamfer", "hausdorff"):
        assert distances.distance(name, simple, shifted, "id", "v") == pytest.approx(distances.distance(name, shifted, simple, "id", "v"))
    for name in ("chamfer", "hausdorff", "wasserstein", "procrustes"):
        assert distances.distance(name, simple, simple, "id", "v") == pytest.approx(0.0, abs=1e-9)
    assert distances.foscttm(simple, shifted, "id", "v").first()["a_to_b"] == 0.0
    assert distances.foscttm(a, a, "id", "v").first()["score"] is None
    with pytest.raises(ValueError):
        distances.distance("manhattan", simple, shifted, "id", "v")


def test_sinkhorn_epsilon(simple, shifted):
    assert distances.sinkhorn(simple, shifted, "id", "v", epsilon=1.0) == pytest.approx(0.861460, abs=1e-5)


def test_block_kernels_agree_for_any_block_size(blobs):
    whole = blocks.nearest(blobs, blobs, "id", "v", 4, exclude_self=True).orderBy("src", "rank").collect()
    parts = blocks.nearest(blobs, blobs, "id", "v", 4, exclude_self=True, rows=17).orderBy("src", "rank").collect()
    assert [(r.src, r.dst, r["rank"]) for r in whole] == [(r.src, r.dst, r["rank"]) for r in parts]
    x = np.array([r.v for r in blobs.orderBy("id").collect()], dtype=float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sums = blocks.pair_sums(blobs, blobs, "id", "v", rows=17).first()
    assert sums.pairs == 10000 and sums.total == pytest.approx(d.sum())


def test_normalisations(blobs):
    x = np.array([r.v for r in moments.normalise(blobs, "v", "standard").collect()])
    assert np.allclose(x.mean(0), 0, atol=1e-9) and np.allclose(x.std(0), 1)
    x = np.array([r.v for r in moments.normalise(blobs, "v", "minmax").collect()])
    assert x.min() == 0 and x.max() == 1
    x = np.array([r.v for r in moments.normalise(blobs, "v", "l2").collect()])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    with pytest.raises(ValueError):
        moments.normalise(blobs, "v", "robust")


def test_whitening(blobs):
    w = moments.Whitening.fit(blobs, "v")
    white = w.whiten(blobs, "v")
    assert np.allclose(moments.moments(white, "v").covariance(), np.eye(5), atol=1e-4)
    back = {r.id: r.v for r in w.dewhiten(white, "v").collect()}
    for r in blobs.collect():
        assert np.allclose(back[r.id], r.v, atol=1e-6)
    with pytest.raises(moments.NotFittedError):
        moments.Whitening().whiten(blobs, "v")


def test_parseval_frame(blobs):
    p = prototypes.compute_prototypes(blobs, "id", "v", method="lloyd", k=5, iterations=4)
    f = p.frame.analysis
    assert np.allclose(f.T @ f, np.eye(5), atol=1e-9) and np.allclose(p.frame.synthesis, f.T)
    rebuilt = p.frame.synthesise(p.represent(blobs, "v"), "relative", "back").collect()
    assert all(np.allclose(r.back, r.v, atol=1e-5) for r in rebuilt)
    with pytest.raises(moments.NotFittedError):
        moments.Frame.of(np.zeros((0, 5)))


def test_clusterers(blobs):
    for method, options in (("kmeans", {"k": 10}), ("lloyd", {"k": 10}), ("agglomerative", {"k": 10}), ("spectral", {"n_clusters": 10, "k": 5})):
        assert prototypes.cluster(blobs, "id", "v", method=method, **options).select("cluster").distinct().count() >= 5
    found = {r.id: r.cluster for r in prototypes.cluster(blobs, "id", "v", method="dbscan", eps=1.5, min_samples=2).collect()}
    assert len(set(found.values()) - {-1}) >= 5
    given = blobs.select("id", (F.col("id") % 3).alias("cluster"))
    assert prototypes.cluster(blobs, "id", "v", clusters=given).count() == 100
    with pytest.raises(ValueError):
        prototypes.cluster(blobs, "id", "v")
    with pytest.raises(ValueError):
        prototypes.cluster(blobs, "id", "v", clusters=given, method="lloyd")
    with pytest.raises(ValueError):
        prototypes.lloyd(blobs, "id", "v", 101, 1)


def test_ward_finds_separate_blobs():
    x = np.concatenate([np.full((4, 2), c) + np.arange(8).reshape(4, 2) * 0.01 for c in (0, 10, 20)])
    assert list(prototypes.ward(x, 3)) == [0] * 4 + [1] * 4 + [2] * 4


def edges_of(spark, pairs_):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs_] + [(b, a, 1.0) for a, b in pairs_], "src long, dst long, w double")


@pytest.mark.parametrize("pairs_, n, expected", [
    ([(0, 1), (1, 2), (2, 3)], 4, {"wiener": 10, "diameter": 3, "schultz": 28, "gutman": 19, "disorder": 2, "density": 0.5, "number_of_cycles": 0, "eigengap": 0.5, "cycle_length": 0.0, "girth": None, "connected_components": 1}),
    ([(0, 1), (1, 2), (2, 3), (3, 0), (3, 4)], 5, {"wiener": 16, "diameter": 3, "schultz": 61, "gutman": 57, "disorder": 4, "density": 0.5, "number_of_cycles": 1, "eigengap": 0.591752, "cycle_length": 4.0, "girth": 4.0, "connected_components": 1}),
])
def test_graph_signatures(spark, pairs_, n, expected):
    nodes = spark.range(n).select("id")
    found = graph.signature(edges_of(spark, pairs_), nodes)
    for name, value in expected.items():
        assert found[name] == (value if value is None else pytest.approx(value, abs=1e-5)), name
    shares = [0, 0.5, 0.5] if n == 4 else [0, 0.2, 0.6, 0.2]
    assert found["degree_distribution"] == pytest.approx(shares)


def test_laplacian_rows_sum_to_zero(spark):
    edges, nodes = edges_of(spark, [(0, 1), (1, 2), (0, 2), (3, 4)]), spark.range(6).select("id")
    _, m = graph.laplacian_matrix(edges, nodes)
    assert np.allclose(m.sum(1), 0)
    dense = np.zeros((6, 6))
    for r in graph.laplacian(edges, nodes, "symmetric").collect():
        dense[r.i, r.j] = r.value
    assert np.allclose(dense, graph.laplacian_matrix(edges, nodes, "symmetric")[1])
    parts = {r.id: r.component for r in graph.connected_components(edges, nodes).collect()}
    assert parts == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    with pytest.raises(ValueError):
        graph.laplacian(edges, nodes, "other")


def test_long_path_is_one_component(spark):
    edges = edges_of(spark, [(i, i + 1) for i in range(40)])
    assert {r.component for r in graph.connected_components(edges, spark.range(41).select("id")).collect()} == {0}


def test_layouts(spark):
    table = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0)], "model_a string, model_b string, distance double")
    assert len(graph.distance_layout(table)) == 3
    with pytest.raises(ValueError):
        graph.distance_layout(table, "kamada")


def test_jaccard(spark):
    a = spark.createDataFrame([(i, i // 3) for i in range(9)], "id long, cluster long")
    b = spark.createDataFrame([(i, i // 3) for i in range(6)] + [(9, 2), (10, 2)], "id long, cluster long")
    row = matching.scores(matching.jaccard_matrix(a, b), 0.5).first()
    assert row.jaccard_mean == pytest.approx(2 / 3) and row.good_ratio == pytest.approx(2 / 3)
    assert matching.jaccard_sets({0, 1, 2, 3}, {1, 2, 3, 4}) == pytest.approx(0.6) and matching.jaccard_sets(set(), set()) == 0
    assert matching.all_scores(a, a)["hungarian"] == 1.0
    for method in matching.METHODS:
        groups = matching.match(matching.jaccard_matrix(a, a), method)
        assert [g[:2] for g in sorted(groups)] == [([k], [k]) for k in range(3)], method
    with pytest.raises(ValueError):
        matching.match(matching.jaccard_matrix(a, b), "magic")


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        c = rng.random((n, m))
        rows, cols = numerics.assignment(c)
        small = c if n <= m else c.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))
        assert c[rows, cols].sum() == pytest.approx(best) and len(rows) == min(n, m)


def test_tails():
    assert numerics.normal_sf2(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert numerics.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert numerics.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert numerics.f_sf(2.0, 3, 20) == pytest.approx(0.14638, abs=1e-4)
    assert numerics.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)


def test_diagram_distances():
    a, b = np.array([[0, 1.0], [0, 2], [0, np.inf]]), np.array([[0, 1.1], [0, np.inf]])
    assert topology.bottleneck_points(a, a) == 0 and topology.wasserstein_points(a, a) == pytest.approx(0)
    assert topology.bottleneck_points(a, b) == pytest.approx(0.9)
    assert topology.hausdorff_points(a, np.zeros((0, 2))) == 2.0
    assert topology.wasserstein_points(np.array([[0, 1.0]]), np.zeros((0, 2))) == pytest.approx(1 / np.sqrt(2))


def test_rips_of_a_circle():
    t = np.linspace(0, 2 * np.pi, 12, endpoint=False)
    found = topology.rips_diagram(np.column_stack([np.cos(t), np.sin(t)]), 1)
    loops = [(b, d) for k, b, d in found if k == 1 and d - b > 0.3]
    assert len(loops) == 1 and loops[0][0] == pytest.approx(2 * np.sin(np.pi / 12))
    assert sum(k == 0 for k, _, _ in found) == 12
    with pytest.raises(ValueError):
        topology.persistence(None, "m", "i", "v", complex_="alpha")


def test_diagram_features(spark):
    d = spark.createDataFrame([("m", 0, 0.0, 1.0), ("m", 0, 0.0, 2.0), ("m", 0, 0.0, float("inf")), ("m", 1, 1.0, 1.5)], topology.DIAGRAM)
    assert {r.dim: round(r.entropy, 6) for r in topology.entropy(d).collect()} == {0: 0.636514, 1: 0.0}
    curve = {(r.dim, r.bin): r.betti for r in topology.betti_curve(d, 5).collect()}
    assert [curve[0, k] for k in range(5)] == [3, 3, 2, 2, 1] and [curve[1, k] for k in range(5)] == [0, 0, 1, 0, 0]
    row = topology.signature(d, 5).first()
    assert row.betti_curve == [[3, 3, 2, 2, 1], [0, 0, 1, 0, 0]] and len(row.persistence_image[0]) == 5


def test_alignment_recovers_linear_maps(spark, blobs):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(5, 5))
    other = moments.affine(blobs, "v", m, after=np.ones(5))
    linear = alignment.LinearFit.fit(blobs, other, "id", "v", "v").transmit(5).apply(blobs, "v")
    assert distances.reconstruction_mse(linear, other, "id", "v").first()[0] == pytest.approx(0, abs=1e-6)
    cca = alignment.CCA.fit(blobs, other, "id", "v", "v", 5)
    assert np.allclose(cca.correlations, 1, atol=1e-3)
    assert distances.reconstruction_mse(cca.transmit().apply(blobs, "v"), other, "id", "v").first()[0] < 1e-2
    found = alignment.align("ot", blobs, blobs, "id", "v")
    assert found["plan"].sum() == pytest.approx(1, abs=1e-6)
    phi = alignment.align("graph", blobs, blobs, "id", "v", k=5, n_eigen=4)
    assert np.allclose(phi["map"], np.eye(4), atol=1e-6)
    with pytest.raises(ValueError):
        alignment.align("none", blobs, blobs, "id", "v")
    with pytest.raises(ValueError):
        alignment.align("cca", blobs, blobs.where("id < 5"), "id", "v")


def test_probes(spark, blobs):
    labelled = blobs.withColumn("y", F.floor(F.col("id") / 10))
    probe = probing.fit_probe(labelled, "v", "y")
    assert probing.scores(probe.predict(labelled, "id", "v", "y")).first().accuracy > 0.3
    row = probing.scores(probing.nearest_centroid(labelled, labelled, "id", "v", "y")).first()
    assert row.accuracy > 0.95 and row.f1 > 0.95
    assert probing.pick_split(["train", "valid"]) == "valid"
    table = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "truth long, predicted long")
    assert probing.scores(table).first().asDict() == pytest.approx({"accuracy": 2 / 3, "precision": 0.75, "recall": 0.75, "f1": 2 / 3})


def test_reductions(blobs):
    scores = np.array([r.components for r in reduce.reduce("pca", blobs, "id", "v", 9).collect()])
    assert scores.shape == (100, 5) and np.allclose(scores.mean(0), 0, atol=1e-6)
    c = np.cov(scores.T)
    assert np.allclose(c - np.diag(np.diag(c)), 0, atol=1e-6)
    for method in ("isomap", "lle", "eigen_laplacian", "prototype_analysis"):
        assert reduce.reduce(method, blobs, "id", "v", 2).count() == 100
    assert reduce.tsne(blobs, "id", "v", iterations=20).count() == 100
    with pytest.raises(ValueError):
        reduce.reduce("umap", blobs, "id", "v")
    assert reduce.preprocess(blobs, "id", "v", 50, "standard", "pca", 2).count() == 50


def test_hc3_matches_the_formula():
    rng = np.random.default_rng(3)
    t = np.repeat([0.0, 1.0], 20)
    y = 2 + 3 * t + rng.normal(0, 1 + t, 40)
    x, names = regression.design({"dataset": ["a", "b"] * 20}, t)
    found = regression.ols_hc3(x, y)
    inv = np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    e = y - x @ found["beta"]
    assert np.allclose(found["cov"], inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv)
    assert names == ["Intercept", "is_treatment", "dataset[b]"]


REGISTRY_CASES = {
    "legacy_seresnet50.in1k": {"is_legacy": True, "family": "ResNet", "model_version": "SE", "pretrain_dataset": "ImageNet-1K"},
    "vit_base_patch16_clip_224.openai_ft_in1k": {"family": "ViT", "size": "Base", "patch_size": 16, "input_resolution": 224, "pretrain_method": "CLIP", "pretrain_org": "OpenAI", "pretrain_dataset": "WIT-400M", "pretrain_ft": "ImageNet-1K"},
    "swin_tiny_patch4_window7_224.ms_in22k_ft_in1k": {"window_size": 7, "patch_size": 4, "stride_code": None, "pretrain_org": "Microsoft", "pretrain_dataset": "ImageNet-22K", "pretrain_ft": "ImageNet-1K"},
    "aimv2_large_patch14_224.apple_pt_dist": {"family": "AIMv2", "is_distilled": True, "pretrain_method": "Distillation"},
    "aimv2_huge_patch14_448.apple_pt": {"pretrain_method": "Autoregressive", "input_resolution": 448},
    "convnextv2_tiny.fcmae_ft_in22k_in1k_384": {"pretrain_dataset": "ImageNet-22K", "pretrain_ft": "ImageNet-1K", "pretrain_method": "FCMAE", "pretrain_ft_resolution": 384},
    "vit_base_patch14_reg4_dinov2.lvd142m": {"num_registers": 4, "pretrain_method": "DINOv2", "pretrain_dataset": "LVD-142M"},
    "mobilevitv2_050.cvnets_in1k": {"family": "MobileViT", "size": "0.50x", "width_code": "050", "pretrain_org": "CVNets/Apple"},
    "res2net50_14w_8s.in1k": {"width_code": "14w_8s", "family": "Res2Net"},
    "resnext50_32x4d.a1h_in1k": {"width_code": "32x4d", "pretrain_org": "timm A1H recipe"},
    "tf_efficientnet_b0.ns_jft_in1k": {"pretrain_aug": "NoisyStudent", "pretrain_dataset": "ImageNet-1K", "size": "B0"},
    "vit_pe_core_base_patch16_224.fb": {"pe_scope": "Core", "pretrain_org": "Meta"},
    "sam2_hiera_tiny.fb_r896_2pt1": {"pretrain_dataset": "SA-1B", "pretrain_resolution": 896, "pretrain_tokens": "2pt1", "pretrain_dataset_size": "2.1T"},
    "resnet50.a1.extra_in1k": {"pretrain_config": "a1.extra_in1k"},
    "quux.in1k": {"family": "unknown", "macro_family": None},
}


def test_registry_parser(spark):
    rows = {r.model_name: r.asDict() for r in registry.parse_names(spark.createDataFrame([(n,) for n in REGISTRY_CASES], "model_name string")).collect()}
    for name, expected in REGISTRY_CASES.items():
        assert {k: rows[name][k] for k in expected} == expected, name
    with pytest.raises(Exception, match="needs a dot"):
        registry.parse_names(spark.createDataFrame([("nodot",)], "model_name string")).collect()


def test_model_pairs(spark):
    models = spark.createDataFrame([("b",), ("a",), ("c",)], "model string")
    assert {tuple(r) for r in pairs.unordered_pairs(models).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_tables(spark, tmp_path):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    path = str(tmp_path / "out")
    tables.upsert(spark, path, base, ["k"])
    after = tables.upsert(spark, path, spark.createDataFrame([(2, "new"), (3, "z")], "k long, v string"), ["k"])
    assert sorted(map(tuple, after.collect())) == [(1, "x"), (2, "y"), (3, "z")]
    tables.write_sharded(spark.range(25), str(tmp_path / "train" / "m1"), 10)
    tables.write_single(spark.range(3), str(tmp_path / "test" / "m1"))
    found = {r.split: r.models for r in tables.layout(spark, str(tmp_path)).collect()}
    assert found["train"] == ["m1"] and found["test"] == ["m1"]
    assert [r.ok for r in tables.health(spark, [str(tmp_path / "train" / "m1"), str(tmp_path / "none")]).collect()] == [True, False]
    with pytest.raises(FileNotFoundError):
        tables.read_tables(spark, str(tmp_path / "none"))
    assert tables.parse_result_name("stat__iso__raw___pooled.parquet")["regression_type"] == "pooled"
    assert tables.label_column(None) == "label" and tables.label_column(["fine"]) == "fine"
    assert explore.in_all_groups(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "m string, s long"), "m", "s").collect()[0].m == "a"


def test_streamed_metrics_equal_batch(spark, tmp_path):
    from vectorloom.streaming import incremental

    rng = np.random.default_rng(5)
    rows = [(i % 2, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    schema = "g long, v array<double>"
    for k in range(2):
        spark.createDataFrame(rows[k * 20 : (k + 1) * 20], schema).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    query = incremental.stream_metrics(spark, str(tmp_path / "in"), source.schema, str(tmp_path / "state"), str(tmp_path / "cp"), "g", "v")
    query.awaitTermination(120)
    got = {r.g: r.asDict() for r in incremental.read_metrics(spark, str(tmp_path / "state"), "g").collect()}
    for r in cloud.fast_metrics(source, "v", "g").collect():
        for name in ("n", "total_spread", "participation_ratio_fast", "isotropy", "density"):
            assert got[r.g][name] == pytest.approx(r[name])


@pytest.mark.parametrize("n", [1, 2, 3, 8, 20])
def test_loops_match_the_boundary_matrix(n):
    rng = np.random.default_rng(n)
    for points in (rng.normal(size=(n, 3)), rng.integers(0, 3, (n, 2)).astype(float)):
        found = sorted(topology.rips_diagram(points, 1))
        assert found == sorted(p for p in topology.rips_diagram(points, 2) if p[0] < 2)


def test_persistence_query_takes_whole_clouds(spark):
    from tests.conftest import SF_MEDIUM

    rows = spark.read.parquet(f"{SF_MEDIUM}/embeddings.parquet").where("label = 1").collect()
    points = np.array([r.embedding for r in rows], dtype=float)
    expected = sorted((k, round(b, 6), round(x, 6)) for k, b, x in topology.rips_diagram(points, 1))
    found = topology_queries.persistence(spark, SF_MEDIUM).where("model = 'label1'").collect()
    found = sorted((r.dim, r.birth, r.death) for r in found)
    assert len(points) > 24 and np.array(found) == pytest.approx(np.array(expected))
