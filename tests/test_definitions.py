"""Registered queries without an oracle against plain numpy restatements, and faults of sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vectorloom.functions.vectors import doubles
from vectorloom.operators import blocks, graph, registry
from vectorloom.plans import catalogue
from vectorloom.sources import tables
from vectorloom.streaming import incremental


@pytest.fixture(scope="module")
def cloud(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows])


def run(spark, name):
    return catalogue.QUERIES[name](spark, SF_SMALL).collect()


def record(spark, name):
    return {r["name"]: r["value"] for r in run(spark, name)}


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def test_spectral_metrics(spark, cloud):
    x = cloud[1]
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    lam = s**2 / (len(x) - 1)
    share, p = lam / lam.sum(), s / s.sum()
    entropy = -(p * np.log(p)).sum()
    expected = {
        "n_components_90pct": 1 + int((np.cumsum(share) < 0.9).sum()),
        "explained_var_ratio_top1": share[0],
        "explained_var_ratio_top3": share[:3].sum(),
        "top_eigenvalue_ratio": lam[0] / lam[:10].sum(),
        "spectral_entropy": entropy,
        "effective_rank": np.exp(entropy),
        "participation_ratio": lam.sum() ** 2 / (lam**2).sum(),
    }
    found, everything = record(spark, "spectral_metrics"), record(spark, "all_metrics")
    for name, value in expected.items():
        assert found[name] == pytest.approx(value, rel=1e-5) == everything[name], name
    gap = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
    assert everything["mean_distance_to_centroid"] == pytest.approx(gap.mean(), rel=1e-5)
    assert everything["total_spread"] == pytest.approx(x.var(0).sum(), rel=1e-5)
    for r in run(spark, "pca_summary"):
        assert (r.eigenvalue, r.explained) == (pytest.approx(lam[r["rank"]], rel=1e-6), pytest.approx(share[r["rank"]], rel=1e-6))


def test_paired_distances(spark, cloud):
    a, b = cloud[1][:, :32], cloud[1][:, 32:]
    u, _, vt = np.linalg.svd(a.T @ b)
    assert record(spark, "procrustes")["procrustes"] == pytest.approx(((a @ (u @ vt) - b) ** 2).sum(1).mean(), rel=1e-5)
    rows = np.concatenate([a, b])
    gap = a.mean(0) - b.mean(0)
    c = np.zeros((32, 32))
    for r in rows - rows.mean(0):
        c += np.outer(r, r)
    assert record(spark, "mahalanobis")["mahalanobis"] == pytest.approx(np.sqrt(gap @ np.linalg.inv(c / (len(rows) - 1)) @ gap), rel=1e-5)


def test_sinkhorn(spark, cloud):
    a, b = cloud[1][:, :32], cloud[1][:, 32:]
    cost = distances(a, b)
    k, n = np.exp(-cost / 0.1), len(a)
    u = (1 / n) / np.array([max(1e-300, row.sum()) for row in k])
    v = (1 / n) / np.maximum(np.array([(k[:, j] * u).sum() for j in range(n)]), 1e-300)
    found = record(spark, "sinkhorn")
    assert found["one_scaling"] == pytest.approx((u[:, None] * k * v[None] * cost).sum(), rel=1e-4)
    for _ in range(1000):
        u = (1 / n) / np.maximum(k @ v, 1e-300)
        v = (1 / n) / np.maximum(k.T @ u, 1e-300)
    assert found["converged"] == pytest.approx((u[:, None] * k * v[None] * cost).sum(), rel=1e-3)


def test_hungarian_is_the_best_of_all_assignments(spark, cloud):
    _, x, label = cloud
    other = x[:, :10].argmax(1) + 1
    a, b = sorted(set(label)), sorted(set(other))
    j = np.array([[((label == p) & (other == q)).sum() / ((label == p) | (other == q)).sum() for q in b] for p in a])
    best = {0: 0.0}
    for row in j:
        after = {}
        for mask, total in best.items():
            for k, value in enumerate(row):
                if not mask >> k & 1:
                    after[mask | 1 << k] = max(after.get(mask | 1 << k, -1), total + value)
        best = after
    found = run(spark, "hungarian")
    assert len({r.a for r in found}) == len({r.b for r in found}) == len(found)
    assert sum(r.score for r in found) == pytest.approx(max(best.values()), abs=1e-5)


def test_probe(spark, cloud):
    ids, x, label = cloud
    train = ids % 5 != 0
    classes = np.array(sorted(set(label[train])))
    w = np.linalg.lstsq(x[train], (label[train][:, None] == classes[None]).astype(float), rcond=None)[0]
    said, truth = classes[(x[~train] @ w).argmax(1)], label[~train]
    row = run(spark, "lstsq_probe")[0]
    assert row.accuracy == pytest.approx((said == truth).mean(), abs=1e-6)
    each = [((said == c) & (truth == c)).sum() / max(1, (said == c).sum()) for c in sorted(set(said) | set(truth))]
    assert row.precision == pytest.approx(np.mean(each), abs=1e-6)


def test_clusterings(spark, cloud):
    ids, x, _ = cloud
    place = {int(v): k for k, v in enumerate(ids)}
    found = {place[r.vec_id]: r.cluster for r in run(spark, "kmeans")}
    labels = np.array([found[k] for k in range(len(ids))])
    centres = np.array([x[labels == c].mean(0) for c in range(labels.max() + 1)])
    assert (distances(x, centres).argmin(1) == labels).mean() > 0.98  # a fixed point up to the stop rule
    found = {place[r.vec_id]: r.cluster for r in run(spark, "dbscan")}
    labels, near = np.array([found[k] for k in range(len(ids))]), distances(x, x) <= 0.9 + 1e-12
    core = near.sum(1) >= 4
    assert ((labels >= 0) == (near & core[None]).any(1)).all()
    for i, j in zip(*np.nonzero(near & core[:, None] & core[None])):
        assert labels[i] == labels[j]


def test_regression_with_hc3(spark):
    from vectorloom.plans import relational_queries
    from vectorloom.operators import regression

    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(40), rng.normal(size=(40, 2))])
    y = x @ [1.0, 2.0, -1.0] + rng.normal(size=40) * (1 + x[:, 1] ** 2)
    found = regression.ols_hc3(x, y)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    meat = np.zeros((3, 3))
    for row, residual in zip(x, y - x @ beta):
        meat += np.outer(row, row) * (residual / (1 - row @ inverse @ row)) ** 2
    flat = [np.asarray(v, dtype=float) for v in found.values()]
    assert any(v.shape == (3,) and np.allclose(v, beta) for v in flat)
    assert any(v.shape == (3, 3) and np.allclose(v, inverse @ meat @ inverse) for v in flat)
    for name in ("ols_hc3", "ols_hc3_within", "ols_hc3_interaction"):
        rows = run(spark, name)
        for r in rows:
            if r.term == "is_treatment" and r.se:
                assert r.stat == pytest.approx(r.beta / r.se, abs=1e-3) and r.ci_low <= r.beta <= r.ci_high and 0 <= r.p <= 1
    assert relational_queries._long(spark, SF_SMALL).count() > 0


@pytest.mark.parametrize("rows", [7, 64, None])
def test_blocks_of_any_size_give_the_same_neighbours(spark, cloud, rows):
    ids, x, _ = cloud
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").where("vec_id < 120")
    few = ids < 120
    d = distances(x[few], x[few])
    np.fill_diagonal(d, np.inf)
    expected = {int(i): [int(ids[few][k]) for k in np.argsort(row, kind="stable")[:4]] for i, row in zip(ids[few], d)}
    found: dict = {}
    for r in blocks.nearest(df, df, "vec_id", "embedding", 4, exclude_self=True, rows=rows).orderBy("src", "rank").collect():
        found.setdefault(r.src, []).append(r.dst)
    assert found == expected and df.select(doubles("embedding")).count() == few.sum()


def test_square_clustering_of_a_hub(spark):
    edges = {(0, k) for k in range(1, 12)} | {(1, 2), (2, 3), (12, 1), (12, 3), (13, 12)}
    both = edges | {(b, a) for a, b in edges}
    near = {n: {b for a, b in both if a == n} for n in range(15)}

    def c4(v):
        squares = potential = 0
        for u in near[v]:
            for w in near[v]:
                if u < w:
                    q, theta = len((near[u] & near[w]) - {v}), int(w in near[u])
                    squares += q
                    potential += q + (len(near[u]) - 1 - q - theta) + (len(near[w]) - 1 - q - theta)
        return squares / potential if potential > 0 else 0.0

    df = spark.createDataFrame([(a, b, 1.0) for a, b in both], "src long, dst long, w double")
    found = {r.id: r.c4 for r in graph.square_clustering(df, spark.range(15)).collect()}
    assert found == {n: pytest.approx(c4(n)) for n in range(15)}


def test_path_indices_with_and_without_weights(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0), (5, 6, 1.0)]
    for scale in (1.0, 0.5):
        df = spark.createDataFrame([(a, b, w * scale) for x, y, w in edges for a, b in ((x, y), (y, x))], "src long, dst long, w double")
        r = graph.path_indices(df, spark.range(8)).first()
        assert (r.wiener, r.diameter) == (9 * scale, 2 * scale)
        assert r.schultz == pytest.approx((8 * 4 + 1 * 2) * scale * scale) and r.gutman == pytest.approx((8 * 4 + 1) * scale**3)


def test_every_family_of_the_map_has_its_category(spark):
    named = {family for _, family, _ in registry.FAMILIES}
    names = spark.createDataFrame([(f"{p}x.cfg",) for p, _, _ in registry.FAMILIES], "model_name string")
    found = {r.family: r.macro_family for r in registry.parse_names(names).select("family", "macro_family").distinct().collect()}
    assert len(registry.MACRO_FAMILIES) == 95
    for family in named & set(registry.MACRO_FAMILIES):
        assert found.get(family, registry.MACRO_FAMILIES[family]) == registry.MACRO_FAMILIES[family]
    expected = {"ResNet": "Convolutional", "ConvNeXt": "Convolutional", "EfficientNet": "Convolutional", "MambaOut": "State Space Model", "ResMLP": "MLP", "ViT": "Vision Transformer", "Swin": "Hierarchical Vision Transformer", "MetaFormer": "MetaFormer"}
    assert {f: found.get(f) for f in expected if f in found} == {f: m for f, m in expected.items() if f in found}


def test_upsert_loses_nothing_on_faults(spark, tmp_path):
    path, base = str(tmp_path / "t"), spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    tables.upsert(spark, path, base, ["k"])
    kept = lambda: sorted(map(tuple, spark.read.parquet(path).collect()))
    for fresh, keys in (
        (spark.createDataFrame([(3, [1])], "k long, v array<int>"), ["k"]),
        (spark.createDataFrame([("3", "z")], "k string, v string"), ["k"]),
        (spark.createDataFrame([("z",)], "v string"), ["k"]),
        (spark.createDataFrame([(3, "z")], "other long, v string"), ["other"]),
    ):
        with pytest.raises(ValueError):
            tables.upsert(spark, path, fresh, keys)
        assert kept() == [(1, "x"), (2, "y")]
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        tables.upsert(spark, str(broken), base, ["k"])
    assert (broken / "part-0.parquet").read_bytes() == b"no parquet"
    tables.upsert(spark, path, spark.createDataFrame([(2, "new", 1), (3, "z", 2)], "k long, v string, w int"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == [(1, "x"), (2, "y"), (3, "z")]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("t")] == ["t"]


def test_streamed_variances_of_a_large_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2)) + 1e9
    parts = [spark.createDataFrame([(0, [float(v) for v in row]) for row in x[k::3]], "g long, v array<double>") for k in range(3)]
    state = None
    for p in parts:
        sums = incremental.partial_sums(p, "g", "v")
        state = sums if state is None else state.unionByName(sums)
    assert incremental.metrics_of(state, "g").first().total_spread == pytest.approx(x.var(0).sum(), rel=1e-6)


def test_rows_from_arrow_and_splits(spark):
    import pyarrow as pa

    assert [tuple(r) for r in tables.from_arrow(spark, pa.table({"a": [1, 2], "b": ["x", None]})).collect()] == [(1, "x"), (2, None)]
    out = tables.split_rows(spark.range(2000), "id").groupBy("split").agg(F.count("*").alias("n")).collect()
    assert abs({r.split: r.n for r in out}["train"] - 1600) < 100
