"""Pairs in weighted form and regressions from cells against the listed pairs and whole designs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import pairs, regression

BY = ["analysis_type", "arch_key", "arch_family", "dataset", "model", "is_treatment"]


@pytest.fixture(scope="module")
def models(spark):
    rng = np.random.default_rng(2)
    pick = lambda *of: of[rng.integers(len(of))]
    rows = [(f"{pick('vit_a', 'vit_b', 'swin')}.m{k}", pick("ViT", "Swin", None), pick("Tiny", "Small", "Base", None), pick(5, 22, None), pick("ImageNet-1K", "ImageNet-1K", "ImageNet-21K", "JFT", None), pick("AugReg", None, None), pick("ImageNet-1K", None, None)) for k in range(200)]
    registry = spark.createDataFrame(rows, "model_name string, family string, size string, num_parameters long, pretrain_dataset string, pretrain_aug string, pretrain_ft string")
    values = [(r[0], d, float(rng.normal() + 1e6), None if rng.random() < 0.2 else float(rng.normal())) for r in rows for d in ("x", "y", None) if rng.random() < 0.8]
    return registry, spark.createDataFrame(values, "model string, dataset string, isotropy double, spread double")


@pytest.fixture(scope="module")
def listed(models):
    registry, metrics = models
    return pairs.pair_long(pairs.attach_family(pairs.all_pairs(registry), registry), metrics, "isotropy", "spread").cache()


def test_pairs_in_blocks_are_all_pairs(models, monkeypatch):
    registry = models[0]
    whole = sorted(map(tuple, pairs.model_scale(registry).collect()))
    monkeypatch.setattr(pairs, "BLOCK", 3)
    monkeypatch.setattr(pairs, "PAIRS_A_TASK", 20)
    cut = pairs.model_scale(registry)
    assert sorted(map(tuple, cut.collect())) == whole and len(whole) == len(set(whole)) > 100
    assert cut.rdd.getNumPartitions() > 4  # as many tasks as pairs ask for


def test_weighted_and_direct_forms_equal_the_listed_pairs(models, listed):
    weighted = pairs.weighted_long(*models, "isotropy", "spread")
    text = lambda rows: sorted(map(str, rows))
    assert text(map(tuple, weighted.select(*BY, "n", "isotropy", "spread").collect())) == text(map(tuple, listed.groupBy(*BY).agg(F.count("*").alias("n"), F.first("isotropy"), F.first("spread")).collect()))
    direct = pairs.long_of(*models, "isotropy", "spread")
    assert direct.columns == listed.select(direct.columns).columns and text(map(tuple, direct.collect())) == text(map(tuple, listed.select(direct.columns).collect()))
    registry = models[0]
    every = pairs.all_pairs(registry)
    assert {r.name for r in pairs.paired_models(registry).collect()} == {r[0] for r in every.select("control_model").union(every.select("treatment_model")).collect()}


@pytest.mark.parametrize("query", [
    lambda t: pairs.observation_counts(t), lambda t: regression.simple_slope(t, "isotropy"), lambda t: regression.control_std(t, "spread"), lambda t: regression.group_means(t, "spread", "arch_family"),
    lambda t: regression.regress(t, ["isotropy", "spread"]), lambda t: regression.regress(t, ["spread"], "within"), lambda t: regression.regress(t, ["spread"], "interaction"),
])
def test_weighted_form_gives_the_same_metrics(models, listed, query):
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: str([x for x in r if isinstance(x, str)] + [x for x in r if isinstance(x, int)]))
    want, found = order(query(listed).collect()), order(query(pairs.weighted_long(*models, "isotropy", "spread")).collect())
    assert len(want) == len(found) > 0
    for a, b in zip(want, found):
        assert list(b) == [pytest.approx(x, rel=1e-6, abs=1e-6) if isinstance(x, float) else x for x in a]


def test_cells_give_the_whole_design_s_fit():
    rng = np.random.default_rng(4)
    t, f = rng.integers(0, 2, 300), rng.integers(0, 3, 300)
    y = t + 0.5 * f + rng.normal(size=300) * (1 + t) + 1e4
    design = lambda t, f: regression.design({"f": list(f), "g": list(f)}, t.astype(float), "f")[0]  # noqa: E731  # g repeats f: deficient
    whole = regression.ols_hc3(design(t, f), y)
    cells = sorted(set(zip(t, f)))
    own = [y[(t == a) & (f == b)] for a, b in cells]
    found = regression.cells_hc3(design(*map(np.array, zip(*cells))), np.array([len(v) for v in own], float), np.array([v.mean() for v in own]), np.array([((v - v.mean()) ** 2).sum() for v in own]))
    assert np.allclose(found["beta"], whole["beta"]) and np.allclose(found["cov"], whole["cov"]) and found["df"] == whole["df"] and found["r2"] == pytest.approx(whole["r2"])


def test_unordered_pairs_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIRS_A_TASK", 50)
    models = spark.createDataFrame([(f"m{k:02}",) for k in range(40)], "model string").coalesce(1)
    rows = pairs.unordered_pairs(models)
    assert rows.rdd.getNumPartitions() == 16 and rows.count() == 780
    sizes = [n for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(sizes) > 4
