"""Operators against plain restatements of their definitions, and cases at the edges of their inputs."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_MEDIUM, SF_SMALL
from tests.llm.test_operators import LONG, brute_components, check_packing, documents, texts_of
from vectorloom.llm import cotraining, fingerprints, language_id, minmax_dedup, mixing

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


# -- fingerprints --------------------------------------------------------------------------------


def test_short_texts_have_fingerprints_of_their_own(spark):
    words = documents(spark, [(i, f"word{i}") for i in range(400)])
    fps = [r.f for r in words.select(fingerprints.as_text(fingerprints.fingerprint(F.col("text"))).alias("f")).collect()]
    assert len(set(fps)) >= 399
    pairs = spark.createDataFrame([(f"a{i} b{i} c{i} d{i} e{i} f{i}"[: 3 + 5 * (i % 5)], f"v{i} w{i} x{i} y{i} z{i} q{i}"[: 3 + 5 * (i % 4)]) for i in range(300)], "a string, b string")
    near = [r.n for r in pairs.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("n")).collect()]
    assert max(near) < 0.2


# -- near-dedup ----------------------------------------------------------------------------------


def test_buckets_cut_into_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    common = [f"c{k}" for k in range(40)]
    texts = {}
    for i in range(60):
        own = [f"o{i}x{k}" for k in range(int(rng.integers(8, 30)))]
        texts[i] = " ".join(common + own)
        if i % 3 == 0:
            texts[1000 + i] = " ".join(common + own + ["tail"] * int(rng.integers(0, 3)))
    monkeypatch.setattr(minmax_dedup, "BLOCK", 2)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(documents(spark, list(texts.items()))).collect()}
    assert found == brute_components(texts)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 90, (70, 2))] + [(k, k + 1) for k in range(200, 230)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs, "a long, b long")
    expected = {x: find(x) for x in root if find(x) != x}
    assert {r.node: r.root for r in minmax_dedup.components(df).collect()} == expected
    half = minmax_dedup.components(df.where("a % 2 = 0"))
    assert {r.node: r.root for r in minmax_dedup.joined(half, df).collect()} == expected


def test_keep_one_leaves_columns_of_any_name_alone(spark):
    df = documents(spark, [(1, "a b"), (1, "a c"), (2, "a b")]).withColumn("place", F.lit("p")).withColumn("dedup_place", F.lit("q"))
    rows = minmax_dedup.keep_one(df).collect()
    assert [(r.doc_id, r.text, r.place, r.dedup_place) for r in rows] == [(1, "a b", "p", "q")]


# -- mixing --------------------------------------------------------------------------------------


def test_mixing_leaves_columns_of_any_name_alone(spark):
    df = documents(spark, [(i, "a b") for i in range(50)])
    for name in ("mix_stratum", "mix_u", "mix_below", "MIX__rate"):
        df = df.withColumn(name, F.lit("mine"))
    out = mixing.mix(df, {"src0": 0.5}, 0.5)
    assert out.columns == [c for c in df.columns if c != "copy"] + ["copy", "n_copies", "shuffle_key"]
    rows = out.collect()
    assert rows and all(r.mix_stratum == r.mix_u == r.mix_below == r.MIX__rate == "mine" for r in rows)


def test_mixing_keeps_sources_of_empty_texts(spark):
    df = documents(spark, [(i, "") for i in range(400)] + [(1000 + i, "text") for i in range(400)], sources=(None,))
    df = df.withColumn("source", F.when(F.col("doc_id") < 1000, "src0").otherwise("src1"))
    found = {r.source: r.n for r in mixing.mix(df, {"src0": 0.5, "src1": 0.5}, 0.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(found[s] - 400) < 5 * 20 for s in ("src0", "src1"))


# -- language ID ---------------------------------------------------------------------------------


def plain_scores(net, data):
    """Mean log-probabilities over a text's windows, one field and one filter at a time."""
    total, windows = np.zeros(len(net.classes)), [data[at : at + language_id.WINDOW] for at in range(0, len(data), language_id.WINDOW)]
    for window in windows:
        ids = list(window) + [256] * (language_id.WINDOW + net.widest - 1 - len(window))
        best = np.full(net.filters.shape[1], -np.inf)
        for at in range(language_id.WINDOW):
            field = np.concatenate([net.embed[b] for b in ids[at : at + net.widest]])
            for f in range(net.filters.shape[1]):
                best[f] = max(best[f], field @ net.filters[:, f])
        logits = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
        total += logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
    return total / len(windows)


def test_predictions_match_a_plain_convolution(spark):
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    net = language_id.fit(small)
    some = small.where("length(text) between 1 and 900").orderBy("doc_id").limit(6)
    extra = documents(spark, [(-1, "é"), (-2, "Ab" * 128), (-3, "Ab" * 128 + "c")]).select(*some.columns)
    texts = texts_of(some.unionByName(extra))
    for r in language_id.predict(some.unionByName(extra), net).collect():
        mean = plain_scores(net, texts[r.doc_id].encode())
        share = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert r.lang_pred == net.classes[int(mean.argmax())] and abs(r.score - share.max()) < 1e-3


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language_id.train(["abc def", "xyz uvw"], ["a", "b"], least_steps=3, epochs=1, filters=3, dim=4)
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    mask = (net.filters != 0).astype(float)
    x = language_id.cut_windows(b"some text that is long enough " * 20)
    y = rng.integers(0, 2, len(x))
    grads = language_id._gradients(net, x, y, mask)
    loss = lambda: -net.log_probabilities(x)[np.arange(len(x)), y].mean()
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        values = getattr(net, name)
        places = [p for p in np.argwhere(np.abs(grads[name]) > 1e-4)][:6]
        assert len(places)
        for p in map(tuple, places):
            held, step = values[p], 1e-6
            values[p] = held + step
            up = loss()
            values[p] = held - step
            down = loss()
            values[p] = held
            assert abs((up - down) / (2 * step) - grads[name][p]) < 1e-4 * max(1, abs(grads[name][p])), name


def test_language_of_an_unlabelled_corpus(spark):
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = language_id.accept(small)
    assert kept.count() == small.where(r"text rlike '\\p{L}'").count() > 0


def test_all_languages_are_learned(spark):
    names = [f"l{k:03}" for k in range(230)]
    rows = [(5 * k + j, f"{n} {n * 3} text", n, "s", 1) for k, n in enumerate(names) for j in range(1, 4)]
    texts, labels = language_id._sample(spark.createDataFrame(rows, TABLE), False, most_rows=230)
    assert len(set(labels)) > 150  # one row a language is drawn on average
    assert set(language_id._sample(spark.createDataFrame(rows, TABLE), False)[1]) >= {n for k, n in enumerate(names) if any(zlib.crc32(str(5 * k + j).encode()) % 5 for j in range(1, 4))}


def test_language_stage_learns_from_every_labelled_text(spark):
    docs = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect() if r.lang is not None and any(c.isalpha() for c in r.text or "")]
    held = [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows]
    names = sorted({r.lang for r in rows})
    typical = language_id.Typicality.fit(docs, names)
    for name in names:
        n = np.zeros(64**3)
        for r, out in zip(rows, held):
            if r.lang == name and not out:
                np.add.at(n, language_id._trigrams(r.text.encode()), 1)
        n = n.reshape(64, 64, 64)
        one = n.sum((0, 1)) + 1
        two = (n.sum(0) + 20 * one / one.sum()) / (n.sum((0, 2))[:, None] + 20)
        three = (n + 20 * two[None]) / (n.sum(2, keepdims=True) + 20)
        assert np.abs(typical.tables[name] - np.minimum(-8 * np.log2(three), 255).ravel()).max() <= 1
        bits, letters = np.array([(typical.bits(r.text.encode(), name), language_id.letter_share(r.text.encode())) for r, out in zip(rows, held) if r.lang == name and out]).T
        assert np.allclose(typical.marks[name], (np.quantile(bits, 0.99) + 2, np.quantile(letters, 0.01) / 2), atol=1e-3)


def test_refined_network_fits_texts_beyond_the_start(spark):
    docs = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet").select("doc_id", "text", "lang")
    start = language_id.fit(docs, per_language=4)
    before = {k: getattr(start, k).copy() for k in language_id.WEIGHTS}
    refined = language_id.refine(docs.repartition(3), start)
    assert all((getattr(start, k) == before[k]).all() for k in language_id.WEIGHTS)
    loss = dict.fromkeys((0, 1), 0.0)
    for r in language_id.labelled(docs, False).collect():
        for k, net in enumerate((start, refined)):
            x = language_id.cut_windows(r.text.encode())
            loss[k] -= net.log_probabilities(x)[:, net.classes.index(r.lang)].sum()
    assert loss[1] < 0.9 * loss[0]
    assert (refined.embed[256] == 0).all() and ((refined.filters == 0) == (start.filters == 0)).all()


# -- quality -------------------------------------------------------------------------------------


def auc(good, bad):
    good, bad = np.array(good)[:, None], np.array(bad)[None]
    return float((good > bad).mean() + (good == bad).mean() / 2)


@pytest.fixture(scope="module")
def quality(spark):
    docs, labels = (spark.read.parquet(f"{SF_MEDIUM}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels, cotraining.fit(docs, labels.where("doc_id % 3 <> 0"))


def test_quality_of_documents_whose_labels_were_not_read(spark, quality):
    docs, labels, model = quality
    rows = cotraining.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = ([r.score for r in rows if (r.quality == 1 and not r.toxic) == k] for k in (True, False))
    assert len(good) > 30 and len(bad) > 5 and auc(good, bad) > 0.9


def test_both_views_of_quality_hand_labels_on(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = cotraining.fit(docs, labels.where("doc_id % 3 <> 0"))
    assert model.text_given > 500 and model.page_given > 500
    rows = cotraining.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    split = lambda column: [[r[column] for r in rows if (r.quality == 1 and not r.toxic) == k] for k in (True, False)]
    assert auc(*split("page_score")) > 0.7 and auc(*split("score")) > 0.98


def test_features_are_packed_without_loss():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 300):
        rows = sorted({int(x) for x in rng.integers(0, cotraining.BUCKETS, n)} | ({0, 65534, 65535, 131070, cotraining.BUCKETS - 1} if n == 5 else set()))
        assert cotraining.unpacked(cotraining.packed(rows)).tolist() == rows


def test_ends_of_a_view_are_the_surest_shares(spark):
    rows = [(k, k / 100) for k in range(-1000, 1000)]
    scored = spark.createDataFrame(rows, "doc_id long, a double")
    low, high = cotraining.ends(scored, "a", 0.05)
    assert sum(v * 100 // 1 <= low for _, v in rows) in range(100, 103) and sum(v * 100 // 1 >= high for _, v in rows) in range(100, 103)
    assert cotraining.ends(scored.where("doc_id = 1"), "a", 0.05) is None and cotraining.ends(scored.limit(0), "a", 0.05) is None


def test_quality_scores_match_a_plain_sum(spark, quality):
    docs, _, model = quality
    edge = documents(spark, [(-1, None), (-2, ""), (-3, LONG[:300_000]), (-4, "Same"), (-4, "Same"), (None, "no id")]).select("doc_id", "text", "lang", "source", "n_chars")
    edge = edge.withColumn("lang", F.when(F.col("doc_id") == -4, F.lit(None)).otherwise(F.col("lang")))
    df = docs.orderBy("doc_id").limit(20).unionByName(edge)
    given, squash = defaultdict(list), lambda z: 1 / (1 + np.exp(-z))
    for r in df.collect():
        text = r.text or ""
        sets = [np.array(sorted({b for t in cotraining.text_tokens(text) for b in cotraining.token_features(t)}), dtype=int)]
        a = model.text.logits(sets, np.array([cotraining.text_shape(text)]))[0]
        b = model.page.logits([np.array([cotraining.bucket(t) for t in cotraining.page_tokens(r.source, r.lang, r.n_chars) + cotraining.layout_tokens(text)])], np.zeros((1, 0)))[0]
        a, b = model.text_scale[0] + model.text_scale[1] * a, model.page_scale[0] + model.page_scale[1] * b
        given[r.doc_id].append((squash(a), squash(b), squash(model.joint[0] + model.joint[1] * a + model.joint[2] * b)))
    found = defaultdict(list)
    for r in cotraining.score(df, model).collect():
        found[r.doc_id].append((r.text_score, r.page_score, r.score))
    assert set(found) == set(given)
    for k in given:
        assert np.allclose(sorted(found[k]), sorted(given[k]), atol=1e-9)


def test_linear_view_matches_newton():
    rng = np.random.default_rng(1)
    x = rng.random((300, 6)) < 0.4
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ np.array([2, -2, 1, 0, 0, -1]) - 0.3)))).astype(float)
    view = cotraining.fit_linear([np.flatnonzero(r) for r in x], np.zeros((300, 0)), y, 0.0, steps=1500)
    plain = cotraining.fit_plane(x.astype(float), y, l2=1.0)
    assert np.allclose(view.weights[:6], plain[1:], atol=0.05) and abs(view.bias - plain[0]) < 0.05


def test_pseudo_labels_change_the_other_view():
    rng = np.random.default_rng(2)
    n, y = 60, np.arange(60) % 2
    known = cotraining.Rows([np.array([10 + label]) for label in y], np.zeros((n, 1)), [np.array([20 + label]) for label in y], y.astype(float))
    pool = cotraining.Rows([np.array([10 + k % 2, 30 + k % 2]) for k in range(200)], np.zeros((200, 1)), [np.array([20 + k % 2, 40 + k % 2]) for k in range(200)], np.zeros(200))
    fold = rng.random(n) < 0.3

    def exchange(model):
        of_text, of_page = model.text.logits(pool.text, pool.shapes) > 0, model.page.logits(pool.page, np.zeros((200, 0))) > 0
        return cotraining.Rows(pool.text, pool.shapes, pool.page, of_page.astype(float)), cotraining.Rows(pool.text, pool.shapes, pool.page, of_text.astype(float))

    trained, alone = cotraining.co_train(known, fold, exchange, weight=1.0), cotraining.co_train(known, fold, None)
    # words that only the pool has are learned from the other view's labels
    assert trained.page.weights[41] > 0 > trained.page.weights[40] and not alone.page.weights[40:42].any()
    assert trained.text.weights[31] > 0 > trained.text.weights[30] and not alone.text.weights[30:32].any()


# -- pipeline ------------------------------------------------------------------------------------


def run_stages(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        docs.write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return before, docs


def test_pipeline_of_empty_and_unlabelled_tables(spark, tmp_path):
    _, out = run_stages(spark, spark.createDataFrame([], TABLE), f"{tmp_path}/a")
    assert out.count() == 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    rows = [(i, f"some words of text number {i} and more", None, f"src{i % 3}", 30) for i in range(30)] + [(50, None, None, None, None), (51, "12 34", None, None, 5)]
    df = spark.createDataFrame(rows, TABLE)
    for name in ("place", "row", "chunk", "band", "mix_u", "draw"):
        df = df.withColumn(name, F.lit("mine"))
    before, out = run_stages(spark, df, f"{tmp_path}/b")
    assert before.columns == df.columns and {r.place for r in before.collect()} == {"mine"}
    assert out.count() >= before.count() > 0
    check_packing(before)


def test_operators_leave_the_session_as_it_was(spark):
    settings = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(s, None) for s in settings]
    minmax_dedup.near_duplicates(documents(spark, [(1, "a b"), (2, "a b")])).collect()
    assert [spark.conf.get(s, None) for s in settings] == before
