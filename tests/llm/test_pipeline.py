"""The pipeline's stages against their operators, and its result as a whole."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_MEDIUM, SF_SMALL
from vectorloom.llm import language_id, minmax_dedup, mixing, queries, suffix_dedup


def test_stages_and_run(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    expected = {
        "language_id": lambda d: language_id.accept(d),
        "near_dedup": lambda d: minmax_dedup.keep_one(d),
        "suffix_dedup": lambda d: suffix_dedup.remove_repeats(d),
        "mixing": lambda d: mixing.mix(d, queries.WEIGHTS, queries.OTHER_WEIGHT).select(*columns),
    }
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name in expected:
            assert out.columns == columns
            assert Counter(map(tuple, out.collect())) == Counter(map(tuple, expected[name](docs).collect())), name
        seen.append(out.count())
        docs = out
    assert seen[0] >= seen[1] == seen[2] and seen[4] >= seen[3] > 0
    last = Counter(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "start", "length", "ids_crc32").collect())) == last


def test_suffix_stage_cuts_passages_of_over_fifty_words(spark):
    rng = np.random.default_rng(6)
    words = lambda n, size: ["".join(rng.choice(list("abcdefgh"), size)) for _ in range(n)]
    letters, short, fifty = words(51, 1), words(51, 4), words(50, 6)
    rows, expected = [], {}
    for k, passage in enumerate((letters, short, fifty)):
        for copy in range(2):
            head, tail = words(30 + copy, 7), words(20, 7)
            gap = "\n" if copy else " "
            rows.append((2 * k + copy, " ".join(head) + gap + gap.join(passage) + " " + " ".join(tail)))
            cut = " ".join(head) + gap + " " + " ".join(tail)
            expected[2 * k + copy] = rows[-1][1] if passage is fifty else cut
    rows += [(10, None), (11, ""), (12, " \n"), (13, "é " * 50), (14, "one"), (15, " ".join(letters))]
    expected |= {10: None, 11: "", 12: " \n", 13: "é " * 50, 14: "one", 15: ""}
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["suffix_dedup"]
    assert {r.doc_id: r.text for r in stage(spark, docs, "").collect()} == expected


def test_passages_of_words_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    spans = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for i, t in texts.items()}
    passage = lambda i, k: b" ".join(texts[i][a:b] for a, b in spans[i][k : k + 51])
    seen = Counter(passage(i, k) for i in texts for k in range(len(spans[i]) - 50))
    kept = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs, words=51, chunk_bytes=100_000).collect()}
    for (i, t), mask in zip(texts.items(), suffix_dedup.brute_force(list(texts.values()), 400)):
        for k in range(len(spans[i]) - 50):
            if seen[passage(i, k)] > 1:
                mask[spans[i][k][0] : spans[i][k + 50][1]] = True
        assert kept[i] == np.frombuffer(t, np.uint8)[~mask].tobytes().decode("utf-8", "ignore"), i


FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swojej godności i swych praw. Są oni obdarzeni rozumem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
]
JUNK = ["%%%% 1234 x #### 99182 @@", "TWFuIGlzIGRpc3Rpbmd1aXNoZWQsIG5vdCBvbmx5IGJ5IGhpcyByZWFzb24sIGJ1dCBieSB0", "q 0 1 2 3 4 5 6 7 8 9", "zxqj vkwq xzzj qqkv wjxz kkqz vvxj zqwk jxvq kzwq xjvz qkzx"]


@pytest.mark.parametrize("languages", [("en",), ("en", "de"), ("de", "en", "es", "fr")])
def test_language_stage_drops_junk_and_foreign_texts(spark, languages):
    docs = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet").where(F.col("lang").isin(*languages))
    planted = [(-1 - k, t, None, "src0", len(t)) for k, t in enumerate(FOREIGN + JUNK)]
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long")), "")
    kept = {r.doc_id for r in kept.select("doc_id").collect()}
    assert [t for k, t in enumerate(FOREIGN + JUNK) if -1 - k in kept] == []
    clean = [r.doc_id for r in docs.where(r"text rlike '\\p{L}'").select("doc_id").collect()]
    assert np.mean([i in kept for i in clean]) > 0.99


def test_a_suffix_chunk_needs_little_memory_beside_its_bytes():
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=300)).encode() for _ in range(1100)]
    steps = suffix_dedup._Steps(400, 1, 51, 2, 42, 64)
    for family in (0, 1):
        suffix_dedup._hash_tables(family)
    tracemalloc.start()
    steps.publisher("publish_sample")((pa.scalar(0),), pa.table({"data": pa.array(texts, pa.binary())}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 * sum(map(len, texts))


def test_stages_hand_over_small_batches(spark):
    from vectorloom.llm import memory

    before = spark.conf.get(memory.BATCH)
    spark.conf.set(memory.BATCH, "10000")
    corpus_pipeline.cut_repeats(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(5), "")
    assert int(spark.conf.get(memory.BATCH)) <= memory.ROWS_PER_SLICE
    spark.conf.set(memory.BATCH, before)
