"""The training-data operators against brute force, round trips and held-out accuracy, with edge cases."""

import gzip
import hashlib
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from tests.conftest import SF_MEDIUM, SF_SMALL
from vectorloom.llm import chat, cotraining, fingerprints, language_id, media, minmax_dedup, mixing, packing, queries, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, band int, row string"
LONG = "lorem ipsum dolor sit amet " * 40_000
EDGES = [(0, None), (1, ""), (2, "a b c"), (3, "a b c"), (4, "éß\u00a0漢字 \U0001f600"), (5, "   \n\t "), (6, LONG), (7, LONG), (8, "<|endoftext|> x"), (9, "1234 5678"), (None, "no id at all here now"), (3, "a b c")]


def documents(spark, rows, sources=("src0", "src1", None)):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en" if i and i % 2 else None, sources[k % len(sources)], None if t is None else len(t), "x", 1, "y") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def edges(spark):
    return documents(spark, EDGES).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# -- 1 token counts ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_tokenizer():
    vocabulary = token_counts.load_vocabulary("piece_bpe_32k.model")
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_token_counts(spark, small, edges, empty, reference_tokenizer):
    for df in (small, edges.where("doc_id <> 6 and doc_id <> 7")):
        for r in token_counts.count_tokens(df).join(df.select("doc_id", "text"), "doc_id").collect():
            assert r.n_tokens == len(reference_tokenizer.encode(r.text or "", add_special_tokens=False).ids), r.doc_id
    assert token_counts.count_tokens(empty).count() == 0
    assert token_counts.count_tokens(edges).count() == len(EDGES)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab the▁<s>0x. \n\té漢\U0001f600")), max_size=60))
def test_token_counts_of_random_strings(text):
    vocabulary = token_counts.load_vocabulary("piece_bpe_32k.model")
    if not hasattr(test_token_counts_of_random_strings, "pair"):
        t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
        t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        test_token_counts_of_random_strings.pair = (t, token_counts.UnigramCounter(vocabulary))
    t, counter = test_token_counts_of_random_strings.pair
    assert counter.count(text)[0] == len(t.encode(text, add_special_tokens=False).ids)


def test_vocabulary_whose_pieces_cross_words():
    vocabulary = [("<unk>", 0.0), ("a", -3.0), ("b", -3.0), ("▁", -2.0), ("a▁b", -1.0)]
    assert token_counts.UnigramCounter(vocabulary).count("a b") == (2, -3.0)


# -- 2 chat formatting ---------------------------------------------------------------------------


def turn_digests(rows):
    turns = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest()
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check_chat(df, chunk=1 << 20):
    formatted = chat.format_conversations(df, chunk_chars=chunk)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted, presorted=True).collect()}
    again = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for r in df.collect():
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or "", r.role, r.text))
    expected = {k: turn_digests([(x[6], x[7]) for x in sorted(v, key=lambda x: x[:6])]) for k, v in by.items()}
    assert found == expected == again


def test_chat_query(spark):
    df = queries.op2_chat_format(spark, SF_SMALL)
    rows = {r.conv_id: r for r in df.collect()}
    probe = turn_digests([("user", queries.PROBE_TEXT), ("assistant", queries.PROBE_TEXT)])
    r = rows[queries.PROBE_ID]
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == probe
    check_chat(spark.read.parquet(f"{SF_SMALL}/conversations.parquet"))


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, chunk int"
    bad = "\\</turn>\n<turn user\nx\\"
    rows = [(1, 0, "user", None, 1), (1, 1, "assistant", "", 1), (1, 2, "assistant", bad, 1), (1, 3, None, bad, 1), (1, 4, "we\nird\\<turn", "\\\\", 1), (2, None, "assistant", "\n", 1), (None, 0, "assistant", "x", 1), (3, 0, "assistant", "y", 1), (3, 0, "assistant", "y", 1)]
    df = spark.createDataFrame(rows, schema)
    check_chat(df)
    for chunk in (1, 7, 20):
        check_chat(df, chunk)
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=list("ab\\<turn/> \n"), max_size=12), st.text(alphabet=list("ab\\<turn/> \n"), max_size=30)), max_size=5), st.integers(1, 9))
def test_reader_inverts_the_template(turns, cut):
    text = "".join(t for t, _ in chat.compile_template(chat.TEMPLATE)(iter([{"role": r, "text": t} for r, t in turns])))
    seen = []
    reader = chat.TurnReader(lambda role, t: seen.append((role, t)))
    for at in range(0, len(text), cut):
        reader.feed(text[at : at + cut])
    assert seen == turns


def test_template_language():
    render = lambda t, m=(): "".join(x for x, _ in chat.compile_template(t)(iter(m)))
    messages = [{"role": "a", "text": " X "}, {"role": "b", "text": "Y"}]
    assert render("{% for m in messages %}{% if loop.first %}<{% elif m.role in 'bc' and not loop.first %}|{% else %}?{% endif %}{{ m['text'] | trim | lower }}{% if loop.last %}>{% endif %}{% endfor %}", messages) == "<x|y>"
    assert chat.fold(chat.parse("{% if 1 == 2 %}a{% else %}b{{ 'c' ~ (1 + 2) }}{% endif %}d")) == [("text", "bc3d")]
    assert [k for k, *_ in chat.fold(chat.parse("x{{ 'y' | upper }}{{ m.text }}z"))] == ["text", "put", "text"]
    for bad in ("{{ x", "{% for m %}{% endfor %}", "{{ a.b() }}", "{{ a | eval }}", "{% if x %}", "{% include x %}", "{{ 'a }}", "{{ a b }}"):
        if bad == "{{ x":
            assert render(bad) == bad
            continue
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        render("{{ messages.__class__ }}")
    with pytest.raises(chat.TemplateError):
        render("{{ nothing }}")


# -- 3 fingerprints ------------------------------------------------------------------------------


def jaccard_words(a, b, width=5):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(spark):
    df = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet")
    rows = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(df).collect()}
    texts = texts_of(df)
    order = sorted(texts)
    gaps, by_text = [], {}
    for k, i in enumerate(order):
        t, nxt, r = texts[i], texts[order[(k + 1) % len(order)]], rows[i]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        gaps += [r.near_edited - jaccard_words(t, edited), r.near_next - jaccard_words(t, nxt)]
    assert len(rows) == len(order) and np.abs(np.mean(gaps)) < 0.01 and np.sqrt(np.mean(np.square(gaps))) < 0.05


def test_fingerprint_edges(spark, edges, empty):
    rows = fingerprints.fingerprint_with_edits(edges).collect()
    assert len(rows) == len(EDGES)
    by = defaultdict(set)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by[r.doc_id].add(r.fingerprint)
    assert by[0] == by[1] == by[5] == {""} and by[2] == by[3] and len(by[3]) == 1
    assert fingerprints.fingerprint_with_edits(empty).count() == 0
    one = fingerprints.fingerprint_with_edits(documents(spark, [(5, "only one text")])).first()
    assert one.near_next == 1.0
    far = documents(spark, [(-(2**62), "p q"), (0, "r s"), (2**62, "t u"), (2**61, "v w")])
    found = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_with_edits(far).collect()}
    assert found[0] == hashlib.sha256(b"r v").hexdigest()
    assert found[2**62] == hashlib.sha256(b"t p").hexdigest()


# -- 4 suffix dedup ------------------------------------------------------------------------------


def check_repeats(spark, rows, **options):
    df = documents(spark, rows)
    result = suffix_dedup.repeat_digest(df, **options).collect()
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result)
    texts = [(t or "").encode() for _, t in rows]
    passages = Counter((i, int(mask.sum())) for (i, _), mask in zip(rows, suffix_dedup.brute_force(texts, 10**9, words=True)))
    assert Counter((r.doc_id, r.n_passage_bytes) for r in result) == passages
    assert all(r.has_repeat == (r.n_removed + r.n_passage_bytes > 0) for r in result)
    expected = Counter()
    for (i, _), t, mask in zip(rows, texts, suffix_dedup.brute_force(texts, options.get("length", 400))):
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        expected[i, len(t), int(mask.sum()), spans, hashlib.sha256(bytes(b for b, m in zip(t, mask) if not m)).hexdigest()] += 1
    assert found == expected


def test_suffix_dedup_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdeé "), n))
    shared, other = word(401), word(399)
    rows = [(0, word(300) + shared + word(200)), (1, word(50) + shared), (2, other + word(100)), (3, word(9) + other), (4, "ab" * 500), (5, "x" * 399), (6, "x" * 400), (7, "x" * 401), (8, None), (9, ""), (10, word(700)), (11, word(20) + shared[:399] + "#" + shared[1:])]
    rows.append((12, rows[10][1]))
    rows.append((12, rows[10][1]))
    rows.append((None, word(30) + rows[10][1][100:600]))
    check_repeats(spark, rows)
    check_repeats(spark, rows, chunk_bytes=1500)
    check_repeats(spark, rows, length=150, r=1, chunk_bytes=2000)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_steps_match_brute_force_on_overlapping_passages(seed):
    """All steps over several chunks without Spark: passages cut, joined and repeated at random."""
    rng = np.random.default_rng(seed)
    length, chunks, buckets = 150, 1 + seed % 4, 3
    pool = [rng.integers(97, 97 + (2 if k == 0 else 26), int(rng.integers(80, 900)), dtype=np.uint8).tobytes() for k in range(6)] + [b"ab" * 300, b"z" * 400]

    def text():
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            source = pool[rng.integers(len(pool))]
            at = int(rng.integers(0, len(source)))
            parts.append(source[at : at + int(rng.integers(1, 500))])
        return b"".join(parts)

    texts = [text() for _ in range(24)]
    texts += texts[:3]
    steps = suffix_dedup._Steps(length, 1, None, buckets, 40, 64)
    tables = {c: pa.table({"data": pa.array(texts[c::chunks], pa.binary())}) for c in range(chunks)}
    marks = suffix_dedup._marker(1)((pa.scalar(0),), pa.table({"chunk": [0], "payload": [suffix_dedup.pack_names(np.array([1], np.uint64), np.array([True]))]})).slice(0, 0)
    for step, publish in enumerate(("publish_sample", "publish_segments", "publish_remaining"), 1):
        run = steps.publisher(publish)
        out = pa.concat_tables([run((pa.scalar(c),), t) if step == 1 else run((pa.scalar(c),), t, marks.filter(pc.equal(marks["chunk"], c))) for c, t in tables.items()])
        for bucket in sorted(set(out["bucket"].to_pylist())):
            marks = pa.concat_tables([marks, suffix_dedup._marker(step, choose=step == 2)((pa.scalar(bucket),), out.filter(pc.equal(out["bucket"], bucket)))])
    found: dict[int, bytes] = {}
    for c, t in tables.items():
        chunk, (gone,) = steps.removed(t, marks.filter(pc.equal(marks["chunk"], c)))
        for k, at in enumerate(chunk.text_of_row):
            found[c + k * chunks] = gone[chunk.starts[at] : chunk.ends[at]].tobytes()
    for k, mask in enumerate(suffix_dedup.brute_force(texts, length)):
        assert found[k] == mask.tobytes(), k


@pytest.mark.parametrize("r", [1, 2, 3])
def test_difference_cover(r):
    v, d = suffix_dedup.difference_cover(r)
    assert len({(a - b) % v for a in d for b in d}) == v


def test_remove_repeats(spark, small, edges, empty):
    out = suffix_dedup.remove_repeats(small, chunk_bytes=100_000)
    assert out.columns == small.columns and out.count() == small.count()
    kept, texts = texts_of(out), texts_of(small)
    ids = sorted(texts)
    for i, mask in zip(ids, suffix_dedup.brute_force([texts[i].encode() for i in ids])):
        left = np.frombuffer(texts[i].encode(), np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
        assert kept[i] == left
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0
    result = suffix_dedup.remove_repeats(edges)
    assert result.columns == edges.columns and result.count() == len(EDGES)
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.repeat_digest(empty).count() == 0


def test_names_round_trip():
    names = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    twice = names % 3 == 0
    for checks in (None, names * np.uint64(3)):
        a, b, c = suffix_dedup.unpack_names(suffix_dedup.pack_names(names, twice, checks))
        assert (a == names).all() and (b == twice).all() and (c == (0 if checks is None else checks.astype(np.uint32))).all()
    a, b, c = suffix_dedup.unpack_names(suffix_dedup.pack_names(names[:1], twice[:1]))
    assert (a == names[:1]).all()


def test_names_of_different_checks_are_different():
    names = np.array([5, 9], np.uint64)
    blob = lambda checks: suffix_dedup.pack_names(names, np.zeros(2, bool), np.array(checks, np.uint64))
    table = pa.table({"chunk": [3, 1, 2], "payload": [blob([1, 7]), blob([2, 7]), blob([3, 8])]})
    out = suffix_dedup._marker(2, choose=True)((pa.scalar(0),), table).to_pydict()
    bits = dict(zip(out["chunk"], ([np.unpackbits(np.frombuffer(b, np.uint8).reshape(2, 1), axis=1, count=2).tolist() for b in out["bits"]])))
    assert bits == {1: [[0, 1], [1, 1]], 2: [[0, 0], [1, 1]], 3: [[0, 1], [1, 0]]}


# -- 5 language ID -------------------------------------------------------------------------------


def test_language_accuracy(spark):
    df = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet")
    rows = language_id.identify(df).join(df.select("doc_id", "lang", "text"), "doc_id").collect()
    out = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_language_edges(spark, edges, empty, small):
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(edges).collect()}
    for i in (0, 1, 5, 9):
        assert (i, "und", 0.0) in rows
    assert language_id.identify(empty).count() == 0
    unlabelled = language_id.identify(small.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    kept = language_id.accept(small.withColumn("row", F.lit(1)))
    assert kept.columns == [*small.columns, "row"] and 0.9 * small.count() < kept.count() <= small.count()
    assert language_id.accept(empty).count() == 0


def test_prediction_ignores_metadata(spark, small):
    net = language_id.fit(small)
    a = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(small, net).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(small.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")), net).collect()}
    assert a == b


# -- 6 packing -----------------------------------------------------------------------------------


def check_packing(df, capacity=2048):
    rows = packing.pack(df, capacity=capacity).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = df.select("doc_id", "text").collect()
    ids = {}
    for r in texts:
        ids[r.doc_id] = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
    copies = Counter(r.doc_id for r in texts)
    covered, places = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for i, pieces in covered.items():
        assert sum(n for _, n in pieces) == copies[i] * len(ids[i])
        assert Counter(k for s, n in pieces for k in range(s, s + n)) == Counter({k: copies[i] for k in range(len(ids[i]))})
    padding = 0
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(len(v) * copies[i] for i, v in ids.items()))


def test_packing(spark, edges, empty):
    df = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet")
    assert check_packing(df) < 0.02
    check_packing(edges.where("doc_id is not null and doc_id <> 6"))
    check_packing(edges.where("doc_id is not null and doc_id < 4"), capacity=4)
    assert packing.pack(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=12))
def test_plan_uses_every_piece(histogram):
    used = Counter()
    for pattern, times in packing.minimum_slack_plan(histogram, 64):
        assert sum(n * k for n, k in pattern.items()) <= 64 and times > 0
        for n, k in pattern.items():
            used[n] += k * times
    assert used == Counter(histogram)


def test_plan_fills_as_well_as_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(4)
    for _ in range(30):
        items = sorted(rng.integers(1, 40, 8).tolist(), reverse=True)
        pattern, _ = packing.minimum_slack_plan(Counter(items), 64)[0]
        rest = items[1:]
        best = max(sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k) if sum(c) <= 64 - items[0])
        total = sum(n * k for n, k in pattern.items())
        assert total == items[0] + best or total & (total - 1) == 0


# -- 7 near-dedup --------------------------------------------------------------------------------


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{rng.integers(5000)}" for _ in range(n)) for n in (12, 30, 90, 200)]
    rows = []
    for t in base:
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            words = t.split()
            for k in rng.permutation(len(words))[:edits]:
                words[k] = f"Edit{rng.integers(10**9)}"
            rows.append(" ".join(words).upper() if edits == 1 else " ".join(words))
    rows += ["", "a", "A", "a b", "b a", "a\u00a0b", "É f", "é f", None]
    texts = {3 * i + 1: t or "" for i, t in enumerate(rows)}
    df = documents(spark, [(3 * i + 1, t) for i, t in enumerate(rows)])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(df).collect()}
    assert found == brute_components(texts)


def test_near_duplicates_of_documents(spark, small):
    rows = minmax_dedup.near_duplicates(small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts_of(small))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicate_edges(spark, edges, empty):
    rows = minmax_dedup.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES) and sum(r.doc_id is None for r in rows) == 1
    by = {r.doc_id: r.component_id for r in rows}
    assert by[0] == 0 and by[1] == 1 and by[5] == 5 and by[2] == by[3] == 2 and by[7] == 6
    kept = minmax_dedup.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted(Counter(r.doc_id for r in kept.collect()).items(), key=str) == sorted({0: 1, 1: 1, 2: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1, None: 1}.items(), key=str)
    assert minmax_dedup.near_duplicates(empty).count() == 0


def test_min_max_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = pool[:200], pool[50:250]
        (la, ha), (lb, hb) = minmax_dedup.min_max(a), minmax_dedup.min_max(b)
        gaps.append(np.concatenate([la == lb, ha == hb]).mean() - 150 / 250)
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 1.1 * np.sqrt(0.6 * 0.4 / (2 * minmax_dedup.PERMUTATIONS))


# -- 8 mixing ------------------------------------------------------------------------------------


def test_mixing(spark, edges, empty):
    df = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet")
    weights = {"src0": 0.4, "src1": 0.1}
    rows = mixing.mix(df, weights, other_weight=0.5, size_factor=6.0).collect()
    size = Counter()
    for r in rows:
        size[r.source if r.source in weights else None] += len(r.text)
    total = sum(size.values())
    assert abs(size["src0"] / total - 0.4) < 0.04 and abs(size["src1"] / total - 0.1) < 0.03
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    per = Counter(r.doc_id for r in rows)
    assert all(per[r.doc_id] == r.n_copies for r in rows)
    found = mixing.mix(edges, {"src0": 1.0}, other_weight=1.0, size_factor=3.0)
    assert found.columns[: len(edges.columns) - 1] == [c for c in edges.columns if c != "copy"]
    assert mixing.mix(empty, {"src0": 1.0}, 1.0).count() == 0


def test_mixing_reaches_the_weight_of_a_tiny_source(spark):
    rows = [(i, "a b c d e " * 20) for i in range(200)] + [(1000 + i, "x") for i in range(40)]
    df = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") >= 1000, F.lit("src5")).otherwise(F.lit("web")))
    rate = 0.5 * (200 * 200 + 40) / 40
    found = {r.doc_id: r.n for r in mixing.mix(df, {"src5": 0.5}, other_weight=0.5).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    tiny = np.array([found[1000 + i] for i in range(40)])
    assert abs(tiny.mean() - rate) < 5 * np.sqrt(rate / 40) and 0.4 < tiny.var() / rate < 1.9


def test_mixing_of_unnamed_sources_keeps_the_size(spark):
    df = documents(spark, [(i, "a b c d e ") for i in range(2000)], sources=("web", "books"))
    for other in (df, df.withColumn("source", F.lit("src3"))):
        assert abs(mixing.mix(other, queries.WEIGHTS, queries.OTHER_WEIGHT).count() - 2000) < 5 * np.sqrt(2000)
    assert mixing.mix(df, {"src0": 1.0}, other_weight=0.0).count() == 0


def test_mixing_matches_duckdb(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_MEDIUM}/documents.parquet'")
    docs = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet")
    # the last has a rate above part_rate and weights without a source
    for weights, other, factor in ((queries.WEIGHTS, queries.OTHER_WEIGHT, 1.0), ({"src0": 0.3}, 0.0, 1.0), ({"src5": 0.9, "nowhere": 0.4}, 0.1, 20.0)):
        expected = sorted(con.execute(mixing.oracle_sql(weights, other, factor)).fetchall())
        found = mixing.mix(docs, weights, other, factor).select("doc_id", "source", "copy", "n_copies", "shuffle_key")
        assert sorted(tuple(r) for r in found.collect()) == expected


# -- 9 media -------------------------------------------------------------------------------------


def test_media_round_trip(spark, small, edges, empty):
    for df in (small, edges):
        texts = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
        found = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media.media_digest(media.store_texts(df)).collect())
        expected = Counter()
        for i, t in texts:
            p = t + b"\0" * (max(64, -(-len(t) // 64) * 64) - len(t))
            w = media.wav_of(p)
            expected[i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest()] += 1
        assert found == expected
    assert media.media_digest(media.store_texts(empty)).count() == 0


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + b"\0" * 4 + struct.pack("<HH", 1, 1) + b"\0" + b"\x02\x02\x44\x01\0" + b"\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xda" + struct.pack(">H", 8) + b"\0" * 6 + b"ab\xff\x00c" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF"
OGG = b"OggS\0\x02" + b"\0" * 20 + b"\x01\x03abc" + b"OggS\0\x04" + b"\0" * 20 + b"\x01\x02de"
MP4 = struct.pack(">I", 16) + b"ftypisom" + b"\0" * 4 + struct.pack(">I", 8) + b"moov"
ITEMS = {"image/png": PNG, "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/pdf": PDF, "audio/ogg": OGG, "video/mp4": MP4, "audio/wav": media.wav_of(b"abcd"), "application/gzip": gzip.compress(b"hello" * 50)}


@pytest.mark.parametrize("kind", sorted(ITEMS))
def test_signatures(kind):
    item = ITEMS[kind]
    assert media.sniff(item) == [(0, len(item), kind)]
    if kind not in ("video/mp4", "application/pdf"):
        assert media.sniff(b"junk...." + item + b"tail")[0] == (8, len(item), kind)
    assert media.sniff(item[: len(item) - 3]) == []
    assert media.sniff(b"") == []


def test_gzip_of_much_content():
    for content in (b"2026-11-26 INFO request served in 12 ms\n" * 150_000, b"\0" * (1 << 20), b"\0" * (3 << 20), np.random.default_rng(3).bytes(300_000) + b"line\n" * 10**6):
        item = gzip.compress(content)
        assert media.sniff(item) == [(0, len(item), "application/gzip")]
        assert media.sniff(b"junk...." + item + b"tail" * 40_000)[0] == (8, len(item), "application/gzip")
        assert media.sniff(item[:-3]) == []


def test_zip_and_carving(spark, tmp_path):
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    assert media.sniff(b.getvalue()) == [(0, len(b.getvalue()), "application/zip")]
    df = spark.createDataFrame([(1, PNG + b"xx" + GIF, "image/gif", "q"), (2, b"text", "image/png", "q"), (3, None, None, "q")], "id long, bytes binary, declared string, carved string")
    rows = {r.id: r for r in media.sniff_column(df, "bytes", "declared").collect()}
    assert rows[1].media_type == "image/png" and rows[1].type_changed and [tuple(c) for c in rows[1].carved] == [(len(PNG) + 2, len(GIF), "image/gif", 0)]
    assert rows[2].media_type == media.UNKNOWN and rows[2].type_changed and rows[3].media_type is None


def test_items_inside_items():
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.png", PNG)
        z.writestr("b.wav", media.wav_of(b"...." + GIF + b"."))
    data = b"skip" + b.getvalue() + JPEG
    found = media.carve(data)
    assert [(kind, depth) for _, _, kind, depth in found] == [("application/zip", 0), ("image/png", 1), ("audio/wav", 1), ("image/gif", 2), ("image/jpeg", 0)]
    for start, length, kind, _ in found:
        assert media.sniff(data[start : start + length]) == [(0, length, kind)]
    assert media.sniff(data) == [(4, len(b.getvalue()), "application/zip"), (4 + len(b.getvalue()), len(JPEG), "image/jpeg")]
    cut = media.wav_of(PNG[:-3] + b"\0" * 9)  # an item that would end past the one around it
    assert media.carve(cut) == [(0, len(cut), "audio/wav", 0)]
    assert media.sniff(b.getvalue()[:-1]) == [(b.getvalue().find(PNG), len(PNG), "image/png"), (b.getvalue().find(b"RIFF"), len(media.wav_of(b"...." + GIF + b".")), "audio/wav")]


def test_many_signatures_in_one_archive():
    import io
    import time
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k in range(3000):
            z.writestr(f"{k}.txt", "x" * 2000)
    start = time.time()
    assert media.carve(b.getvalue()) == [(0, len(b.getvalue()), "application/zip", 0)]
    assert time.time() - start < 10


def test_media_feature_names_items_in_the_text(spark):
    df = spark.createDataFrame([(1, "ab " + PDF.decode() + " end"), (2, "plain"), (3, "ab " + PDF.decode() + " end")], "doc_id long, text string")
    rows = {r.doc_id: r.feature for r in media.media_digest(media.store_texts(df)).collect()}
    assert f"carved=1[3+{len(PDF)}:application/pdf]" in rows[1] and "carved=0[]" in rows[2] and rows[3] == rows[1]


def plain_pdf(data):
    """Length of the document at the start of the data, by searching all of it."""
    if not data[5:8].replace(b".", b"").isdigit():
        return 0
    mark = data.find(b"startxref")
    end = data.find(b"%%EOF", mark)
    if mark < 0 or end < 0 or not data[mark + 9 : end].strip().isdigit():
        return 0
    while (later := data.find(b"%%EOF", end + 5)) >= 0 and b"startxref" in data[end:later]:
        end = later
    return end + 5


def test_documents_are_found_from_one_index():
    rng = np.random.default_rng(12)
    pieces = [b"%PDF-1.4", b"%PDF-x", b"startxref", b"\n9\n", b"%%EOF", b" ", b"12", b"%%E", b"startx"]
    for _ in range(400):
        data = b"".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(0, 25)))
        found = media._Pdfs(data)
        for stop in {len(data), max(0, len(data) - 7), len(data) // 2}:
            for start in range(stop):
                if data[start : start + 5] == b"%PDF-":
                    assert found.length(start, stop) == plain_pdf(data[start:stop])


def test_many_document_marks_take_linear_time():
    began = time.process_time()
    assert media.carve(b"%PDF-1.4 " * 100_000) == [] and media.carve((b"%PDF-1.4 " * 20_000 + b"startxref x ") * 3 + b"%%EOF") == []
    assert time.process_time() - began < 20


# -- 10 quality ----------------------------------------------------------------------------------


def test_quality(spark):
    df, labels = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet"), spark.read.parquet(f"{SF_MEDIUM}/labels.parquet")
    rows = cotraining.classify(df, labels).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.toxic]
    bad = [r for r in rows if r.quality == 0 or r.toxic]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.3
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark, edges, empty, small):
    labels = spark.createDataFrame([(2, 1, 0), (3, None, None), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in cotraining.classify(edges, labels).collect()} == {0.5}
    assert cotraining.classify(edges, labels).count() == len(EDGES)
    assert cotraining.classify(empty, labels).count() == 0
    assert cotraining.classify(small, labels.limit(0)).where("not kept").count() == 0
