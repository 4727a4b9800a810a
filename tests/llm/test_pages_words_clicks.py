"""Main text of pages, spelling variants and click windows against plain definitions, with edge cases."""

import datetime as dt
import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF_MEDIUM, SF_SMALL
from vectorloom.llm import click_dedup, page_text, queries, spelling

# -- 11 page text --------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, tokens int, main string"


def pages(spark, rows):
    """Pages with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "h", 1, "m") for r in rows], PAGES)


def texts(df):
    found = defaultdict(list)
    for r in page_text.main_text(df).collect():
        found[r.page_id].append(r.text)
    return found


def test_page_text_of_the_tables(spark):
    for folder in (SF_SMALL, SF_MEDIUM):
        df = spark.read.parquet(f"{folder}/pages.parquet")
        given = {r.page_id: r.html for r in df.collect()}
        for r in queries.op11_page_text(spark, folder).collect():
            body = given[r.page_id].split("<article>")[1].split("</article>")[0]
            blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", body)]
            want = "\n\n".join(b for b in blocks if b)
            assert r.text == want and r.n_chars == len(want)


def unnamed(k, body):
    """A page of a site whose elements have no telling names: a list of links, a slogan and a varying text."""
    links = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(3 + k % 2))
    return f'<html><body><div><ul>{links}</ul></div><div class="a1"><p>Always the same slogan with quite a few words in it, on every page of the site.</p></div><div class="b1">{body}</div><footer>contact {k}</footer></body></html>'


def test_page_text_without_telling_elements(spark):
    rows = [(k, f"http://www.site.example/{k}", unnamed(k, f"<h2>Title {k}</h2><p>Text {k * 7} of this page &amp; more.</p><p>Second part {k}</p>")) for k in range(6)]
    found = texts(pages(spark, rows))
    assert found == {k: [f"Title {k}\n\nText {k * 7} of this page & more.\n\nSecond part {k}"] for k in range(6)}


def test_page_text_leaves_out_what_is_not_the_article(spark):
    extras = (
        '<header><p>site name</p></header><nav>menu</nav><div class="cookie-notice">cookies</div><form>name <input></form><main><article class="with-sidebar"><header><h1>A &lt;b&gt; title</h1></header>'
        "<p>one\n  <b>two</b><br>three&nbsp;four<p>unclosed &eacute;<aside>side</aside><script>var x='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><div class='ad'>buy</div><ul><li>x<li>y</ul>"
        '<section id="comments"><p>first!</p></section><footer>by me</footer></article><div class="sidebar">more</div></main><p>outside</p><p title="a > b'
    )
    rows = [(1, "http://one.example/a", extras), (2, "http://two.example/a", extras), (3, "http://two.example/b", extras.replace("one", "other"))]
    want = "A <b> title\n\none two three four\n\nunclosed é\n\nx\n\ny"
    assert texts(pages(spark, rows)) == {1: [want], 2: [want], 3: [want.replace("one", "other")]}


def test_page_text_edges(spark, monkeypatch):
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    same = "<article><p>the same everywhere</p></article>"
    rows = [(0, None, None), (1, "", ""), (2, "no url", "plain text only"), (3, "http://h.example", same), (3, "http://h.example", same), (4, "http://h.example/2", same), (None, "http://h.example/3", same), (5, "http://long.example", long), (6, "http://[bad", "<article>a</article>"), (7, "http://h.example/4", "<p>no article here</p>")]
    found = texts(pages(spark, rows))
    assert found[0] == found[1] == [""] and found[2] == ["plain text only"] and found[3] == ["the same everywhere"] * 2 and found[4] == found[None] == ["the same everywhere"]
    assert found[5] == ["\n\n".join(["word & word"] * 50_000)] and found[6] == ["a"] and found[7] == ["no article here"]
    assert page_text.main_text(pages(spark, [])).count() == 0
    monkeypatch.setattr(page_text, "BROADCAST_TOKENS", -1)
    assert texts(pages(spark, rows)) == found


def test_occurrence_vectors_and_classes(spark):
    rows = [(k, "http://v.example", f"<div><ul>{'<li><i>x</i></li>' * (k + 1)}</ul><p>always</p></div>") for k in range(3)]
    classes = page_text.templates(pages(spark, rows)).collect()[0]
    found = defaultdict(list)
    for t in classes.tokens:
        found[t["class"]].append(t["token"])
    # once a page: div, ul, /ul, p, "always", /p, /div; as often as each other: li, i, x, /i, /li
    assert classes.host_pages == 3 and len(found[0]) == 7 and sorted(map(len, found.values())) == [5, 7]
    template = page_text.Template([t.asDict() for t in classes.tokens])
    tokens, blocks = page_text.read_page(rows[2][2])
    slots = template.slots(tokens, blocks)
    assert len(blocks) == 4 and len(set(slots[:3])) == 1 and slots[3] != slots[0] and {b.path for b in blocks} == {blocks[0].path}
    assert [template.fixed(b) for b in blocks] == [True] * 4


def test_longest_rise():
    assert page_text._rising([]) == []
    rng = random.Random(3)
    for _ in range(200):
        ranks = [rng.randrange(12) for _ in range(rng.randrange(9))]
        best = [1] * len(ranks)
        for k in range(len(ranks)):
            best[k] = 1 + max((best[j] for j in range(k) if ranks[j] < ranks[k]), default=0)
        found = page_text._rising(list(enumerate(ranks)))
        assert len(found) == max(best, default=0) and all(ranks[a] < ranks[b] for a, b in zip(found, found[1:]))


# -- 12 spelling ---------------------------------------------------------------------------------

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, shortest=6, seldom=5):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= seldom}


def plain_near(words):
    near, held = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            if (shorter := w[:k] + w[k + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
            held[w[:k] + "*" + w[k + 1 :]].add(w)
    for group in held.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_variants(rows):
    words = plain_words(rows)
    near = plain_near(words)
    forms = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {(w, forms.get(w), root(w), n, len(near[w]), words[forms[w]] if w in forms else None) for w, n in words.items()}


def variants(df):
    rows = spelling.spelling_variants(df).collect()
    assert len(rows) == len({r.word for r in rows})
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_of_the_tables(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert variants(df) == plain_variants([(r.doc_id, r.text) for r in df.collect()])


def test_spelling_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_MEDIUM}/documents.parquet'")
    found = con.execute(queries.oracle_sql()["op12_spelling"])
    names = [d[0] for d in found.description]
    got = {tuple(r) for r in queries.op12_spelling(spark, SF_MEDIUM).select(*names).collect()}
    assert got == set(found.fetchall()) and len(got) > 1000


def test_near_words_of_anagrams_and_random_words(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abÀ×ÿ") for _ in range(rng.randrange(6, 9))) for _ in range(400)}
    words |= {"".join(rng.sample("abcdefgh", 8)) for _ in range(200)} | {"a" * 6, "a" * 7, "a" * 8}
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    near = plain_near(words)
    want = {(a, b) for a in words for b in near[a] if a < b}
    assert len(pairs) == len(want) and {(r.a, r.b) for r in pairs} == want


def test_near_words_are_never_broadcast(spark):
    words = spark.createDataFrame([("abcdef", 5), ("abcdeg", 5)], "word string, n long")
    assert "Broadcast" not in spelling.near_pairs(words)._jdf.queryExecution().executedPlan().toString()


def test_spelling_edges(spark):
    chain = "levelone " * 700 + "leveltwo " * 130 + "levelone1 " + "levelonf " * 140 + "levelong " * 28 + "levelongs " * 5 + "LEVELONGS "
    rows = [(1, chain), (None, "àéîõüÿ " * 6), (2, None), (3, ""), (3, "12 !"), (4, "x" * 300_000 + " "), (4, ("y" * 100_000 + " ") * 6), (5, "tieaaaab " * 50 + "tieaaaac " * 50 + "tieaaaad " * 6), (5, "tieaaaab " * 50)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, word string")
    assert variants(df) == plain_variants(rows)
    assert variants(df.limit(0)) == set()


# -- 13 clicks -----------------------------------------------------------------------------------

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour long, hash string"
START = dt.datetime(1970, 1, 1)


def micros(t):
    return (t - START) // dt.timedelta(microseconds=1)


def plain_windows(rows, batches=12):
    copies = []
    for click, ts, arrived, client, kind, value, props in rows:
        if click is None or arrived is None:
            continue
        for j in range(click % 3 + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            said = [client, kind, None if value is None else math.floor(100 * value + 0.5), None if ts is None else micros(ts), props, c % 3]
            copies.append((hour + c // 10 % 200, click, hour, hashlib.sha256("|".join("" if x is None else str(x) for x in said).encode()).hexdigest()))
    if not copies:
        return []
    low, high = min(copies)[0], max(copies)[0]
    fed = [[] for _ in range(batches)]
    for place, click, hour, digest in copies:
        fed[(place - low) * batches // (high - low + 1)].append((click, hour, digest))
    return fold(fed)


def fold(fed):
    most, opened, out = None, {}, []
    for b, batch in enumerate(fed):
        for click, hour, digest in sorted(batch):
            if most is not None and hour < most - 48:
                continue
            w = opened.get(click)
            if w is not None and hour <= w[0] + 72:
                w[2] += 1
                w[3] += digest != w[1]
                w[4] += zlib.crc32(digest.encode()) if digest != w[1] else 0
                continue
            if w is not None:
                out.append((click, w[0], b, *w[2:], w[1]))
            opened[click] = [hour, digest, 0, 0, 0]
        most = max([h for _, h, _ in batch] + ([most] if most is not None else []), default=None)
        for click, w in list(opened.items()):
            if b == len(fed) - 1 or most is not None and w[0] + 72 < most - 48:
                out.append((click, w[0], b, *w[2:], w[1]))
                del opened[click]
    return sorted(out)


def windows(df):
    return sorted((r.click_id, r.start_hour, r.closed_batch, r.n_repeats, r.n_conflicts, r.conflict_crc, r.hash) for r in df.collect())


def test_click_windows_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/clicks.parquet").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").collect()]
    assert windows(queries.op13_click_dedup(spark, SF_SMALL)) == plain_windows(rows)


def test_click_windows_edges(spark):
    t = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    rows = [(5, t, t, 1, "a", 1.0, "{}")] * 3 + [(5, t, t + k * day, 1, None, None, "x|y") for k in range(40)] + [(-4, None, t + 9 * day, None, None, None, None), (None, t, t, 1, "a", 1.0, ""), (7, t, None, 1, "a", 1.0, ""), (8, t, t - 20_000 * day, 2, "b", -3.456, "é")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], CLICKS)
    assert windows(click_dedup.dedup_clicks(df)) == plain_windows(rows)
    assert windows(click_dedup.dedup_clicks(df.limit(0))) == [] and windows(click_dedup.dedup_clicks(df.where("click_id is null"))) == []


def test_operators_chained_over_random_batches():
    """Both state functions without Spark: shards with and without rows, many windows of one key, equal rows."""
    rng = random.Random(6)
    for _ in range(30):
        fed = [[(rng.randrange(6), 60 * b + rng.randrange(200), hashlib.sha256(bytes([rng.randrange(3)])).hexdigest()) for _ in range(rng.randrange(25))] for b in range(5)]
        kept, counts, out, most = np.zeros(0, click_dedup._OPEN), np.zeros(0, click_dedup._COUNTS), [], None
        for b, batch in enumerate(fed):
            rows = Counter((c, h, d) for c, h, d in batch if most is None or h >= most - 48)
            most = max([h for _, h, _ in batch] + ([most] if most is not None else []), default=None)
            bound = click_dedup.NO_BOUND if b == 4 else -1 if most is None else most - 48
            frame = pd.DataFrame([(c, h, bytes.fromhex(d), n, None, b) for (c, h, d), n in rows.items()] + [(None, None, None, 0, bound, b)], columns=["key", "hour", "hash", "n", "close_below", "batch"])
            events, kept = click_dedup.advance(frame, kept, 72)
            done, counts = click_dedup.accumulate(events, counts)
            out += [tuple(r) for r in done[["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"]].itertuples(index=False)]
        assert sorted(out) == fold(fed) and not len(kept) and not len(counts)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_hours_are_those_of_utc(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = [dt.datetime(2024, 3, 10, 2, 30, 1, 234567), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), None]
        df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, t timestamp_ntz")
        found = {r.k: r.m for r in df.select("k", click_dedup.utc_micros(df, "t").alias("m")).collect()}
        assert found == {k: None if t is None else micros(t) for k, t in enumerate(times)}
        zoned = spark.sql("select timestamp'2024-03-10 12:00:00Z' as t")
        assert zoned.select(click_dedup.utc_micros(zoned, "t").alias("m")).first().m == micros(dt.datetime(2024, 3, 10, 12))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
