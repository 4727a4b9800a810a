"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each letter's code point, so anagrams share a key. Taking a letter away
subtracts its power: a word that lacks one letter of another has the other's key less that power, and two words that
differ by an exchanged letter have the same key once each has lost its own letter. So each word puts out its key and
its key less each of its distinct letters, and words that meet under a key differ by one addition, removal
or exchange of a letter as multisets. The order of the letters is verified by an edit distance of 1.

Where two words differ by one edit, the half of the letters before or after it is the same in both. Keys are
therefore joined together with either half, which parts large groups of anagrams without losing a pair, and a pair
that shares both halves' keys is taken from the first. Pairs are put out once and counted in both directions.

A word's form is its most frequent near word, if that is frequent enough; roots are found by pointer jumping, as
frequencies rise along forms. All steps are joins and aggregations of Spark on the table of words, and only
the count of the words goes over the texts, with sums in each task before its shuffle.

Edge cases: a null text has no words and a null id counts as empty; runs may be as long as they like; repeated
rows count again; ties in frequency go to the word that comes first in code-point order; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.minmax_dedup import forest_roots
from vectorloom.session import checkpoint

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, SELDOM, DAMAGE, RATIO = 6, 5, 199, 5
POWER = 5
#: Keys are sums modulo a prime below 2^61, so that no word is too long for a long.
MODULUS = (1 << 61) - 1


def word_counts(docs: DataFrame, shortest: int = SHORTEST, seldom: int = SELDOM, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of the runs of letters, one letter of which is deleted where ``damage`` divides the hash of document and run.

    Runs below ``shortest`` can't give words, so the pattern only finds longer ones, which it takes as a whole.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([{LETTERS}]{{{shortest},}})"))).alias("run"))
    lower = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + F.lit(2)))
    words = hashed.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seldom)


def letter_power(letter: Column) -> Column:
    """Power of a letter's code point."""
    code = F.ascii(letter).cast("long")
    product = code
    for _ in range(POWER - 1):
        product = product * code
    return product % MODULUS


def anagram_key(letters: Column) -> Column:
    """Sum of the powers of an array of letters."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, c: (total + letter_power(c)) % MODULUS)


def keyed(words: DataFrame) -> DataFrame:
    """(key, first, half, word, n, lost): each word under its own key and without each of its letters, with either half.

    half: the length of a half; first: whether the key goes with the leading one; lost: the letter taken away, or empty.
    """
    letters = words.withColumn("letters", F.split("word", "")).withColumn("letters", F.filter("letters", lambda c: c != ""))
    sums = letters.select("word", "n", anagram_key(F.col("letters")).alias("sum"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("letters"))).alias("lost"))
    less = F.when(F.col("lost") == "", F.col("sum")).otherwise(F.pmod(F.col("sum") - letter_power(F.col("lost")), F.lit(MODULUS)))
    half = ((F.length("word") - (F.col("lost") != "").cast("int")) / 2).cast("int")
    rows = sums.select("word", "n", "lost", less.alias("sum"), half.alias("half"), F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    part = F.when(F.col("first"), F.substr("word", F.lit(1), F.col("half"))).otherwise(F.substr("word", F.length("word") - F.col("half") + 1))
    return rows.select(F.xxhash64("sum", "first", part).alias("key"), "first", "half", "word", "n", "lost")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of all words with an edit distance of 1, a < b, each pair once.

    Spark sizes the keyed rows by the compressed table of words and without the explode, so it is told to merge, not to broadcast.
    """
    rows = keyed(words)
    left, right = (rows.select("key", "first", "half", F.col("word").alias(k), F.col("n").alias(f"n_{k}"), F.col("lost").alias(f"lost_{k}")) for k in ("a", "b"))
    both = left.hint("merge").join(right.hint("merge"), ["key", "first", "half"]).where("a < b and lost_a <> lost_b")
    new = F.col("first") | (F.substr("a", F.lit(1), F.col("half")) != F.substr("b", F.lit(1), F.col("half")))
    return both.where(new & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, seldom: int = SELDOM, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of the documents."""
    words = checkpoint(word_counts(docs, shortest, seldom))
    pairs = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n")))).alias("p")).select("p.*")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("other"))).alias("best"))
    formed = words.join(best, "word", "left").withColumn("able", -F.col("best.minus") >= ratio * F.col("n"))
    formed = checkpoint(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("able"), F.col("best.other")).alias("form"), F.when(F.col("able"), -F.col("best.minus")).alias("form_n")))
    roots = forest_roots(formed.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("root")))
    return formed.join(roots.withColumnRenamed("node", "word"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL: a table of remainders for the checksum, and words joined on what is left without a letter."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""WITH RECURSIVE tab AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) t FROM range(256) r(i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') id, unnest(regexp_extract_all(text, '[{LETTERS}]{{{SHORTEST},}}')) run FROM documents),
low AS (SELECT translate(run, '{upper}', '{lower}') run, id || ':' || translate(run, '{upper}', '{lower}') named, count(*) k FROM runs GROUP BY ALL),
hashed AS (SELECT run, k, xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(named)), lambda p: (instr('0123456789ABCDEF', hex(named)[2 * p + 1]) - 1) * 16 + instr('0123456789ABCDEF', hex(named)[2 * p + 2]) - 1), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) h FROM low, tab),
cut AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT n FROM cut WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(k) >= {SELDOM}),
gone AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) p FROM words)),
near AS (SELECT a.word, b.word other, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON w.word = g.rest UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON w.word = g.rest),
best AS (SELECT word, count(*) n_near, min_by(other, (-n, other)) other, max(n) top FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN top >= {RATIO} * n THEN other END form, CASE WHEN top >= {RATIO} * n THEN top END form_n FROM words LEFT JOIN best USING (word)),
walk(word, here) AS (SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.here AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word JOIN formed e ON e.word = w.here AND e.form IS NULL"""
