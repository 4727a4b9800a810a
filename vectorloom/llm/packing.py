"""Packing documents into fixed-capacity token sequences by minimum bin slack.

Every document is tokenised once. Its ids, followed by an end id, are cut at multiples of the
capacity; the piece that is left over is the item to pack. As an item matters only by its length,
the packer works on the histogram of lengths, which has at most ``capacity`` entries however many
documents there are. Each step opens a window with the longest length left and asks a bitset
subset-sum for the multiset of remaining lengths that comes closest to filling it; backtracking
gives the counts. The pattern found is repeated as often as the histogram allows, so the plan has a
number of steps that depends on the capacity alone (below ``sum(capacity / l)``).

Edge cases: a null text counts as empty (one piece that holds only the end id); repeated rows are
packed once each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.memory import releasing
from vectorloom.session import checkpoint

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
ASSIGNED = "length long, lo long, hi long, per_sequence long, sequence_base long, offset_base long"


@functools.lru_cache(maxsize=4)
def _whole_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _encoder(name: str):
    """text -> ids as the named tokenizer file gives them.

    The byte-level BPE file exists in two forms with the same merges: the rank form splits and merges
    about four times as fast. Texts that the rank form cannot express (those holding the special
    string, or which its splitter refuses) go through the other form.
    """
    import json

    import tiktoken

    path = public_tokenizers.path(f"{name}.json")
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if not any(s in text for s in special):
            try:
                return fast.encode_ordinary(text)
            except ValueError:
                pass
        return _whole_tokenizer(path).encode(text, add_special_tokens=False).ids

    return encode


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of each document: full pieces of ``capacity`` ids, then the remainder."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*rows)) or [[]] * 5
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(tokenise), PIECES)


def _fill(counts: dict[int, int], target: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Bitset of the sums up to ``target`` that the multiset reaches, and the layers to walk back."""
    mask, reach, layers = (1 << (target + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= target), reverse=True):
        left, take = min(counts[length], target // length), 1
        while left > 0:
            take = min(take, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> target & 1:
            break
    return reach, layers


def _walk_back(layers: list[tuple[int, int, int]], total: int) -> dict[int, int]:
    used: dict[int, int] = {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def minimum_slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern: length -> pieces per sequence, number of sequences)], together using every piece.

    A window that cannot be filled to within 1/32 of the capacity ends at a power of two instead if
    one can be met exactly, as such a sequence needs no padding.
    """
    counts = {n: c for n, c in histogram.items() if c}
    plan = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        room = {n: c for n, c in counts.items() if c}
        reach, layers = _fill(room, capacity - first)
        best = reach.bit_length() - 1
        if capacity - first - best > capacity // 32:
            powers = [p - first for p in (capacity >> s for s in range(1, capacity.bit_length())) if p >= first and reach >> (p - first) & 1]
            best = max(powers, default=best)
        counts[first] += 1
        pattern = _walk_back(layers, best)
        pattern[first] = pattern.get(first, 0) + 1
        times = min(counts[n] // k for n, k in pattern.items())
        plan.append((pattern, times))
        for n, k in pattern.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return plan


def _assignment(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """Which ranks within a length go to which sequences and offsets."""
    rows, used, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            per, lo = pattern[length], used.get(length, 0)
            rows.append((length, lo, lo + per * times, per, sequence, offset))
            used[length] = lo + per * times
            offset += per * length
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and offset.

    Ranks within a length are dealt over salted groups, so a length that a third of all pieces share
    is numbered by many tasks; the salts' totals give each group its first rank.
    """
    spark = docs.sparkSession
    pieces = checkpoint(cut_pieces(docs, tokenizer, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    rows = _assignment(minimum_slack_plan(histogram, capacity))
    plan = spark.createDataFrame(rows, ASSIGNED)
    salts = max(256, sum(histogram.values()) // 1_000_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        salted.withColumn("place", F.row_number().over(within) - 1)
        .join(firsts, ["length", "salt"])
        .withColumn("rank", F.col("first") + F.col("place"))
    )
    p, q = ranked.alias("p"), F.broadcast(plan).alias("q")  # the plan's size is bounded by the capacity
    placed = p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    turn = F.col("rank") - F.col("lo")
    per = F.col("per_sequence")
    return placed.select(
        "doc_id",
        "start",
        F.col("p.length").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence_base") + F.floor(turn / per)).alias("sequence_id"),
        (F.col("offset_base") + (turn % per) * F.col("p.length")).alias("offset"),
    )
