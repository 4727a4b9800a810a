"""Near-duplicate components by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so half
as many hash evaluations are needed for a signature of a given length, and as the two are negatively
correlated the agreement of signatures has a lower variance at the same mean. Bands of ``rows`` values
are hashed; two documents of similarity 0.75 share none of the 64 bands with probability 3e-8.

Links are confirmed on the full sets, without listing the pairs of a group:

1. Documents with equal sets form a class; one representative goes on.
2. In every band bucket the smallest representative leads. Each representative is checked against the
   leader it shares most bands with. Confirmed links lead to smaller ids only, so their roots, found by
   pointer jumping, give first components. A group of near copies is settled here, by one link per member.
3. For documents in buckets whose members still lie in different components, shingles that no other of
   these documents has are counted. Two documents share at most what is left of either, which rules out
   most of those that have only a passage, or a heavily edited original, in common.
4. Their other leaders are checked, where sizes and packed sketches allow (688 of 1024 low bytes must
   agree; a pair of 0.75 falls below with a probability of about 1e-9), and components are joined.
5. In buckets that are still mixed, the pairs across components that pass the same tests are checked.

So every pair that shares a band is confirmed, ruled out by its signature or sizes, or already connected.

Sets are made anew from the texts of the documents that need checking, found by a join on the id that
broadcasts the ids only if there are at most ``BROADCAST_IDS``.

Edge cases: without words or text a document has an empty set and is linked with nothing; with fewer
words than a shingle its whole sequence is one shingle; repeated rows share a class; a row without id
cannot name a component: it is not linked and returned with a null component; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.memory import releasing
from vectorloom.session import checkpoint, discard

WIDTH, ROWS, BANDS = 5, 5, 64
PERMUTATIONS = ROWS * BANDS // 2
NUMERATOR, DENOMINATOR = 75, 100
SKETCH, LEAST_EQUAL = 256, 150
WIDE, WIDE_EQUAL = 1024, 688
BLOCK = 1024
BROADCAST_IDS = 500_000
SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>"


@functools.lru_cache(maxsize=4)
def _multipliers(count: int, seed: int) -> np.ndarray:
    values, state, mask = [], seed, (1 << 64) - 1
    for _ in range(count):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        values.append((z ^ (z >> 31)) | 1)
    return np.array(values, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of A-Z-lower-cased words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    weights = _multipliers(width + 1, 11)
    size = min(width, len(words))
    sums = np.full(len(words) - size + 1, (size * int(weights[width])) % (1 << 64), dtype=np.uint64)
    for k in range(size):
        sums += hashed[k : len(words) - size + 1 + k] * weights[k]
    return np.unique(_mix(sums))


def min_max(hashes: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a non-empty set under each permutation."""
    factors = _multipliers(permutations, 23)[:, None]
    low = high = None
    for at in range(0, len(hashes), 1024):
        values = hashes[None, at : at + 1024] * factors
        a, b = values.min(axis=1), values.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Hash of each band; half of the bands hold minima, half maxima."""
    table = np.concatenate([low, high]).reshape(-1, rows)
    weights = _multipliers(rows, 37)
    keys = (_mix(table.copy()) * weights).sum(axis=1, dtype=np.uint64) + np.arange(len(table), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(keys)


def sign(docs: DataFrame) -> DataFrame:
    """Set size, identity of the set and band keys of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                sizes, identities, bands, counts = [], [], [], [0]
                for value in part.column(1):
                    hashes = shingle_set(value.as_py())
                    sizes.append(len(hashes))
                    identities.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    if len(hashes):
                        bands.append(band_keys(*min_max(hashes)).view(np.int64))
                    counts.append(counts[-1] + (BANDS if len(hashes) else 0))
                flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64), pa.int64())
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(identities, pa.binary()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_id", "bands"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(run), SIGNED)


def _only(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is among the distinct ids; ids go to all executors only below a checked number."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, column, "left_semi")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with those distinct ids."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _only(own, ids, "doc_id")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents with those distinct ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                each = [shingle_set(v.as_py()).view(np.int64) for v in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(e) for e in each])])
                flat = np.concatenate(each) if each else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))], names=["doc_id", "shingles"])

    return _texts(docs, ids).mapInArrow(releasing(run), "doc_id long, shingles array<long>")


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= 75 * union."""
    pairs = checkpoint(pairs)
    full = _sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    left = full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    return both.where((F.lit(DENOMINATOR).cast("long") * F.col("common") >= F.lit(NUMERATOR).cast("long") * union) & (F.col("common") > 0)).select("a", "b").distinct()


def describe(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, n_shingles, able, wide, keys) of the documents with those ids that may still be linked.

    able: how many of a document's shingles occur in any other of these documents; two of them have no more
    in common than the smaller of these counts, so one whose own count is below 0.75 of its set is left out.
    wide: low bytes of WIDE signature values, minima first; keys: low 32 bits of the band keys.
    """
    ids = ids.withColumnRenamed("rep", "doc_id")
    each = _sets(docs, ids).select("doc_id", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingle_set(value.as_py())
                low, high = min_max(hashes, WIDE // 2)
                keys = band_keys(low[:PERMUTATIONS], high[:PERMUTATIONS]).astype("<u4").tobytes()
                low, high = _mix(low).astype(np.uint8), _mix(high).astype(np.uint8)
                out.append((rep, len(hashes), low.tobytes() + high.tobytes(), keys))
            parts = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(parts, kinds)], names=["doc_id", "n_shingles", "wide", "keys"])

    made = _texts(docs, ids).mapInArrow(releasing(run), "doc_id long, n_shingles long, wide binary, keys binary")
    full = made.join(alone, "doc_id", "left").withColumn("able", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))
    return full.where(DENOMINATOR * F.col("able") >= NUMERATOR * F.col("n_shingles")).select(F.col("doc_id").alias("rep"), "n_shingles", "able", "wide", "keys")


def _bytes_of(column: pa.Array, rows: int, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def forest_roots(links: DataFrame) -> DataFrame:
    """(node, root) of links (node, root) that lead from each node to a smaller one: every pointer jumps until all rest."""
    roots = checkpoint(links)
    while True:
        onward = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = checkpoint(roots.join(onward, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(roots)
        roots = jumped.select("node", "root")
        roots._written_to = jumped._written_to
        if jumped.where("moved").isEmpty():
            return roots


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches; roots themselves are left out.

    In each round every node but the local minima hooks onto its smallest neighbour, pointers jump to the
    roots and edges are renamed by them; edges that remain join roots. Each round is written to a table.
    """
    open_ = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    found = None
    while not open_.isEmpty():
        hooks = forest_roots(open_.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        found = hooks if found is None else checkpoint(_renamed(found, hooks, "root").unionByName(hooks))
        named = _renamed(_renamed(open_, hooks, "a"), hooks, "b")
        fresh = checkpoint(named.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        discard(open_)
        open_ = fresh
    return open_.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found


def _renamed(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """The rows with a column's nodes replaced by their roots, where they have any."""
    to = roots.select(F.col("node").alias(column), F.col("root").alias("to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("to", column)).drop("to").select(*rows.columns)


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b) between nodes: only the components that they touch are gone through."""
    between = components(_renamed(_renamed(links, roots, "a"), roots, "b"))
    return checkpoint(_renamed(roots, between, "root").unionByName(between))


def _possible(n_a: np.ndarray, n_b: np.ndarray, able_a: np.ndarray, able_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be linked if they share at most their shareable shingles."""
    common = np.minimum(np.minimum(able_a, able_b), np.minimum(n_a, n_b))
    return DENOMINATOR * common >= NUMERATOR * (n_a + n_b - common)


def _across(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of two blocks of a bucket (or within one) in different components whose sketches and sizes allow a link.

    A pair that meets in several buckets is put out in the first band that it shares only.
    """
    band, i, j = (k.as_py() for k in key)
    reps, roots, sizes, ables, own = (table.column(c).to_numpy() for c in ("rep", "root", "n_shingles", "able", "block"))
    wide = _bytes_of(table.column("wide"), len(reps))
    sketches = np.concatenate([wide[:, : SKETCH // 2], wide[:, WIDE // 2 : (WIDE + SKETCH) // 2]], axis=1)
    rows, columns = np.flatnonzero(own == i), np.flatnonzero(own == j)
    able = roots[rows, None] != roots[None, columns]
    if i == j:
        able &= reps[rows, None] > reps[None, columns]
    able &= _possible(sizes[rows, None], sizes[None, columns], ables[rows, None], ables[None, columns])
    x, y = np.nonzero(able)
    x, y = rows[x], columns[y]
    keys, here = _bytes_of(table.column("keys"), len(reps), "<u4"), np.uint32(band & 0xFFFFFFFF)
    near = np.zeros(len(x), dtype=bool)
    for lo in range(0, len(x), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        near[part] = (sketches[x[part]] == sketches[y[part]]).sum(axis=1) >= LEAST_EQUAL
        close = lo + np.flatnonzero(near[part])
        near[close] = (wide[x[close]] == wide[y[close]]).sum(axis=1) >= WIDE_EQUAL
        close = close[near[close]]
        first = (keys[x[close]] == keys[y[close]]).argmax(axis=1)
        near[close] = keys[x[close], first] == here
    a, b = reps[x[near]], reps[y[near]]
    return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})


def _bucket_pairs(placed: DataFrame, traits: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that share a mixed bucket and may be linked, by blocks of each bucket."""
    members = placed.join(traits, "rep")
    blocks = members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return met.drop("blocks", "other").groupBy("band", "i", "j").applyInArrow(_across, "a long, b long").distinct()


def _likely(pairs: DataFrame, traits: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            n_a, n_b, able_a, able_b = (column(c).to_numpy() for c in ("n_a", "n_b", "able_a", "able_b"))
            w_a, w_b = (_bytes_of(column(c), batch.num_rows) for c in ("w_a", "w_b"))
            keep = pa.array(_possible(n_a, n_b, able_a, able_b) & ((w_a == w_b).sum(axis=1) >= WIDE_EQUAL))
            yield pa.RecordBatch.from_arrays([column("a").filter(keep), column("b").filter(keep)], names=["a", "b"])

    side = lambda k: traits.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("able").alias(f"able_{k}"), F.col("wide").alias(f"w_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(releasing(run), "a long, b long")


def _place(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, rep, root) of the buckets whose members lie in different components."""
    placed = rows.select("band", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    return placed.join(mixed, "band")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id, its own included) and kept, per document."""
    signed = checkpoint(sign(docs))
    # members of a class have one set, so any member's bands stand for all
    filled = signed.where("n_shingles > 0")
    reps = checkpoint(filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))

    banded = reps.select("rep", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
    shared = checkpoint(banded.join(leaders, "band"))
    ties = checkpoint(shared.where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("n")))
    best = ties.groupBy("rep").agg(F.max(F.struct(F.col("n"), (-F.col("leader")).alias("minus"))).alias("best"))
    best = best.select(F.col("rep").alias("a"), (-F.col("best.minus")).alias("b"))
    roots = forest_roots(confirm(docs, best).select(F.col("a").alias("node"), F.col("b").alias("root")))

    undecided = checkpoint(_place(shared, roots))
    traits = checkpoint(describe(docs, undecided.select("rep").distinct()))
    at = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    other = ties.select(F.col("rep").alias("a"), F.col("leader").alias("b")).join(at("a"), "a", "left").join(at("b"), "b", "left")
    other = other.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    roots = joined(roots, confirm(docs, _likely(other, traits)))

    pairs = _bucket_pairs(_place(undecided, roots), traits)
    final = joined(roots, confirm(docs, pairs)).withColumnRenamed("node", "rep")

    classes = reps.select("set_id", "rep").join(final, "rep", "left").select("set_id", F.coalesce("root", "rep").alias("component_id"))
    linked = signed.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    result = linked.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = docs.where("doc_id is null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shingle_set(v.as_py())) for v in batch.column(0)], pa.int64())], names=["n_shingles"])

    counted = nameless.select(F.col("text").cast("string")).mapInArrow(count, "n_shingles long")
    none = F.lit(None).cast("long")
    return result.unionByName(counted.select(none.alias("doc_id"), "n_shingles", none.alias("component_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that stay: one row of each component, and rows without id."""
    stay = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).alias("place")
    one = named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), place).where("place = 1")
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
