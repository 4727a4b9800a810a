"""Removal of repeated byte strings by a distributed difference-cover algorithm.

Every byte covered by a string of ``length`` bytes that starts at least twice in the corpus is removed.
``remove_repeats`` also removes every passage of ``words`` words that starts at least twice, however few
bytes it has: the same steps then run over a text's words, each a hash of its bytes, instead of its bytes.
A full distributed suffix array of the corpus would move some twelve bytes for two thirds of all
suffixes, tens of times the input; as only prefixes of a fixed length matter, the algorithm works with
a longer period and drops suffixes that cannot repeat between its steps:

1. Sample: positions whose offset in their document lies in a difference cover D modulo v. For any two
   suffixes there is a shift d < v that puts both on sampled positions, so two equal strings of
   ``length`` bytes share a block of ``length - v + 1`` bytes at sampled positions.
2. Name: blocks at sampled positions are named by hashes, sorted, and adjacent equal names found.
3. Recurse on the names: only suffixes that reach, within v bytes, a sampled position whose name repeats
   are kept. Each is named by its whole prefix of ``length`` bytes. Where suffixes kept are adjacent, those
   whose name ends in ANCHOR_BITS zero bits cut them into segments, the same ones wherever the text is the
   same. A segment is named by the names at its two ends, which cover all strings that start in it, so a
   segment whose name repeats is settled as a whole.
4. Merge: the suffixes outside settled segments, and those of one copy of each settled segment, are sorted
   by name and adjacent ones compared; those equal to a neighbour start a repeated string.

Documents are dealt by a hash of their id into chunks of bounded size. A chunk publishes each distinct
name once, with a mark if it occurs in the chunk twice, so a string that a third of all documents share
costs one entry per chunk, not one per occurrence. Sorted names go out per range of names as blobs in
Rice code; what comes back is one bit per published name (two for segments: whether it repeats, and whether
this chunk is the one that goes on with it). Text moves once: all steps are one job whose text exchange
is reused.

Names are compared instead of texts. Those of steps 3 and 4 have 96 bits where chunks are compared, of
which a chunk itself compares 64: false matches of different strings are to be expected beyond some 10^13
candidate suffixes, or 10^8 chunks. Those of step 2 have SAMPLE_BITS
more than a position in the corpus needs, as a false match there only keeps some suffixes for step 3.

Words are runs of bytes other than ASCII white space; the white space between them does not count when
passages are compared, and goes with a passage.

Edge cases: null and empty texts have nothing to remove; equal documents remove each other if they are
long enough; repeated rows count as separate documents; an empty table gives an empty result. A
document must fit in a task, as a cell of a table does; work arrays take about 20 bytes per byte of a
chunk.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.memory import release

LENGTH = 400
WORDS = 51
CHUNK_BYTES = 2 << 20
BLOCK, SLICE = 1 << 17, 1 << 13
COVER, SAMPLE_BITS, NAME_BITS, ANCHOR_BITS = 1, 12, 64, 5
PUBLISHED = "bucket int, chunk int, payload binary"
MARKED = "chunk int, step int, bucket int, bits binary"


@functools.lru_cache(maxsize=8)
def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """(v, D): every residue modulo v = 24 r^2 + 36 r + 13 is a difference of two of the 6 r + 4 members of D.

    The construction lists the gaps between members: 1 (r times), r + 1, 2 r + 1 (r times), 4 r + 3
    (2 r + 1 times), 2 r + 2 (r + 1 times), 1 (r times).
    """
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    v, members = 24 * r * r + 36 * r + 13, np.cumsum([0, *gaps])
    if len(np.unique((members[:, None] - members[None]) % v)) != v:
        raise ValueError(f"no difference cover for r = {r}")
    return v, members % v


@functools.lru_cache(maxsize=2)
def _hash_tables(family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random 64-bit value per byte, powers of an odd multiplier and of its inverse (all modulo 2^64)."""
    mask = (1 << 64) - 1
    values, state = [], (0x243F6A8885A308D3 * (2 * family + 1)) & mask
    for _ in range(257):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        values.append(z ^ (z >> 31))
    multiplier = values.pop() | 1

    def powers(base: int) -> np.ndarray:
        out = np.full(BLOCK + LENGTH * 4 + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return np.array(values, dtype=np.uint64), powers(multiplier), powers(pow(multiplier, -1, 1 << 64))


def _mix(hashes: np.ndarray) -> np.ndarray:
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes


class Chunk:
    """The distinct texts of a chunk, one after the other, with the place of each byte's document."""

    def __init__(self, texts: list[bytes]):
        index: dict[bytes, int] = {}
        self.text_of_row = [index.setdefault(t, len(index)) for t in texts]
        self.texts = list(index)
        copies = np.bincount(self.text_of_row, minlength=len(index)) if texts else np.zeros(0, int)
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        self.starts, self.ends = ends - sizes, ends
        self.bytes = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        kind = np.int32 if len(self.bytes) < 2**31 else np.int64
        self.start_of = np.repeat(self.starts.astype(kind), sizes)
        self.end_of = np.repeat(self.ends.astype(kind), sizes)
        self.copied = np.repeat(copies > 1, sizes)
        self.places = np.arange(len(self.bytes), dtype=kind)

    def leave(self) -> None:
        """Give up the places of bytes, once the words have taken what they need; texts and bytes stay."""
        self.start_of = self.end_of = self.copied = self.places = self.places[:0]

    def values(self, lo: int, hi: int, family: int) -> np.ndarray:
        """A random number for each byte there, equal for equal bytes."""
        return _hash_tables(family)[0][self.bytes[lo:hi]]

    def sampled(self, r: int, length: int) -> np.ndarray:
        """Sampled positions with a whole block of length - v + 1 bytes in their document."""
        v, members = difference_cover(r)
        member = np.zeros(v, dtype=bool)
        member[members] = True
        found = []
        for lo in range(0, len(self.places), BLOCK):
            here, start, end = (part[lo : lo + BLOCK] for part in (self.places, self.start_of, self.end_of))
            found.append(here[member[(here - start) % v] & (here + (length - v + 1) <= end)])
        return np.concatenate(found) if found else self.places

    def names(self, at: np.ndarray, length: int, bits: int, family: int = 0) -> np.ndarray:
        """Hashes of the strings of that length at the given ascending positions; families are independent."""
        _, powers, inverse = _hash_tables(family)
        out = np.empty(len(at), dtype=np.uint64)
        for lo in range(0, len(self.places), BLOCK):
            a, b = np.searchsorted(at, (lo, lo + BLOCK))
            if a == b:
                continue
            part = self.values(lo, lo + BLOCK + length, family)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.multiply(part, powers[: len(part)], out=sums[1:])
            np.cumsum(sums[1:], out=sums[1:])
            here = at[a:b] - lo
            out[a:b] = (sums[here + length] - sums[here]) * inverse[here]
        _mix(out)
        return out >> np.uint64(64 - bits) if bits < 64 else out

    def reaching(self, marked: np.ndarray, r: int, length: int) -> np.ndarray:
        """Suffixes of at least length bytes that meet a marked sampled position within v bytes."""
        v, _ = difference_cover(r)
        far = np.iinfo(self.places.dtype).max
        following = np.full(len(self.places), far, dtype=self.places.dtype)
        following[marked] = marked
        found, least = [], far
        for lo in range((len(self.places) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            here, end = self.places[lo : lo + BLOCK], self.end_of[lo : lo + BLOCK]
            after = np.minimum(np.minimum.accumulate(following[lo : lo + BLOCK][::-1])[::-1], least)
            found.append(here[(after < end) & (after - here < v) & (here + length <= end)])
            least = after[0]
        return np.concatenate(found[::-1]) if found else self.places

    def covered(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Mask of the bytes covered by strings of that length at the given positions."""
        latest = np.full(len(self.bytes), -length, dtype=self.places.dtype)
        latest[starts] = starts
        return self.places - np.maximum.accumulate(latest) < length if len(latest) else np.zeros(0, bool)


class Words(Chunk):
    """The words of a chunk's texts in place of their bytes."""

    def __init__(self, chunk: Chunk):
        self.bytes = chunk.bytes
        space = (self.bytes == 32) | ((self.bytes >= 9) & (self.bytes <= 13))
        before, after = np.ones(len(space), bool), np.ones(len(space), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        edges = chunk.starts[chunk.ends > chunk.starts]
        before[edges], after[edges[1:] - 1] = True, True
        kind = chunk.places.dtype
        self.first, self.last = np.flatnonzero(before & ~space).astype(kind), (np.flatnonzero(after & ~space) + 1).astype(kind)
        self.hashes = self._hashed(space)
        starts, ends = np.searchsorted(self.first, chunk.starts), np.searchsorted(self.first, chunk.ends)
        self.start_of, self.end_of = np.repeat(starts.astype(kind), ends - starts), np.repeat(ends.astype(kind), ends - starts)
        self.copied = chunk.copied[self.first]
        self.places = np.arange(len(self.first), dtype=kind)
        chunk.leave()

    def _hashed(self, space: np.ndarray) -> np.ndarray:
        table, powers, _ = _hash_tables()
        out = np.empty(len(self.first), dtype=np.uint64)
        for lo in range(0, len(self.bytes), BLOCK):
            a, b = np.searchsorted(self.first, (lo, lo + BLOCK))
            if a == b:
                continue
            base, end = int(self.first[a]), int(self.last[b - 1])
            at = self.first[a:b] - base
            within = np.arange(end - base) - np.repeat(at, np.diff(at, append=end - base))
            part = table[self.bytes[base:end]] * powers[within % BLOCK]
            part[space[base:end]] = 0
            out[a:b] = np.add.reduceat(part, at)
        return _mix(out)

    def values(self, lo: int, hi: int, family: int) -> np.ndarray:
        return _mix(self.hashes[lo:hi] + np.uint64(family)) if family else self.hashes[lo:hi]

    def covered(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Mask of the bytes from the first to the last word of the passages at the given words."""
        size = len(self.bytes) + 1
        return np.cumsum(np.bincount(self.first[starts], minlength=size) - np.bincount(self.last[starts + length - 1], minlength=size))[:-1] > 0


def _distinct(names: np.ndarray, copied: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sorted distinct names, which of them occur in the chunk more than once, and their checks."""
    unique, first, counts = np.unique(names, return_index=True, return_counts=True)
    twice = counts > 1
    if copied.any():
        twice |= _member(unique, np.unique(names[copied]))
    return unique, twice, None if checks is None else checks[first]


def _bucket_bounds(unique: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    high = (unique >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(high, np.arange(buckets + 1, dtype=np.uint64))


_HEADER = "<IQBI?"


def _bits_of(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, packed; slices of a multiple of 8 values end at whole bytes."""
    parts = []
    for lo in range(0, len(values), SLICE):
        spread = np.unpackbits(values[lo : lo + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        parts.append(np.packbits(spread[:, 64 - width :]))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def _values_of(packed: np.ndarray, count: int, width: int) -> np.ndarray:
    out = np.empty(count, dtype=np.uint64)
    for lo in range(0, count, SLICE):
        n = min(SLICE, count - lo)
        spread = np.zeros((n, 64), dtype=np.uint8)
        spread[:, 64 - width :] = np.unpackbits(packed[lo * width // 8 :], count=n * width).reshape(n, width)
        out[lo : lo + n] = np.packbits(spread, axis=1).view(">u8").ravel()
    return out


def pack_names(unique: np.ndarray, twice: np.ndarray, checks: np.ndarray | None = None) -> bytes:
    """Blob of sorted names: a header, the gaps between names in Rice code, checks, marks."""
    gaps = np.diff(unique)
    width = max(0, int(0.69 * (int(unique[-1]) - int(unique[0])) / max(1, len(gaps))).bit_length() - 1)
    unary = np.zeros(0, dtype=np.uint8)
    if len(gaps):
        ends = np.cumsum((gaps >> np.uint64(width)).astype(np.int64) + 1)
        unary = np.zeros(ends[-1], dtype=np.uint8)
        unary[ends - 1] = 1
        unary = np.packbits(unary)
    more = b"" if checks is None else checks.astype("<u4").tobytes()
    return struct.pack(_HEADER, len(unique), int(unique[0]), width, len(unary), checks is not None) + unary.tobytes() + _bits_of(gaps, width).tobytes() + more + np.packbits(twice).tobytes()


def unpack_names(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, marks and checks (0 where there are none)."""
    count, first, width, size, checked = struct.unpack_from(_HEADER, blob)
    at = struct.calcsize(_HEADER)
    high = np.diff(np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at))), prepend=-1) - 1
    at += size
    size = -(-(count - 1) * width // 8)
    names = np.empty(count, dtype=np.uint64)
    names[0] = first
    names[1:] = (high.astype(np.uint64) << np.uint64(width)) | _values_of(np.frombuffer(blob, np.uint8, size, at), count - 1, width)
    at += size
    checks = np.frombuffer(blob, "<u4", count, at) if checked else np.zeros(count, "<u4")
    twice = np.unpackbits(np.frombuffer(blob, np.uint8, -1, at + 4 * count * checked), count=count).astype(bool)
    return np.cumsum(names, dtype=np.uint64), twice, checks


def _publish(chunk_id: int, names: tuple[np.ndarray, np.ndarray, np.ndarray | None], bits: int, buckets: int, offset: int) -> pa.Table:
    bounds = _bucket_bounds(names[0], bits, buckets)
    used = np.flatnonzero(np.diff(bounds))
    blobs = [pack_names(*(None if part is None else part[bounds[k] : bounds[k + 1]] for part in names)) for k in used]
    return pa.table({"bucket": pa.array(used + offset, pa.int32()), "chunk": pa.array([chunk_id] * len(used), pa.int32()), "payload": pa.array(blobs, pa.binary())})


def _marker(step: int, choose: bool = False):
    """Reducer of one range of names: which published names occur twice in the corpus, as bits per chunk.

    choose: a second series of bits says for which names the chunk is the first that published them.
    """

    def mark(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        parts = [unpack_names(b) for b in table.column("payload").to_pylist()]
        names, twice, checks = (np.concatenate(columns) for columns in zip(*parts))
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        if (checks[order[1:]] != checks[order[:-1]])[same].any():
            order = np.lexsort((checks, names))
            same = (names[order[1:]] == names[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
        first = np.concatenate([[True], ~same])
        group = np.cumsum(first) - 1
        repeated = np.bincount(group) > 1
        repeated[group[twice[order]]] = True
        flags = np.empty((2 if choose else 1, len(names)), dtype=bool)
        flags[0, order] = repeated[group]
        if choose:
            flags[1, order] = first
        ends = np.cumsum([len(n) for n, _, _ in parts])
        bits = [b"".join(np.packbits(row[end - len(n) : end]).tobytes() for row in flags) for end, (n, _, _) in zip(ends, parts)]
        rows = len(parts)
        return pa.table({"chunk": table.column("chunk").cast(pa.int32()), "step": pa.array([step] * rows, pa.int32()), "bucket": pa.array([key[0].as_py()] * rows, pa.int32()), "bits": pa.array(bits, pa.binary())})

    return mark


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _marked(marks: pa.Table, step: int, names: np.ndarray, bits: int, buckets: int, offset: int, series: int = 1) -> np.ndarray:
    """For each series of bits, which of a chunk's names are marked."""
    unique, inverse = np.unique(names, return_inverse=True)
    bounds, keep = _bucket_bounds(unique, bits, buckets), np.zeros((series, len(unique)), dtype=bool)
    for s, bucket, packed in zip(*(marks.column(c).to_pylist() for c in ("step", "bucket", "bits"))):
        if s == step and offset <= bucket < offset + buckets:
            a, b = bounds[bucket - offset], bounds[bucket - offset + 1]
            found = np.frombuffer(packed, np.uint8).reshape(series, -1)
            keep[:, a:b] = np.unpackbits(found, axis=1, count=b - a)
    return keep[:, inverse]


def _texts(table: pa.Table) -> list[bytes]:
    return [v or b"" for v in table.column("data").to_pylist()]


class _Rule:
    """Repeats of one length in bytes or words; names of different rules have ranges of their own."""

    def __init__(self, of, length: int, r: int, buckets: int, offset: int, sample_bits: int, name_bits: int):
        self.of, self.length, self.r, self.sample_bits, self.name_bits = of, length, r, sample_bits, name_bits
        self.ranges = (buckets, offset)
        self.block = length - difference_cover(r)[0] + 1
        if self.block < 1:
            raise ValueError(f"a cover of r = {r} is too wide for length {length}")

    def sample(self, view: Chunk) -> tuple[np.ndarray, np.ndarray]:
        at = view.sampled(self.r, self.length)
        return at, view.names(at, self.block, self.sample_bits)

    def remaining(self, view: Chunk, marks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that reach a repeated block, and their names."""
        at, names = self.sample(view)
        left = view.reaching(at[_marked(marks, 1, names, self.sample_bits, *self.ranges)[0]], self.r, self.length)
        return left, view.names(left, self.length, self.name_bits)

    def segments(self, left: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``left`` of the first and last suffix of each segment, and the segments' names."""
        anchors = np.flatnonzero(names & np.uint64((1 << ANCHOR_BITS) - 1) == 0)
        a, b = anchors[:-1], anchors[1:]
        gap = left[b] - left[a]
        whole = (gap == b - a) & (gap <= self.length)
        a, b, gap = a[whole], b[whole], gap[whole]
        return a, b, self._joined(names[a], names[b], gap)

    def _joined(self, first: np.ndarray, last: np.ndarray, gap: np.ndarray) -> np.ndarray:
        joined = _mix(first * np.uint64(0x9E3779B97F4A7C15) + (last ^ (last >> np.uint64(31))) * np.uint64(0xD1B54A32D192ED03) + gap.astype(np.uint64))
        return joined >> np.uint64(64 - self.name_bits) if self.name_bits < 64 else joined

    def checks(self, view: Chunk, at: np.ndarray) -> np.ndarray:
        return view.names(at, self.length, 64, family=1)

    def settled(self, left: np.ndarray, a: np.ndarray, b: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Which suffixes lie in the given segments."""
        size = len(left) + 1
        return np.cumsum(np.bincount(a[which], minlength=size) - np.bincount(b[which] + 1, minlength=size))[:-1] > 0

    def publish_sample(self, key: int, chunk: Chunk) -> pa.Table:
        view = self.of(chunk)
        at, names = self.sample(view)
        return _publish(key, _distinct(names, view.copied[at]), self.sample_bits, *self.ranges)

    def publish_segments(self, key: int, chunk: Chunk, marks: pa.Table) -> pa.Table:
        view = self.of(chunk)
        left, names = self.remaining(view, marks)
        a, b, joined = self.segments(left, names)
        places = np.union1d(a, b)
        checks = self.checks(view, left[places])
        checks = self._joined(checks[np.searchsorted(places, a)], checks[np.searchsorted(places, b)], b - a)
        return _publish(key, _distinct(joined, view.copied[left[a]], checks), self.name_bits, *self.ranges)

    def _open(self, view: Chunk, marks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that remain, their names, which are in settled segments and which go on to step 4."""
        left, names = self.remaining(view, marks)
        a, b, joined = self.segments(left, names)
        repeated, chosen = _marked(marks, 2, joined, self.name_bits, *self.ranges, series=2)
        on = ~self.settled(left, a, b, repeated)
        on |= self.settled(left, a, b, ~repeated | chosen)
        return left, names, self.settled(left, a, b, repeated), on

    def publish_remaining(self, key: int, chunk: Chunk, marks: pa.Table) -> pa.Table:
        view = self.of(chunk)
        left, names, _, on = self._open(view, marks)
        left, names = left[on], names[on]
        return _publish(key, _distinct(names, view.copied[left], self.checks(view, left)), self.name_bits, *self.ranges)

    def removed(self, chunk: Chunk, marks: pa.Table) -> np.ndarray:
        view = self.of(chunk)
        left, names, starts, on = self._open(view, marks)
        starts[on] |= _marked(marks, 3, names[on], self.name_bits, *self.ranges)[0]
        return view.covered(left[starts], self.length)


class _Steps:
    """What a chunk does in each step; everything is recomputed from its texts, so no state is kept."""

    def __init__(self, length: int, r: int, words: int | None, buckets: int, sample_bits: int, name_bits: int):
        self.rules = [_Rule(lambda chunk: chunk, length, r, buckets, 0, sample_bits, name_bits)]
        if words:
            self.rules.append(_Rule(Words, words, 0, buckets, buckets, sample_bits, name_bits))

    def publisher(self, publish: str):
        """The named step of all rules as a function of a group."""

        def run(key: tuple, table: pa.Table, *marks: pa.Table) -> pa.Table:
            chunk = Chunk(_texts(table))
            del table
            out = pa.concat_tables([getattr(rule, publish)(key[0].as_py(), chunk, *marks) for rule in self.rules])
            del chunk
            release()
            return out

        if publish == "publish_sample":
            return lambda key, table: run(key, table)
        return lambda key, table, marks: run(key, table, marks)

    def removed(self, table: pa.Table, marks: pa.Table) -> tuple[Chunk, list[np.ndarray]]:
        chunk = Chunk(_texts(table))
        return chunk, [rule.removed(chunk, marks) for rule in self.rules]


def _digest_rows(chunk: Chunk, gone: np.ndarray, passages: np.ndarray) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, sha256 of the kept bytes, n_passage_bytes) of each distinct text."""
    out = []
    for a, b, text in zip(chunk.starts, chunk.ends, chunk.texts):
        mask = gone[a:b]
        removed = int(mask.sum())
        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
        kept = chunk.bytes[a:b][~mask].tobytes() if removed else text
        out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), int(passages[a:b].sum())))
    return out


def _run(docs: DataFrame, row: Column, length: int, r: int, words: int | None, chunk_bytes: int, name_bits: int, finish, schema: str) -> DataFrame:
    data = F.col("text").cast("string").cast("binary")
    total = docs.select(F.sum(F.octet_length(data)).alias("n")).first()["n"] or 0
    chunks = max(1, -(-total // chunk_bytes))
    sample_bits = min(64, max(32, int(total).bit_length() + SAMPLE_BITS))
    steps = _Steps(length, r, words, -(-chunks // 8), sample_bits, name_bits)
    chunk = F.pmod(F.xxhash64(F.col("doc_id"), F.octet_length(data)), F.lit(chunks)).cast("int")
    dealt = docs.select(row.alias("row"), data.alias("data"), chunk.alias("chunk")).groupBy("chunk")
    first = dealt.applyInArrow(steps.publisher("publish_sample"), PUBLISHED).groupBy("bucket").applyInArrow(_marker(1), MARKED)
    second = dealt.cogroup(first.groupBy("chunk")).applyInArrow(steps.publisher("publish_segments"), PUBLISHED).groupBy("bucket").applyInArrow(_marker(2, choose=True), MARKED)
    both = first.unionByName(second)
    third = dealt.cogroup(both.groupBy("chunk")).applyInArrow(steps.publisher("publish_remaining"), PUBLISHED).groupBy("bucket").applyInArrow(_marker(3), MARKED)
    marks = both.unionByName(third).groupBy("chunk")

    def last(key: tuple, table: pa.Table, marked: pa.Table) -> pa.Table:
        out = finish(table, *steps.removed(table, marked))
        release()
        return out

    return dealt.cogroup(marks).applyInArrow(last, schema)


def repeat_digest(docs: DataFrame, length: int = LENGTH, r: int = COVER, words: int | None = WORDS, chunk_bytes: int = CHUNK_BYTES, name_bits: int = NAME_BITS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the digest of the bytes kept, by the rule of ``length`` bytes.

    n_passage_bytes counts the bytes inside passages of ``words`` words that repeat (0 without that rule). They
    do not change the other columns; has_repeat says whether either rule met the document.
    """

    def finish(table: pa.Table, chunk: Chunk, masks: list[np.ndarray]) -> pa.Table:
        digests = _digest_rows(chunk, masks[0], masks[1] if len(masks) > 1 else np.zeros_like(masks[0]))
        rows = [digests[k] for k in chunk.text_of_row]
        n_bytes, removed, spans, kept, passages = list(zip(*rows)) or [[]] * 5
        ids = table.column("row").combine_chunks().field("doc_id") if table.num_rows else pa.array([], pa.int64())
        met = [bool(x or y) for x, y in zip(removed, passages)]
        return pa.table({"doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string()), "n_passage_bytes": pa.array(passages, pa.int64()), "has_repeat": pa.array(met, pa.bool_())})

    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"))
    return _run(docs, row, length, r, words, chunk_bytes, name_bits, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, has_repeat boolean")


def remove_repeats(docs: DataFrame, length: int = LENGTH, r: int = COVER, words: int | None = WORDS, chunk_bytes: int = CHUNK_BYTES, name_bits: int = NAME_BITS) -> DataFrame:
    """The documents, all rows and columns, with repeated strings cut out of text and n_chars counted anew.

    Repeated passages of ``words`` words (13 at least; None: no such rule) are cut too, of any length in bytes.
    A cut may fall inside a character; what is left of such a character goes too. Null texts stay null.
    """
    columns = docs.columns
    others = [c for c in columns if c != "text"]

    def finish(table: pa.Table, chunk: Chunk, masks: list[np.ndarray]) -> pa.Table:
        kept, gone = [], functools.reduce(np.logical_or, masks)
        for a, b, text in zip(chunk.starts, chunk.ends, chunk.texts):
            mask = gone[a:b]
            kept.append((chunk.bytes[a:b][~mask].tobytes() if mask.any() else text).decode("utf-8", "ignore"))
        null = table.column("data").is_null().to_pylist()
        texts = [None if n else kept[k] for k, n in zip(chunk.text_of_row, null)]
        return pa.table({"row": table.column("row"), "text": pa.array(texts, pa.string())})

    row = F.struct(*[F.col(f"`{c}`") for c in others])
    schema = f"row {docs.select(row.alias('row')).schema['row'].dataType.simpleString()}, text string"
    cut = _run(docs, row, length, r, words, chunk_bytes, name_bits, finish, schema)
    fields = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns}
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("text").isNull(), fields["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[fields[c].alias(c) for c in columns])


def brute_force(texts: list[bytes], length: int | None = None, words: bool = False) -> Iterator[np.ndarray]:
    """Masks of the bytes to remove, by counting every string; for small fixtures.

    A length asks for strings of so many bytes alone, unless words is set; without one the masks are those
    of remove_repeats, strings of LENGTH bytes and passages of WORDS words.
    """
    words, length = words or length is None, length or LENGTH
    seen: dict[bytes, int] = {}
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] if words else [] for t in texts]
    passages = [[tuple(t[a:b] for a, b in s[k : k + WORDS]) for k in range(len(s) - WORDS + 1)] for t, s in zip(texts, spans)]
    counts = Counter(p for own in passages for p in own)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    for t, own, s in zip(texts, passages, spans):
        mask = np.zeros(len(t), dtype=bool)
        for k, p in enumerate(own):
            if counts[p] > 1:
                mask[s[k][0] : s[k + WORDS - 1][1]] = True
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        yield mask
