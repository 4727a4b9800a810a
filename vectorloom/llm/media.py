"""Media columns: signature sniffing, validation, carving and lossless storage of payloads.

An Aho-Corasick automaton over the magic bytes of all known formats runs once through each value. Every
hit is given to the format's validator, which walks the structure (chunks, markers, boxes, checksums) and
returns the length of the item or nothing. The first valid item at offset 0 decides the real type, whatever
was declared; valid items further in are carved. Items may lie inside others (a picture in a PDF, a stored member
of a ZIP, anything in the samples of a WAV); their depth says how many items enclose them, and each must end where
the one around it does or before. Compressed content is not opened, and the pages that one Ogg file interleaves are
no items of their own.

Payload storage: bytes are kept as 8-bit mono PCM samples of a WAV file, which any reader gives back
bit by bit.

Edge cases: a null value has type null, length 0 and no items; bytes that no validator confirms are
``application/octet-stream``; magic bytes without structure are not reported; a null text stores an empty
payload of 64 zero bytes; equal texts give equal values; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.memory import releasing

UNKNOWN = "application/octet-stream"


def _png(b: memoryview) -> int:
    at = 8
    while at + 12 <= len(b):
        size = int.from_bytes(b[at : at + 4], "big")
        kind = bytes(b[at + 4 : at + 8])
        if at + 12 + size > len(b) or zlib.crc32(b[at + 4 : at + 8 + size]) != int.from_bytes(b[at + 8 + size : at + 12 + size], "big"):
            return 0
        if at == 8 and (kind != b"IHDR" or size != 13):
            return 0
        at += 12 + size
        if kind == b"IEND":
            return at
    return 0


def _jpeg(b: memoryview) -> int:
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return 0
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            return at + 2
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
            continue
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        if mark < 0xC0 or size < 2 or at + 2 + size > len(b):
            return 0
        at += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next real marker
            data = bytes(b[at:])
            here = 0
            while True:
                here = data.find(b"\xff", here)
                if here < 0 or here + 1 >= len(data):
                    return 0
                if data[here + 1] == 0 or 0xD0 <= data[here + 1] <= 0xD7:
                    here += 2
                    continue
                break
            at += here
    return at + 2 if at + 2 <= len(b) and bytes(b[at : at + 2]) == b"\xff\xd9" else 0


def _gif(b: memoryview) -> int:
    if len(b) < 14 or bytes(b[:6]) not in (b"GIF87a", b"GIF89a"):
        return 0
    at = 13 + (3 << ((b[10] & 7) + 1) if b[10] & 0x80 else 0)

    def blocks(here: int) -> int:
        while here < len(b) and b[here]:
            here += 1 + b[here]
        return here + 1

    while at < len(b):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at += 10 + (3 << ((b[at + 9] & 7) + 1) if b[at + 9] & 0x80 else 0)
            at = blocks(at + 1)
        else:
            return 0
    return 0


def _bmp(b: memoryview) -> int:
    if len(b) < 54:
        return 0
    size, _, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, 2)
    ok = 54 <= offset < size <= len(b) and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return size if ok else 0


def _riff(b: memoryview) -> int:
    if len(b) < 12:
        return 0
    size, form = struct.unpack_from("<I4s", b, 4)
    end, at, kinds = 8 + size, 12, []
    if form not in (b"WAVE", b"AVI ", b"WEBP") or end > len(b):
        return 0
    while at + 8 <= end:
        kind, length = struct.unpack_from("<4sI", b, at)
        if at + 8 + length > end:
            return 0
        kinds.append(kind)
        at += 8 + length + (length & 1)
    need = {b"WAVE": {b"fmt ", b"data"}, b"AVI ": {b"LIST"}, b"WEBP": set()}[form]
    return end + (end & 1 and end < len(b) and 0) if kinds and need <= set(kinds) else 0


def _gzip(b: memoryview) -> int:
    if len(b) < 18 or b[2] != 8 or b[3] & 0xE0:
        return 0
    inflater = zlib.decompressobj(31)
    try:
        fed = 0
        more = True
        while not inflater.eof and (more or fed < len(b)):
            rest = inflater.unconsumed_tail
            part = rest or b[fed : fed + 65536]
            fed += 0 if rest else len(part)
            out = inflater.decompress(part, 1 << 20)  # bounded output; the content is not kept
            more = bool(inflater.unconsumed_tail) or len(out) == 1 << 20  # a full output may hold some back
    except zlib.error:
        return 0
    return fed - len(inflater.unused_data) if inflater.eof else 0


def _zips(data: bytes) -> dict[int, int]:
    """start -> length of the archives in a value: each end record says how far before it its archive starts."""
    found: dict[int, int] = {}
    end = data.find(b"PK\x05\x06")
    while end >= 0:
        if end + 22 <= len(data):
            size, offset, comment = struct.unpack_from("<IIH", data, end + 12)
            start = end - size - offset
            if start >= 0 and data[end - size : end - size + 4] == b"PK\x01\x02" and end + 22 + comment <= len(data):
                found.setdefault(start, end + 22 + comment - start)
        end = data.find(b"PK\x05\x06", end + 1)
    return found


class _Pdfs:
    """Where documents of a value end, from one search for cross-reference marks and one for ends of file."""

    _offset = re.compile(rb"\s*\d+\s*%%EOF")

    def __init__(self, data: bytes):
        self.data = data
        self.marks, self.ends = ([m.start() for m in re.finditer(mark, data)] for mark in (b"startxref", b"%%EOF"))
        #: by end: the last one of its chain of updates, each of which has a mark of its own
        self.last = list(range(len(self.ends)))
        for k in range(len(self.ends) - 2, -1, -1):
            mark = bisect_left(self.marks, self.ends[k])
            if mark < len(self.marks) and self.marks[mark] + 9 <= self.ends[k + 1]:
                self.last[k] = self.last[k + 1]

    def length(self, start: int, stop: int) -> int:
        """Length of the document that starts there and lies before ``stop``; 0 if there is none."""
        if not self.data[start + 5 : min(start + 8, stop)].replace(b".", b"").isdigit():
            return 0
        mark = bisect_left(self.marks, start)
        if mark == len(self.marks) or not self._offset.match(self.data, self.marks[mark] + 9, stop):
            return 0
        end = bisect_left(self.ends, self.marks[mark])
        return self.ends[min(self.last[end], bisect_right(self.ends, stop - 5) - 1)] + 5 - start


def _ogg(b: memoryview) -> int:
    at = 0
    while at + 27 <= len(b) and bytes(b[at : at + 5]) == b"OggS\0":
        segments = b[at + 26]
        size = 27 + segments + sum(b[at + 27 : at + 27 + segments])
        if at + size > len(b):
            return 0
        last, at = b[at + 5] & 4, at + size
        if last:
            return at
    return 0


def _mp4(b: memoryview) -> int:
    at, kinds = 0, set()
    while at + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        if size == 1 and at + 16 <= len(b):
            size = struct.unpack_from(">Q", b, at + 8)[0]
        if size < 8 or at + size > len(b) or not all(32 <= c < 127 for c in kind):
            break
        kinds.add(kind)
        at += size
    return at if b"ftyp" in kinds and kinds & {b"moov", b"mdat", b"moof"} else 0


#: Magic bytes, their place in the item, media type (by RIFF form where that decides), validator
#: (none for archives and PDF documents, which are found from their ends).
MAGIC: list[tuple[bytes, int, str, Callable[[memoryview], int] | None]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"RIFF", 0, "riff", _riff),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"PK\x03\x04", 0, "application/zip", None),
    (b"%PDF-", 0, "application/pdf", None),
    (b"OggS\x00\x02", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
]
_RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for k, (magic, _, _, _) in enumerate(MAGIC):
        machine.add_word(magic.decode("latin-1"), k)
    machine.make_automaton()
    return machine


def carve(data: bytes) -> list[tuple[int, int, str, int]]:
    """Confirmed items (offset, length, type, depth), by offset; an item of depth 0 lies in no other."""
    view, found, around = memoryview(data), [], []  # around: (end, type) of the items that enclose the current place
    hits = []
    for end, k in _automaton().iter(data.decode("latin-1")):
        magic, place, _, _ = MAGIC[k]
        start = end + 1 - len(magic) - place
        if start >= 0:
            hits.append((start, k))
    archives = documents = None
    taken = -1
    for start, k in sorted(hits):
        while around and around[-1][0] <= start:
            around.pop()
        _, _, kind, validate = MAGIC[k]
        if start == taken or (kind == "audio/ogg" and around and around[-1][1] == kind):
            continue
        stop = around[-1][0] if around else len(data)
        if validate:
            length = validate(view[start:stop])
        elif kind == "application/pdf":
            documents = documents or _Pdfs(data)
            length = documents.length(start, stop)
        else:
            archives = _zips(data) if archives is None else archives
            length = archives.get(start, 0)
            length = length if start + length <= stop else 0
        if length:
            kind = _RIFF_TYPES.get(data[start + 8 : start + 12], "") if kind == "riff" else kind
            found.append((start, length, kind, len(around)))
            around.append((start + length, kind))
            taken = start
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """Confirmed items (offset, length, type) in order, none inside another."""
    return [(start, length, kind) for start, length, kind, depth in carve(data) if not depth]


def wav_of(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM with the payload as its samples."""
    body = payload + b"\0" * (len(payload) & 1)
    header = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return header + body


def wav_samples(data: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def judge(data: bytes | None, declared: str | None) -> tuple[str | None, int, bool, list[tuple[int, int, str, int]]]:
    """Real type, length, whether the declared type was wrong, and the carved items of a value."""
    if data is None:
        return None, 0, False, []
    items = carve(data)
    head = items[0] if items and items[0][0] == 0 else None
    kind = head[2] if head else UNKNOWN
    return kind, head[1] if head else len(data), declared is not None and declared != kind, items[1:] if head else items


def sniff_column(df: DataFrame, media: str, declared: str | None = None) -> DataFrame:
    """Add media_type (corrected), media_length, type_changed and carved items to a table with a binary column.

    Columns of these names are replaced; all others are kept.
    """
    added = ("media_type", "media_length", "type_changed", "carved")
    kept = [c for c in df.columns if c not in added]
    carved_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("depth", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            said = batch.column(2).to_pylist()
            for value, named in zip(batch.column(1), said):
                kind, length, changed, carved = judge(value.as_py(), named)
                rows.append((kind, length, changed, [{"offset": o, "length": n, "type": t, "depth": d} for o, n, t, d in carved]))
            parts = list(zip(*rows)) or [[]] * 4
            arrays = [pa.array(parts[0], pa.string()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.bool_()), pa.array(parts[3], carved_type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *added])

    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(1))
    inputs = df.select(row.alias("row"), F.col(f"`{media}`").cast("binary").alias("value"), (F.col(f"`{declared}`") if declared else F.lit(None)).cast("string").alias("named"))
    schema = f"row {inputs.schema['row'].dataType.simpleString()}, media_type string, media_length long, type_changed boolean, carved array<struct<offset:long,length:long,type:string,depth:int>>"
    return inputs.mapInArrow(releasing(run), schema).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *added)


def store_texts(docs: DataFrame, pad: int = 64) -> DataFrame:
    """doc_id, n_bytes, media (a WAV file of the padded text), declared (what the source claims)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(v.as_py() or "").encode("utf-8", "replace") for v in part.column(1)]
                media = [wav_of(t + b"\0" * (max(pad, -(-len(t) // pad) * pad) - len(t))) for t in texts]
                arrays = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(["application/octet-stream"] * len(texts), pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "media", "declared"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(releasing(run), "doc_id long, n_bytes long, media binary, declared string")


def media_digest(stored: DataFrame, pad: int = 64) -> DataFrame:
    """Read stored media back: digests of payload and file, and a feature string of signature, samples and the items
    found among the samples (offset in the payload, length, type)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, value, named in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = value.as_py()
                kind, length, changed, carved = judge(data, named)
                payload = wav_samples(data[:length]) if kind == "audio/wav" else data
                samples = np.frombuffer(payload, np.uint8)
                first = len(data) - len(payload) - (len(payload) & 1) if kind == "audio/wav" else 0
                inside = ",".join(f"{o - first}+{n}:{t}" for o, n, t, _ in carved)
                feature = f"{kind};{length};{'corrected' if changed else 'as declared'};carved={len(carved)}[{inside}];mean={samples.mean():.4f};std={samples.std():.4f}"
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-pad:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            parts = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(parts, kinds)], names=names)

    own = stored.select("doc_id", "n_bytes", "media", "declared")
    return own.mapInArrow(releasing(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
