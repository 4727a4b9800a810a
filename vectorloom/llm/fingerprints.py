"""One-permutation MinHash fingerprints in DataFrame operations only.

Each five-word shingle of a text is hashed once. The top bits of the hash name a bin and the smallest
hash of each bin is kept. Empty bins are filled by optimal densification: every bin has its own order
in which it tries the others (an affine permutation from a two-universal family) and takes the minimum of
the first one that is filled, hashed again with its own number: bins that take the same minimum then agree
with another text's by chance independently. The low ``bits`` bits of every bin are packed into 64-bit words. Two fingerprints
are compared word by word; the share m of equal bins overstates the likeness by chance agreement
C = 2^-bits, so the estimate is (m - C) / (1 - C), cut off at 0.

Everything is a projection over one row, so no shuffle is needed to fingerprint a table. Only the pairing
of a document with the next one moves rows (``with_next``).

Edge cases: words are what lies between the characters 9-13 and 32 after lower-casing; a text of one to
four words is one shingle; a text without words, null texts included, has an empty fingerprint, whose
likeness is 1 to another empty one and 0 to any other. Equal texts have equal fingerprints. Repeated
rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, WIDTH, PROBES = 256, 4, 5, 4
CELL_BITS, LEVEL_BITS = 9, 15
_ODD, _SHIFT = 0x9E3779B1, 0x85EBCA6B


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: Catalyst does not copy a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def _shingle_hashes(text: Column, width: int) -> Column:
    """Sorted non-negative 63-bit hashes of the text's shingles; none for a text without words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(hashed: Column) -> Column:
        last = F.greatest(F.lit(1), F.size(hashed) - (width - 1))
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(hashed, i, width)), 1))
        return F.when(F.size(hashed) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(each))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> Column:
    """Packed fingerprint of a text as array<bigint>, empty for texts without words.

    bins: a power of two. A bin i without a hash asks bins (t * step(i) + start(i)) mod bins for t = 0, 1, ..;
    the step is odd, so every bin is met. The first probes are looked up; where they fail, the least t
    over all filled bins is found from the inverse of the step.
    """
    log, per_word, low, mask = bins.bit_length() - 1, 64 // bits, (1 << bits) - 1, bins - 1
    null = F.lit(None).cast("bigint")

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, 63 - log)

    def densified(minima: Column) -> Column:
        # value of every bin in order, null where empty: each minimum, then the gap up to the next one
        def with_gap(h: Column, j: Column) -> Column:
            following = F.coalesce(bin_of(F.try_element_at(minima, j + 2)), F.lit(bins).cast("bigint"))
            return F.concat(F.array(h), F.array_repeat(null, (following - bin_of(h) - 1).cast("int")))

        lead = F.array_repeat(null, bin_of(minima[0]).cast("int"))
        sparse = F.concat(lead, F.flatten(F.transform(minima, with_gap)))

        def fill(values: Column) -> Column:
            def ask(i: Column) -> Column:
                start = F.shiftrightunsigned((i + 1) * F.lit(_SHIFT).cast("bigint"), 11).bitwiseAND(mask)
                step = F.shiftrightunsigned((i + 1) * F.lit(_ODD).cast("bigint"), 9).bitwiseAND(mask).bitwiseOR(1)
                probes = [F.try_element_at(values, ((step * t + start).bitwiseAND(mask) + 1).cast("int")) for t in range(PROBES)]

                def search(inverse: Column) -> Column:
                    turn = lambda h: F.struct(((bin_of(h) - start + bins) * inverse).bitwiseAND(mask).alias("t"), h.alias("h"))
                    return F.array_min(F.transform(minima, turn))["h"]

                inverse = _let(step, lambda s: _let(s * (2 - s * s), lambda x: (x * (2 - s * x)).bitwiseAND(mask)))
                return F.xxhash64(F.coalesce(*probes, _let(inverse, search)), i)

            return F.transform(values, lambda v, i: F.coalesce(v, ask(i.cast("bigint"))).bitwiseAND(low))

        return _let(sparse, fill)

    def pack(values: Column) -> Column:
        word = lambda k: F.aggregate(F.slice(values, k * per_word + 1, per_word), F.lit(0).cast("bigint"), lambda acc, v: F.shiftleft(acc, bits).bitwiseOR(v))
        return F.transform(F.sequence(F.lit(0), F.lit(bins // per_word - 1)), word)

    def of_hashes(hashes: Column) -> Column:
        smallest = F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.try_element_at(hashes, F.greatest(i, F.lit(1))))))
        filled = _let(smallest, lambda m: _let(densified(m), pack))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(filled)

    return _let(_shingle_hashes(text, width), of_hashes)


def as_text(packed: Column) -> Column:
    """Fixed-width hexadecimal form, 16 digits a word."""
    return F.array_join(F.transform(packed, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Bias-corrected estimate of the Jaccard similarity of two packed fingerprints, 0 to 1."""
    unit = sum(1 << (bits * i) for i in range(64 // bits))
    unit = unit - (1 << 64) if unit >= 1 << 63 else unit

    def different(x: Column) -> Column:
        folded = x
        step = 1
        while step < bits:
            folded = folded.bitwiseOR(F.shiftrightunsigned(folded, step))
            step *= 2
        return F.bit_count(folded.bitwiseAND(F.lit(unit).cast("long")))

    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: different(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0**-bits
    estimate = F.greatest(F.lit(0.0), ((1 - unequal / F.lit(float(bins))) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(estimate)


def _next_heads(cells: DataFrame, shifts: list[int]) -> DataFrame:
    """cell, next_cell: the non-empty cell that follows each non-empty cell; the last is followed by the first.

    Neighbours inside a group of 2^LEVEL_BITS cells are found by a window over that group; the last cell
    of a group asks the next level, whose rows are the groups. No window sees more than 2^LEVEL_BITS rows
    but the topmost, whose groups number at most 2^(64 - all shifts).
    """
    shift, deeper = shifts[0], shifts[1:]
    grouped = cells.withColumn("group", F.shiftright("cell", shift) if shift < 64 else F.lit(0).cast("long"))
    within = grouped.withColumn("next_cell", F.lead("cell").over(Window.partitionBy("group").orderBy("cell")))
    if not deeper:
        first = F.min("cell").over(Window.partitionBy("group"))
        return within.select("cell", F.coalesce("next_cell", first).alias("next_cell"))
    heads = grouped.groupBy("group").agg(F.min("cell").alias("head"))
    up = _next_heads(heads.select(F.col("group").alias("cell")), deeper)
    follow = up.join(heads.select(F.col("group").alias("next_cell"), F.col("head").alias("next_head")), "next_cell").select(F.col("cell").alias("group"), "next_head")
    return within.join(follow, "group", "left").select("cell", F.coalesce("next_cell", "next_head").alias("next_cell"))


def with_next(df: DataFrame, key: str, text: str, derive: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """derive(df) with ``next_<c>`` of the row with the next key; the last row is followed by the first.

    Rows are dealt once by cells of 2^CELL_BITS adjacent keys, so a window holds as many rows at most when
    keys are unique. The last row of a cell takes the first row of the next non-empty cell, found on
    the keys alone. derive adds columns after the exchange, which all three uses below share; for the
    cells' first and last rows it runs on those rows only. Null keys come first; ties are ordered by the text.
    """
    dealt = df.withColumn("cell", F.shiftright(F.coalesce(F.col(key), F.lit(-(2**63))), CELL_BITS)).repartition("cell")
    order = Window.partitionBy("cell").orderBy(key, text)
    inner = derive(dealt).withColumn("nk_next", F.lead(F.struct(*carried)).over(order)).where("nk_next is not null")
    ends = dealt.withColumn("nk_first", F.lag(F.lit(1)).over(order).isNull()).withColumn("nk_last", F.lead(F.lit(1)).over(order).isNull())
    follow = _next_heads(df.select(F.shiftright(F.coalesce(F.col(key), F.lit(-(2**63))), CELL_BITS).alias("cell")).distinct(), [LEVEL_BITS, LEVEL_BITS, LEVEL_BITS, 64])
    heads = derive(ends.where("nk_first")).select(F.col("cell").alias("next_cell"), F.struct(*carried).alias("nk_next"))
    tails = derive(ends.where("nk_last")).join(follow, "cell").join(heads, "next_cell")
    kept = [c for c in inner.columns if c not in ("cell", "nk_next")] + [F.col(f"nk_next.{c}").alias(f"next_{c}") for c in carried]
    return inner.select(*kept).unionByName(tails.select(*kept))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """The digest of fingerprints of every text, its edited text and the likeness to the next text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document's text (all, if it is shorter). Each text is fingerprinted once and moved once.
    """
    # no cast where none is needed: a redundant alias would be dropped from some uses of the exchange only
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType.typeName() == "long" else F.col("doc_id").cast("long").alias("doc_id")
    base = docs.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(base, "doc_id", "text", lambda df: df.withColumn("fp", fingerprint(F.col("text"))), ["text", "fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    paired = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    both = paired.withColumn("edited_fp", fingerprint(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
