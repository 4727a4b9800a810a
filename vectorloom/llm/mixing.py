"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each stratum (a source named in the weights, or all others together) gets a mean repetition rate:
its share of the wanted output divided by the share it has, where the weights of the strata that have a
size are scaled to sum to 1. Every document draws a uniform number
from a hash of the seed and its id, inverts the Poisson distribution with that mean and is repeated
so many times; a large mean is the sum of equal parts, each with a number of its own. The copies are then shuffled globally by a second hash.

The rates come from one aggregation whose result has a row per stratum, so its size is bounded by
the weights given; it is broadcast. Nothing is grouped by source afterwards, so a source with a third
of all rows is no hot spot.

Edge cases: null sources belong to the other stratum; a null or empty text has size 0 and takes part
in the draw; a null id draws like an empty string; repeated rows draw the same number and so appear
equally often; a stratum all of whose texts are empty has nothing to weigh and rate 1; an empty table
gives an empty result; other columns are kept, but those named ``copy``, ``n_copies`` and ``shuffle_key``
are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "(other)"


def _unit(seed: str, *columns: str, part=None):
    """A number in (0, 1) from 52 bits of an md5, the same in every engine; another one for each further part."""
    further = [] if part is None else [F.lit("part"), part.cast("string")]
    joined = F.concat_ws("-", F.lit(seed), *further, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def mix(docs: DataFrame, weights: dict[str, float], other_weight: float, size_factor: float = 1.0, seed: str = "mix-1", part_rate: float = 64.0) -> DataFrame:
    """Repeat documents so that sizes in code points follow the weights; globally shuffled.

    weights: target share by source; other_weight: that of all other sources together. size_factor: wanted
    output size by input size. part_rate: a rate above it is drawn as a sum of parts up to it, which keeps the
    inverted table short. Returns the input's columns, then copy (from 0), n_copies and shuffle_key.
    """
    total_weight = sum(weights.values()) + other_weight
    names = sorted(weights)
    kept = [c for c in docs.columns if c.lower() not in ("copy", "n_copies", "shuffle_key")]
    own = "mix"
    while any(c.lower().startswith(own) for c in kept):
        own += "_"
    c = {k: f"{own}_{k}" for k in ("stratum", "size", "own", "all", "present", "rate", "parts", "below", "u")}
    stratum = F.when(F.col("source").isin(names), F.col("source")).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)
    wanted = F.create_map(*[F.lit(x) for name in names for x in (name, weights[name] / total_weight)], F.lit(OTHER), F.lit(other_weight / total_weight))

    sizes = docs.select(stratum.alias(c["stratum"]), F.length("text").alias(c["size"])).groupBy(c["stratum"]).agg(F.coalesce(F.sum(c["size"]), F.lit(0)).alias(c["own"]))
    everything = Window.partitionBy(F.lit(1))  # one row per stratum
    shares = F.sort_array(F.collect_list(F.when(F.col(c["own"]) > 0, wanted[F.col(c["stratum"])])).over(everything))
    sizes = sizes.withColumn(c["all"], F.sum(c["own"]).over(everything)).withColumn(c["present"], F.aggregate(shares, F.lit(0.0), lambda acc, w: acc + w))
    rate = F.when(F.col(c["own"]) == 0, F.lit(1.0)).when(F.col(c["present"]) == 0, F.lit(0.0))
    rate = rate.otherwise(wanted[F.col(c["stratum"])] / F.col(c["present"]) * size_factor * F.col(c["all"]) / F.col(c["own"]))
    parts = F.greatest(F.lit(1), F.ceil(rate / part_rate)).cast("int")
    # P(N <= k) for k = 0.. until what is left is below the hash's resolution
    longest = int(part_rate + 12 * math.sqrt(part_rate) + 24)
    part = F.col(c["rate"])
    step = lambda acc, k: F.struct(
        (acc["term"] * part / k).alias("term"),
        (acc["sum"] + acc["term"] * part / k).alias("sum"),
        F.concat(acc["below"], F.array(acc["sum"] + acc["term"] * part / k)).alias("below"),
    )
    zero = F.exp(-part)
    steps = F.sequence(F.lit(1), F.least(F.lit(longest), (part + 12 * F.sqrt(part) + 24).cast("int")))
    start = F.struct(zero.alias("term"), zero.alias("sum"), F.array(zero).alias("below"))
    rates = sizes.withColumn(c["parts"], parts).withColumn(c["rate"], rate / F.col(c["parts"]))
    rates = rates.select(c["stratum"], c["parts"], F.aggregate(steps, start, step, lambda acc: acc["below"]).alias(c["below"]))

    drawn = docs.select(*[F.col(f"`{k}`") for k in kept]).withColumn(c["stratum"], stratum).withColumn(c["u"], _unit(seed, "doc_id"))
    draw = lambda u: F.size(F.filter(c["below"], lambda x: x < u)).cast("long")
    further = F.aggregate(F.sequence(F.lit(2), F.col(c["parts"])), F.lit(0).cast("long"), lambda acc, k: acc + draw(_unit(seed, "doc_id", part=k)))
    drawn = drawn.join(F.broadcast(rates), c["stratum"]).withColumn("n_copies", draw(F.col(c["u"])) + F.when(F.col(c["parts"]) > 1, further).otherwise(F.lit(0)))
    copies = drawn.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long"))
    return keyed.select(*[F.col(f"`{k}`") for k in kept], "copy", "n_copies", "shuffle_key").sort("shuffle_key")


def oracle_sql(weights: dict[str, float], other_weight: float, size_factor: float = 1.0, seed: str = "mix-1", part_rate: float = 64.0, documents: str = "documents") -> str:
    """DuckDB form of ``mix`` for the columns doc_id, source, copy, n_copies, shuffle_key."""
    total_weight = sum(weights.values()) + other_weight
    rows = ", ".join(f"('{n}', {w / total_weight!r}::double)" for n, w in [*sorted(weights.items()), (OTHER, other_weight)])
    named = ", ".join(f"'{n}'" for n in sorted(weights)) or "NULL"
    longest = int(part_rate + 12 * math.sqrt(part_rate) + 24)
    unit = "(CAST('0x' || substr(md5('{seed}-{part}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::double + 0.5) / 4503599627370496.0"
    first, further = unit.format(seed=seed, part=""), unit.format(seed=seed, part="part-' || CAST(k AS VARCHAR) || '-")
    return f"""
WITH RECURSIVE w(stratum, share) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS place, doc_id, source, length(text) AS n, CASE WHEN source IN ({named}) THEN source ELSE '{OTHER}' END AS stratum FROM {documents}),
own AS (SELECT stratum, coalesce(sum(n), 0) AS own FROM d GROUP BY stratum),
everything AS (SELECT sum(own) AS total, coalesce(list_reduce(list_prepend(0.0::double, list_sort(list(share) FILTER (own > 0))), lambda a, b: a + b), 0) AS present FROM own JOIN w USING (stratum)),
whole AS (SELECT stratum, CASE WHEN own = 0 THEN 1.0::double WHEN present = 0 THEN 0.0::double ELSE share / present * {size_factor!r}::double * total / own END AS rate FROM own JOIN w USING (stratum), everything),
rate AS (SELECT stratum, greatest(1, ceil(rate / {part_rate!r}::double))::int AS parts, rate / greatest(1, ceil(rate / {part_rate!r}::double))::int AS rate FROM whole),
cdf(stratum, rate, k, term, below) AS (
  SELECT stratum, rate, 0, exp(-rate), exp(-rate) FROM rate
  UNION ALL SELECT stratum, rate, k + 1, term * rate / (k + 1), below + term * rate / (k + 1) FROM cdf WHERE k < least({longest}, CAST(floor(rate + 12 * sqrt(rate) + 24) AS INT))),
u AS (SELECT place, doc_id, source, stratum, {first} AS u FROM d
  UNION ALL SELECT place, doc_id, source, stratum, {further} FROM d JOIN rate USING (stratum), LATERAL (SELECT unnest(range(2, parts + 1)) AS k) p),
c AS (SELECT place, doc_id, source, sum((SELECT count(*) FROM cdf WHERE cdf.stratum = u.stratum AND cdf.below < u.u))::BIGINT AS n_copies FROM u GROUP BY ALL)
SELECT doc_id, source, g.copy, n_copies, CAST('0x' || substr(md5('{seed}-order-' || coalesce(CAST(doc_id AS VARCHAR), '') || '-' || CAST(g.copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
FROM c, LATERAL (SELECT unnest(range(0, n_copies)) AS copy) g
"""
