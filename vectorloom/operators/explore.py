"""Summaries of wide metadata tables: completeness, rates, correlations, features, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values, ties by value."""
    return group_counts(df, column).orderBy(F.desc("n"), column).limit(n)


def unpivot(df: DataFrame, keys: list[str], columns: list[str], value: Column | None = None, name: str = "column", out: str = "value") -> DataFrame:
    """Long form of columns that were cast to one type."""
    return df.select(*keys, F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c))]).alias(name, out))


def completeness(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, pct): share of non-null values in per cent, one decimal."""
    rates = df.groupBy(key).agg(*[F.round(100 * F.avg(F.col(c).isNotNull().cast("double")), 1).alias(c) for c in columns])
    return unpivot(rates, [key], columns, out="pct")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls)."""
    return unpivot(df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns]), [], columns, out="nulls")


def flag_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """(flag, pct): per cent true, most frequent first."""
    rates = df.agg(*[(100 * F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))).alias(c) for c in flags])
    return unpivot(rates, [], flags, name="flag", out="pct").orderBy(F.desc("pct"), "flag")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of all ordered pairs, null where a column is constant."""
    cells = [(a, b) for a in columns for b in columns]
    pair = lambda a, b: F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(*[pair(a, b).alias(f"{a}|{b}") for a, b in cells])
    long = unpivot(wide, [], [f"{a}|{b}" for a, b in cells], name="pair", out="r")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def pivot_counts(df: DataFrame, row: str, column: str, values: list, least: int = 1) -> DataFrame:
    """Count table with a column per value, cells of at most ``least`` shown as 0."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)
    return wide.select(row, *[F.when(F.col(f"`{v}`") > least, F.col(f"`{v}`")).otherwise(F.lit(0)).alias(str(v)) for v in values])


def group_medians(df: DataFrame, key: str, value: str, distinct: str) -> DataFrame:
    """(key, median, n, n_distinct)."""
    return df.groupBy(key).agg(F.median(value).alias("median"), F.count("*").alias("n"), F.countDistinct(distinct).alias("n_distinct"))


def mean_se(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard error and count per group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))


def minmax_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns brought to [0, 1] with 1e-8 added to each range."""
    bounds = df.agg(*[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns]).first()
    scaled = {c: (F.col(c) - bounds[f"{c}_lo"]) / (bounds[f"{c}_hi"] - bounds[f"{c}_lo"] + 1e-8) for c in columns}
    return df.withColumns(scaled)


def feature_matrix(df: DataFrame, key: str, numeric: list[str], flags: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """(key, features): numbers (null as 0), flags and one-hot categories, each z-scored; a deviation of 0 counts as 1."""
    cols = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}
    cols |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags}
    cols |= {f"{c}={v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, values in categories.items() for v in values}
    names = {c: f"f{k}" for k, c in enumerate(cols)}
    wide = df.select(key, *[e.alias(names[c]) for c, e in cols.items()])
    stats = wide.agg(*[F.avg(n).alias(f"{n}m") for n in names.values()], *[F.stddev_pop(n).alias(f"{n}s") for n in names.values()]).first()
    scaled = [(F.col(n) - (stats[f"{n}m"] or 0.0)) / (stats[f"{n}s"] or 1.0) for n in names.values()]
    return wide.select(key, F.array(*scaled).alias("features"))


def similarity_graph(features: DataFrame, key: str, k: int = 5, least: float = 0.90) -> DataFrame:
    """(src, dst, sim): cosine neighbours among the k nearest with similarity above the threshold, both directions.

    On unit vectors the order by distance is that by cosine, so the block kernel serves.
    """
    from vectorloom.functions.vectors import doubles, norm, unit
    from vectorloom.operators.blocks import nearest

    rows = features.where(norm(doubles("features")) > 0).select(F.col(key), unit(doubles("features")).alias("u"))
    near = nearest(rows, rows, key, "u", k, exclude_self=True).select("src", "dst", (1 - F.col("d") * F.col("d") / 2).alias("sim")).where(F.col("sim") > least)
    return near.union(near.select("dst", "src", "sim")).groupBy("src", "dst").agg(F.max("sim").alias("sim"))


def similarity_band(sim: Column) -> Column:
    """high above 0.97, medium above 0.93, else low."""
    return F.when(sim > 0.97, "high").when(sim > 0.93, "medium").otherwise("low")


def first_rows(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each group in the given order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def range_lookup(values: DataFrame, value: str, bounds: list[tuple[str, int]]) -> DataFrame:
    """Global index -> (dataset, local index) from cumulative sizes [(dataset, rows)], a list given by the caller."""
    rows, start = [], 0
    for name, size in bounds:
        rows.append((name, start, start + size))
        start += size
    table = values.sparkSession.createDataFrame(rows, "dataset string, lo long, hi long")
    joined = values.join(F.broadcast(table), (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")))
    return joined.select(*values.columns, "dataset", (F.col(value) - F.col("lo")).alias("local_index"))


def in_all_groups(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that occur in every group."""
    total = df.select(group).distinct().count()
    return df.groupBy(item).agg(F.countDistinct(group).alias("n")).where(F.col("n") == total).select(item)
