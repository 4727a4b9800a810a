"""Reading and writing of embedding tables, registries and result tables.

Embedding tables lie under ``<root>/<split>/<model>/part-*.parquet``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a path; none raises."""
    try:
        return spark.read.option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no Parquet files under {path}") from e


def first_rows(spark: SparkSession, path: str, n: int, key: str = "id") -> DataFrame:
    """The n rows with the smallest keys; only their columns are read."""
    return spark.read.parquet(path).orderBy(key).limit(n)


def read_embeddings(spark: SparkSession, root: str, model: str, split: str, label: str | None = None, key: str = "id") -> DataFrame:
    """(id, embedding[, label]) of one model and split."""
    columns = [key, "embedding"] + ([label] if label else [])
    return read_tables(spark, f"{root}/{split}/{model}").select(*columns)


def label_column(extras: Iterable[str] | None) -> str:
    """The first declared extra column, or ``label``."""
    return next(iter(extras or ()), "label")


def layout(spark: SparkSession, root: str) -> DataFrame:
    """(split, models) of the files below a root, from their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("model"))
    return named.groupBy("split").agg(F.array_sort(F.collect_set("model")).alias("models"))


def health(spark: SparkSession, paths: list[str], known: DataFrame | None = None) -> DataFrame:
    """(path, ok, error) of reading one row of every table; those in ``known`` are not tried again."""
    done = {r["path"] for r in known.select("path").collect()} if known is not None else set()
    rows = []
    for path in paths:
        if path in done:
            continue
        try:
            spark.read.parquet(path).limit(1).collect()
            rows.append((path, True, None))
        except Exception as e:  # any failure of a table is its result
            rows.append((path, False, type(e).__name__))
    fresh = spark.createDataFrame(rows, "path string, ok boolean, error string")
    return fresh if known is None else known.unionByName(fresh)


def named_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Result files named ``a__b__dataset.parquet``, with these three as columns."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.parquet$", "")
    return df.withColumn("_parts", F.split(stem, "__")).select(
        *df.columns, F.col("_parts")[0].alias("name_a"), F.col("_parts")[1].alias("name_b"), F.col("_parts")[2].alias("dataset")
    )


def parse_result_name(name: str) -> dict[str, str | None]:
    """``stat__metric__case[___type|__dataset]`` -> its parts."""
    stem = name.removesuffix(".parquet")
    stem, _, kind = stem.partition("___")
    parts = stem.split("__")
    return {"stat": parts[0], "metric": parts[1] if len(parts) > 1 else None, "stat_case": parts[2] if len(parts) > 2 else None, "dataset": parts[3] if len(parts) > 3 else None, "regression_type": kind or None}


def write_sharded(df: DataFrame, path: str, rows_per_file: int = 100_000, mode: str = "overwrite") -> None:
    """Parquet files of at most so many rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_single(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Parquet file; for small results."""
    df.coalesce(1).write.mode(mode).parquet(path)


def keep_first(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, then fresh rows whose key is new; one row per key, columns missing on a side are null."""
    both = existing.withColumn("_prio", F.lit(0)).unionByName(fresh.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_prio"]
    order = Window.partitionBy(*keys).orderBy("_prio", *rest)
    return both.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_prio", "_place")


def upsert(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Merge fresh rows into the table at a path; the existing row of a key wins.

    Only a path that does not exist counts as no table yet. Every other fault (a column whose type clashes, a key
    that a side lacks, files that cannot be read) raises and leaves the table as it is. The merged table is
    written beside the old one, which is renamed aside, replaced and only then deleted; if the replacement fails
    the old one is renamed back.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    exists = system.exists(target)
    existing = spark.read.parquet(path) if exists else fresh.limit(0)
    for side, df in (("existing", existing), ("fresh", fresh)):
        lacking = [k for k in keys if k not in df.columns]
        if lacking:
            raise ValueError(f"the {side} rows lack the key columns {', '.join(lacking)}")
    types = {f.name: f.dataType for f in existing.schema}
    clashes = [f.name for f in fresh.schema if f.name in types and f.dataType != types[f.name]]
    if clashes:
        raise ValueError(f"the types of {', '.join(clashes)} differ from the existing table's")
    made, aside = (spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-{uuid.uuid4().hex}") for _ in range(2))
    keep_first(existing, fresh, keys).write.parquet(made.toString())
    if exists and not system.rename(target, aside):
        raise OSError(f"{path} could not be renamed; the merged table is at {made.toString()}")
    if not system.rename(made, target):
        if exists:
            system.rename(aside, target)
        raise OSError(f"{path} could not be replaced; the merged table is at {made.toString()}")
    if exists:
        system.delete(aside, True)
    return spark.read.parquet(path)


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that have no output yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows, columns by name, missing ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_file(df: DataFrame, path: str) -> None:
    """One Parquet file of exactly this name, for small results; an older file of the name is replaced."""
    spark = df.sparkSession
    made = f"{path}-{uuid.uuid4().hex}"
    write_single(df, made)
    target, folder = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, made))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")]
    system.delete(target, False)
    moved = system.rename(part, target)
    system.delete(folder, True)
    if not moved:
        raise OSError(f"{path} could not be written")


def write_failures(checked: DataFrame, path: str) -> int:
    """Failed rows of a health table as JSON lines in one file; their number."""
    failed = checked.where(~F.col("ok"))
    failed.coalesce(1).write.mode("overwrite").json(path)
    return failed.count()


def clean(spark: SparkSession, pattern: str) -> list[str]:
    """Delete what a glob pattern matches, on any of Spark's file systems; the deleted paths in order."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in system.globStatus(glob) or ()]
    return sorted(p.toString() for p in found if system.delete(p, True))


def not_uploaded(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(split, model) of ``layout`` tables that the remote side lacks."""
    flat = [df.select("split", F.explode("models").alias("model")) for df in (local, remote)]
    return todo(*flat, ["split", "model"])


def names_of(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-null values of several columns."""
    out = None
    for c in columns:
        rows = df.select(F.col(c).alias("name"))
        out = rows if out is None else out.union(rows)
    return out.where("name is not null").distinct()


def split_rows(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """The rows with ``split``: train for those whose md5 of seed and key falls into the share, else test; no shuffle."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(draw < int(share * 2**32), "train").otherwise("test"))


def from_arrow(spark: SparkSession, arrow_table) -> DataFrame:
    """A frame of an Arrow table's rows."""
    return spark.createDataFrame(arrow_table)


def models_per_split(df: DataFrame) -> DataFrame:
    """(split, n_models)."""
    return df.groupBy("split").agg(F.countDistinct("model").alias("n_models"))


def dataset_card(name: str, found: DataFrame) -> str:
    """Text of a data set's card from its ``layout`` table: a config per model with its splits, and models per split."""
    flat = found.select("split", F.explode("models").alias("model"))
    configs = flat.groupBy("model").agg(F.array_sort(F.collect_set("split")).alias("splits")).orderBy("model").collect()
    counts = models_per_split(flat).orderBy("split").collect()
    lines = ["---", "configs:"]
    for config in configs:
        lines += [f"- config_name: {config['model']}", "  data_files:"]
        lines += [line for s in config["splits"] for line in (f"  - split: {s}", f"    path: {s}/{config['model']}/part-*.parquet")]
    return "\n".join([*lines, "---", f"# {name}", "", "| split | models |", "|-|-|", *[f"| {c['split']} | {c['n_models']} |" for c in counts], ""])


def encode(df: DataFrame, function, schema: str) -> DataFrame:
    """Hook for an encoder: a function from iterators of pandas frames to such iterators."""
    return df.mapInPandas(function, schema)
