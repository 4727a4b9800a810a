"""Session construction and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "vectorloom", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter builds its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the one given to setCheckpointDir.

    Only a local master falls back to a temporary folder of this machine; any other raises without a shared one.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "vectorloom-checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any of Spark's file systems."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder of any of Spark's file systems."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder within one of Spark's file systems."""
    old, new = spark._jvm.org.apache.hadoop.fs.Path(source), spark._jvm.org.apache.hadoop.fs.Path(target)
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.rename(old, new):
        raise OSError(f"cannot rename {source} to {target}")


@contextmanager
def _without_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when they end; the session's setting comes back after."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written as a Parquet table to the cluster's shared folder and read again.

    All tables of an application lie in one folder there. Lost executors take nothing of it with them, and the
    shuffle files that led to the table are deleted at once. ``discard`` deletes a table that is no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/vectorloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with _without_shuffles_left(spark):
        df.write.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done._written_to = path
    return done


def discard(df: DataFrame) -> None:
    """Delete the table of a checkpoint; neither it nor anything made from it lazily can be read after."""
    remove(df.sparkSession, df._written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
