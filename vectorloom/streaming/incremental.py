"""Incremental cloud metrics over a stream of vector files.

Count, mean and sum of squared deviations per component are mergeable, so each micro-batch adds its own to a
small state table and the metrics that follow from variances are those of everything seen. Deviations are
taken from each part's own mean, so a large mean costs no digits. A batch that comes again after a failure
replaces its own part, so counts stay exact.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vectorloom.functions.vectors import components_of


def partial_sums(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, n, mean, m2) of a batch; m2 is the sum of squared deviations from the mean."""
    long = components_of(df, vector, group)
    return long.groupBy(group, "pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"))


def metrics_of(state: DataFrame, group: str) -> DataFrame:
    """total_spread, participation_ratio_fast, isotropy and density from the parts.

    Parts merge by m2 = sum(m2) + sum(n * (mean - overall mean)^2), where the second term is n times the variance of the
    parts' means; it too is taken from differences to one of the means.
    """
    shift = state.groupBy(group, "pos").agg(F.min("mean").alias("base"))
    near = state.join(shift, [group, "pos"]).withColumn("gap", F.col("mean") - F.col("base"))
    sums = near.groupBy(group, "pos").agg(F.sum("n").alias("n"), F.sum("m2").alias("m2"), F.sum(F.col("n") * F.col("gap")).alias("_first"), F.sum(F.col("n") * F.col("gap") * F.col("gap")).alias("_second"))
    var = sums.withColumn("var", F.greatest(F.lit(0.0), (F.col("m2") + F.col("_second") - F.col("_first") * F.col("_first") / F.col("n")) / F.col("n")))
    out = var.groupBy(group).agg(F.max("n").alias("n"), F.sum("var").alias("total_spread"), F.sum(F.col("var") * F.col("var")).alias("sq"), F.min("var").alias("lo"), F.max("var").alias("hi"))
    return out.select(
        group,
        "n",
        "total_spread",
        (F.col("total_spread") * F.col("total_spread") / F.col("sq")).alias("participation_ratio_fast"),
        (F.col("lo") / F.col("hi")).alias("isotropy"),
        (F.col("n") / F.col("total_spread")).alias("density"),
    )


def stream_metrics(spark: SparkSession, source: str, schema: StructType, state: str, checkpoint: str, group: str, vector: str) -> StreamingQuery:
    """Follow Parquet files under ``source``; parts go to ``state``, one folder per batch. Runs until all files are taken."""
    stream = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, number: int) -> None:
        partial_sums(batch, group, vector).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_metrics(spark: SparkSession, state: str, group: str) -> DataFrame:
    """Metrics of everything seen so far."""
    try:
        return metrics_of(spark.read.parquet(state), group)
    except AnalysisException as e:
        raise FileNotFoundError(f"no state under {state}") from e
