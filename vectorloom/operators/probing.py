"""Linear probes and classification scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.vectors import doubles
from vectorloom.operators.moments import matrix_of, moments
from vectorloom.operators.prototypes import as_matrix, assign_nearest, centroids


@dataclass(frozen=True)
class Probe:
    """Weights (d x classes); a row gets the class of its largest score, the first of equals."""

    classes: list[int]
    weights: np.ndarray

    def predict(self, df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
        """(key, truth, predicted)."""
        names = np.array(self.classes, dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix_of(batch.column(2))
                if len(x):
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[(x @ self.weights).argmax(1)])], names=[key, "truth", "predicted"])

        rows = df.select(F.col(key).cast("long"), F.col(label).cast("long"), doubles(vector))
        return rows.mapInArrow(run, f"{key} long, truth long, predicted long")


def fit_probe(df: DataFrame, vector: str, label: str) -> Probe:
    """Least squares onto one-hot targets without intercept, from the Gram matrices of one pass."""
    classes = [r[0] for r in df.select(F.col(label).cast("long")).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    target = F.array(*[(F.col(label) == c).cast("double") for c in classes])
    rows = df.where(F.col(label).isNotNull()).select(doubles(vector).alias("x"), target.alias("y"))
    return Probe([int(c) for c in classes], np.linalg.lstsq(moments(rows, "x").cross, moments(rows, "x", "y").cross, rcond=None)[0])


def fit_logistic(df: DataFrame, vector: str, label: str, iterations: int = 100) -> object:
    """Spark's multinomial logistic regression; the fitted model transforms a column ``features``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(doubles(vector)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=iterations).fit(rows)


def nearest_centroid(train: DataFrame, test: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, truth, predicted) by the nearest class mean."""
    labels, matrix = as_matrix(centroids(train, key, vector, train.select(key, F.col(label).alias("cluster"))))
    found = assign_nearest(test, key, vector, matrix, labels)
    return test.select(key, F.col(label).cast("long").alias("truth")).join(found.select(key, F.col("cluster").alias("predicted")), key)


def scores(predictions: DataFrame) -> DataFrame:
    """accuracy and macro precision, recall and F1 over the labels of truth or prediction; 0 where undefined."""
    hits = F.sum((F.col("truth") == F.col("predicted")).cast("long"))
    by_truth = predictions.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("support"), hits.alias("tp"))
    by_said = predictions.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("said"), hits.alias("tp2"))
    per = by_truth.join(by_said, "label", "full").select("label", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("said", F.lit(0)).alias("said"), F.coalesce("tp", "tp2", F.lit(0)).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    per = per.select("support", "tp", p.alias("p"), r.alias("r")).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))


def pick_split(available: list[str], wanted: tuple[str, ...] = ("test", "validation", "valid")) -> str:
    """The first wanted split there is, else any."""
    if not available:
        raise ValueError("no split to probe on")
    return next((s for s in wanted if s in available), sorted(available)[0])
