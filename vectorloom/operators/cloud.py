"""Geometry metrics of one cloud of vectors, per key or for a whole table.

Variances are population variances unless said otherwise. Metrics that need only per-component
statistics are relational; those of the spectrum come from the covariance matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.vectors import components_of
from vectorloom.operators.moments import Moments, component_stats, moments


def _keyed(df: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    return (df, keys) if keys else (df.withColumn("_all", F.lit(0)), ("_all",))


def distances_to_centroid(df: DataFrame, key: str, vector: str, *groups: str) -> DataFrame:
    """(key, groups, d): Euclidean distance of each row to its group's mean."""
    df, by = _keyed(df, groups)
    long = components_of(df, vector, key, *by)
    centre = long.groupBy(*by, "pos").agg(F.avg("x").alias("m"))
    gaps = long.join(centre, [*by, "pos"]).groupBy(key, *by).agg(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)).alias("d"))
    return gaps.select(key, *groups, "d")


def fast_metrics(df: DataFrame, vector: str, *groups: str) -> DataFrame:
    """Metrics of the per-component variances, one row per group.

    total_spread, density (n over spread, infinite at 0), isotropy (min over max variance, 0 at 0),
    anisotropy_ratio (max over min, infinite at 0), participation_ratio_fast, effective_rank_fast (exponential
    of the entropy of variance shares), mean / max / min variance and mean deviation.
    """
    df, by = _keyed(df, groups)
    stats = component_stats(df, vector, *by)
    total = stats.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.sum("var").alias("total_spread"),
        (F.sum("var") * F.sum("var") / F.sum(F.col("var") * F.col("var"))).alias("participation_ratio_fast"),
        F.min("var").alias("min_variance"),
        F.max("var").alias("max_variance"),
        F.avg("var").alias("mean_variance"),
        F.avg(F.sqrt("var")).alias("mean_std"),
        F.sum(F.when(F.col("var") > 0, F.col("var") * F.ln("var"))).alias("vlnv"),
    )
    infinite = F.lit(float("inf"))
    # the entropy of shares v / s is ln s - sum(v ln v) / s, so no second pass is needed
    return total.select(
        *groups,
        F.col("n"),
        "total_spread",
        F.when(F.col("total_spread") > 0, F.col("n") / F.col("total_spread")).otherwise(infinite).alias("density"),
        F.when(F.col("max_variance") > 0, F.col("min_variance") / F.col("max_variance")).otherwise(F.lit(0.0)).alias("isotropy"),
        F.when(F.col("min_variance") > 0, F.col("max_variance") / F.col("min_variance")).otherwise(infinite).alias("anisotropy_ratio"),
        "participation_ratio_fast",
        F.exp(F.ln("total_spread") - F.col("vlnv") / F.col("total_spread")).alias("effective_rank_fast"),
        "mean_variance",
        "max_variance",
        "min_variance",
        "mean_std",
    )


def centroid_spread(df: DataFrame, key: str, vector: str, *groups: str) -> DataFrame:
    """mean and population deviation of the distances to the centroid."""
    gaps, by = _keyed(distances_to_centroid(df, key, vector, *groups), groups)
    out = gaps.groupBy(*by).agg(F.avg("d").alias("mean_distance_to_centroid"), F.stddev_pop("d").alias("std_distance_to_centroid"))
    return out.select(*groups, "mean_distance_to_centroid", "std_distance_to_centroid")


def report(df: DataFrame, key: str, vector: str, *groups: str) -> DataFrame:
    """fast_metrics and centroid_spread side by side."""
    left, by = _keyed(fast_metrics(df, vector, *groups), groups)
    right, _ = _keyed(centroid_spread(df, key, vector, *groups), groups)
    joined = left.join(right, list(by))
    return joined.drop("_all")


def participation_ratio(df: DataFrame, vector: str) -> DataFrame:
    """(sum s^2)^2 / sum s^4 of the singular values, by the identity tr(C)^2 / |C|^2 on covariances."""
    from vectorloom.operators.moments import covariance_long

    cov = covariance_long(df, vector)
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("cov")))
    return cov.agg((trace * trace / F.sum(F.col("cov") * F.col("cov"))).alias("participation_ratio"))


def spectrum(m: Moments) -> np.ndarray:
    """Positive eigenvalues of the covariance matrix, largest first."""
    values = np.linalg.eigvalsh(m.covariance())[::-1]
    return values[values > 0]


def spectral_metrics(m: Moments) -> dict[str, float]:
    """Metrics of the covariance spectrum; the top-eigenvalue ratio is over the ten largest."""
    lam = spectrum(m)
    if not len(lam):
        return dict.fromkeys(("n_components_90pct", "explained_var_ratio_top1", "explained_var_ratio_top3", "top_eigenvalue_ratio", "spectral_entropy", "effective_rank", "participation_ratio"), 0.0)
    share = lam / lam.sum()
    s = np.sqrt(lam * (m.n - 1))
    p = s / s.sum()
    entropy = float(-(p * np.log(p)).sum())
    return {
        "n_components_90pct": float(int(np.searchsorted(np.cumsum(share), 0.90 - 1e-12)) + 1),
        "explained_var_ratio_top1": float(share[0]),
        "explained_var_ratio_top3": float(share[:3].sum()),
        "top_eigenvalue_ratio": float(lam[0] / lam[:10].sum()),
        "spectral_entropy": entropy,
        "effective_rank": float(np.exp(entropy)),
        "participation_ratio": float((s**2).sum() ** 2 / (s**4).sum()),
    }


def pca_summary(m: Moments) -> dict[str, object]:
    """Ten largest eigenvalues, their shares of the total and the count that explains 90 %."""
    lam = spectrum(m)
    share = lam / lam.sum() if len(lam) else lam
    return {"eigenvalues": lam[:10].tolist(), "explained": share[:10].tolist(), "k90": int(spectral_metrics(m)["n_components_90pct"])}


METRICS = (
    "total_spread", "mean_distance_to_centroid", "std_distance_to_centroid", "isotropy", "anisotropy_ratio", "density",
    "participation_ratio_fast", "effective_rank_fast", "n_components_90pct", "explained_var_ratio_top1", "explained_var_ratio_top3",
    "top_eigenvalue_ratio", "spectral_entropy", "effective_rank", "participation_ratio",
)


def compute_metrics(df: DataFrame, key: str, vector: str, names: list[str] | None = None) -> dict[str, float]:
    """All metrics, or the named ones, of a whole table; unknown names raise."""
    wanted = list(names or METRICS)
    unknown = [n for n in wanted if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    found = report(df, key, vector).first().asDict()
    found |= spectral_metrics(moments(df, vector))
    return {n: float(found[n]) for n in wanted}
