"""Matched-pair regressions with heteroscedasticity-robust (HC3) errors.

The design is made of the treatment and of factors, so a regression needs nothing of its rows but the count, mean and
squared deviations of the outcome in each cell of treatment and factor levels. Spark adds these up; a regression is
fitted from its cells alone. A long table may be weighted: a column ``n`` says how often a row counts.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.numerics import f_sf, normal_quantile, normal_sf2, t_sf2

RESULT = "analysis_type string, outcome string, term string, beta double, se double, stat double, p double, ci_low double, ci_high double, r2 double, n_obs long, df_resid long, control_std double"
SPECIFICATIONS = ("pooled", "within", "interaction")


def design(columns: dict[str, list], treatment: np.ndarray, interact: str | None = None) -> tuple[np.ndarray, list[str]]:
    """Intercept, treatment, treatment-coded dummies of each factor (first level left out), and interactions."""
    parts, names = [np.ones(len(treatment)), treatment], ["Intercept", "is_treatment"]
    for factor, values in columns.items():
        for level in sorted(set(values), key=str)[1:]:
            dummy = np.array([v == level for v in values], dtype=float)
            parts.append(dummy)
            names.append(f"{factor}[{level}]")
            if factor == interact:
                parts.append(dummy * treatment)
                names.append(f"is_treatment:{factor}[{level}]")
    return np.column_stack(parts), names


def ols_hc3(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Least squares by pseudo-inverse, so rank-deficient designs are fine; HC3 covariance."""
    inverse = np.linalg.pinv(x)
    beta = inverse @ y
    resid = y - x @ beta
    leverage = np.einsum("ij,ji->i", x, inverse)
    weight = (resid / np.where(1 - leverage > 1e-12, 1 - leverage, np.inf)) ** 2
    total = ((y - y.mean()) ** 2).sum()
    rank = int(np.linalg.matrix_rank(x))
    return {"beta": beta, "cov": (inverse * weight) @ inverse.T, "resid": resid, "r2": float(1 - (resid**2).sum() / total) if total > 0 else 0.0, "df": len(y) - rank}


def cells_hc3(x: np.ndarray, n: np.ndarray, mean: np.ndarray, squares: np.ndarray) -> dict[str, np.ndarray | float]:
    """``ols_hc3`` of rows that are equal within cells: a cell is one row of x, ``n`` outcomes with a mean and squared deviations from it."""
    root, rows = np.sqrt(n), n.sum()
    # singular values of the whole design; those of rank-deficient ones are below this
    inverse = np.linalg.pinv(x * root[:, None], rcond=1e-12)
    beta = inverse @ (root * mean)
    each = inverse / root  # column of the pseudo-inverse that a single row of the cell has
    leverage = np.einsum("ij,ji->i", x, each)
    error = squares + n * (mean - x @ beta) ** 2
    weight = error / np.where(1 - leverage > 1e-12, 1 - leverage, np.inf) ** 2
    total = (squares + n * (mean - (n * mean).sum() / rows) ** 2).sum()
    rank = int(np.linalg.matrix_rank(x * root[:, None], tol=1e-12 * max(np.linalg.norm(x * root[:, None], 2), 1e-300)))
    return {"beta": beta, "cov": (each * weight) @ each.T, "r2": float(1 - error.sum() / total) if total > 0 else 0.0, "df": int(rows) - rank}


def _weight(long: DataFrame) -> Column:
    return (F.col("n") if "n" in long.columns else F.lit(1)).cast("long")


def cell_moments(rows: DataFrame, by: list[str], y: str) -> DataFrame:
    """(by, size, mean, squares): rows, mean and squared deviations of a column that is not null; two passes, so large means lose nothing."""
    kept = rows.select(*by, F.col(y).cast("double").alias("y"), _weight(rows).alias("n")).where("y is not null")
    means = kept.groupBy(*by).agg(F.sum("n").alias("size"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("mean"))
    c, m = kept.alias("c"), means.alias("m")
    on = functools.reduce(Column.__and__, [F.col(f"c.{b}").eqNullSafe(F.col(f"m.{b}")) for b in by])
    gap = F.col("c.y") - F.col("m.mean")
    return c.join(m, on).groupBy(*[F.col(f"m.{b}") for b in by], "size", "mean").agg(F.sum(F.col("c.n") * gap * gap).alias("squares"))


def wald_f(beta: np.ndarray, cov: np.ndarray, at: list[int], df: int) -> tuple[float, float]:
    """F statistic and p-value of the hypothesis that the named coefficients are all 0."""
    b, c = beta[at], cov[np.ix_(at, at)]
    f = float(b @ np.linalg.pinv(c) @ b / len(at))
    return f, f_sf(f, len(at), df)


def regress(pairs_long: DataFrame, outcomes: list[str], specification: str = "pooled", use_t: bool = False, factors: tuple[str, ...] = ("dataset", "arch_family")) -> DataFrame:
    """One row per (analysis_type[, dataset], outcome, term) for y ~ is_treatment + factors.

    within fits each dataset alone; interaction adds is_treatment x dataset terms as rows of their own. Joint
    F-tests of the factors come as terms ``joint:<factor>`` with the statistic in stat. Intervals are normal
    unless use_t. Rows with a null outcome are left out.
    """
    if specification not in SPECIFICATIONS:
        raise ValueError(f"unknown specification {specification!r}; known: {', '.join(SPECIFICATIONS)}")
    by = ["analysis_type", "outcome"] + (["dataset"] if specification == "within" else [])
    used = [f for f in factors if f not in by]
    stacked = F.stack(F.lit(len(outcomes)), *[x for o in outcomes for x in (F.lit(o), F.col(o).cast("double"))]).alias("outcome", "y")
    long = pairs_long.select("analysis_type", *factors, F.col("is_treatment").cast("double").alias("is_treatment"), _weight(pairs_long).alias("n"), stacked).where("y is not null")
    cells = cell_moments(long, [*by, "is_treatment", *used], "y")
    extra = ", dataset string" if specification == "within" else ""

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("is_treatment", *used)])
        n, mean, squares, t = (np.array(table.column(c).to_pylist(), dtype=float) for c in ("size", "mean", "squares", "is_treatment"))
        columns = {f: table.column(f).to_pylist() for f in used}
        x, names = design(columns, t, "dataset" if specification == "interaction" else None)
        found = cells_hc3(x, n, mean, squares)
        own, c = n[t == 0], mean[t == 0]
        middle = (own * c).sum() / max(1.0, own.sum())
        spread = float(np.sqrt((squares[t == 0] + own * (c - middle) ** 2).sum() / (own.sum() - 1))) if own.sum() > 1 else None
        quantile = normal_quantile(0.975)
        rows = []
        for k, name in enumerate(names):
            if name != "is_treatment" and not name.startswith("is_treatment:"):
                continue
            beta, se = float(found["beta"][k]), float(np.sqrt(max(found["cov"][k, k], 0)))
            stat = beta / se if se > 0 else 0.0
            p = (t_sf2(stat, found["df"]) if use_t else normal_sf2(stat)) if se > 0 else 1.0
            rows.append((name, beta, se, stat, p, beta - quantile * se, beta + quantile * se))
        for factor in used:
            at = [k for k, name in enumerate(names) if name.startswith(f"{factor}[")]
            if at and found["df"] > 0:
                stat, p = wald_f(found["beta"], found["cov"], at, found["df"])
                rows.append((f"joint:{factor}", None, None, stat, p, None, None))
        fixed = {"analysis_type": key[0].as_py(), "outcome": key[1].as_py(), "r2": found["r2"], "n_obs": int(n.sum()), "df_resid": int(found["df"]), "control_std": spread}
        if len(key) > 2:
            fixed["dataset"] = key[2].as_py()
        records = [dict(zip(("term", "beta", "se", "stat", "p", "ci_low", "ci_high"), r)) | fixed for r in rows]
        return pa.Table.from_pylist(records, schema=_arrow_schema(specification == "within"))

    return cells.groupBy(*by).applyInArrow(fit, RESULT + extra)  # a row per cell


def _arrow_schema(within: bool) -> pa.Schema:
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    fields = [pa.field(n, kinds[t]) for n, t in (c.strip().split(" ") for c in RESULT.split(","))]
    return pa.schema(fields + ([pa.field("dataset", pa.string())] if within else []))


def simple_slope(pairs_long: DataFrame, outcome: str) -> DataFrame:
    """Slope on treatment without covariates, as a relational aggregate."""
    t = F.col("is_treatment").cast("double")
    arms = cell_moments(pairs_long, ["analysis_type", "is_treatment"], outcome)
    whole = arms.groupBy("analysis_type").agg(F.sum("size").alias("n_obs"), (F.sum(F.col("size") * t) / F.sum("size")).alias("mt"))
    gap = (t - F.col("mt")) * F.col("size")
    sums = arms.join(whole, "analysis_type").groupBy("analysis_type", "n_obs").agg(F.sum(gap * F.col("mean")).alias("xy"), F.sum(gap * (t - F.col("mt"))).alias("xx"))
    return sums.select("analysis_type", F.when(F.col("xx") > 0, F.col("xy") / F.col("xx")).alias("beta"), "n_obs")


def _deviation(squares: Column, size: Column) -> Column:
    """Sample deviation, null for a single row."""
    return F.when(size > 1, F.sqrt(squares / (size - 1)))


def control_std(pairs_long: DataFrame, outcome: str) -> DataFrame:
    """Sample deviation of an outcome among controls."""
    own = pairs_long.where("is_treatment = 0")
    found = cell_moments(own, ["analysis_type"], outcome).select("analysis_type", _deviation(F.col("squares"), F.col("size")).alias("control_std"))
    return own.select("analysis_type").distinct().join(found, "analysis_type", "left")


def factor_means(long: DataFrame, outcome: str, factor: str) -> DataFrame:
    """(factor, my, mt): means of outcome and treatment per level."""
    n = _weight(long)
    seen = F.sum(F.when(F.col(outcome).isNotNull(), n))
    return long.groupBy(factor).agg((F.sum(F.col(outcome) * n) / seen).alias("my"), (F.sum(F.col("is_treatment") * n) / F.sum(n)).alias("mt"))


def partial_residuals(long: DataFrame, outcome: str, factor: str, weighted: DataFrame | None = None) -> DataFrame:
    """Outcome and treatment with a factor's group means taken out; their slope is the adjusted effect.

    The levels of a factor are few, so their means travel to the rows; ``weighted`` is the same table in its weighted form.
    """
    means = F.broadcast(factor_means(long if weighted is None else weighted, outcome, factor))
    return long.join(means, factor).select(factor, (F.col(outcome) - F.col("my")).alias("y_resid"), (F.col("is_treatment") - F.col("mt")).alias("t_resid"))


def residual_spread(residuals: DataFrame, factor: str, top: int = 20) -> DataFrame:
    """(factor, spread, outlier): sample deviation of residuals per level, the largest first.

    A level is an outlier above the median of the spreads plus 1.5 of their deviations.
    """
    per = cell_moments(residuals, [factor], "y_resid").select(factor, _deviation(F.col("squares"), F.col("size")).alias("spread")).where("spread is not null").withColumn("u", F.lit(1))
    limit = per.groupBy("u").agg((F.median("spread") + 1.5 * F.stddev_samp("spread")).alias("limit"))
    return per.join(limit, "u").select(factor, "spread", (F.col("spread") > F.col("limit")).alias("outlier")).orderBy(F.desc("spread"), factor).limit(top)


def stars(p: Column) -> Column:
    """Significance marks at 1, 5 and 10 per cent."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def forest_table(results: DataFrame) -> DataFrame:
    """Main effects and intervals in units of the control group's deviation (0 counts as 1), with stars."""
    unit = F.when(F.col("control_std") == 0, F.lit(1.0)).otherwise(F.col("control_std"))
    main = results.where("term = 'is_treatment'")
    return main.select("analysis_type", "outcome", (F.col("beta") / unit).alias("beta"), (F.col("ci_low") / unit).alias("ci_low"), (F.col("ci_high") / unit).alias("ci_high"), stars(F.col("p")).alias("stars"))


def group_means(long: DataFrame, outcome: str, factor: str) -> DataFrame:
    """Mean, count and 95 % half-width of an outcome per factor level and treatment arm."""
    by = [factor, "is_treatment"]
    half = 1.96 * _deviation(F.col("squares"), F.col("size")) / F.sqrt("size")
    g, f = long.select(*by).distinct().alias("g"), cell_moments(long, by, outcome).alias("f")
    on = F.col(f"g.{factor}").eqNullSafe(F.col(f"f.{factor}")) & F.col("g.is_treatment").eqNullSafe(F.col("f.is_treatment"))
    return g.join(f, on, "left").select(F.col(f"g.{factor}"), F.col("g.is_treatment"), "mean", F.coalesce("size", F.lit(0)).alias("n"), half.alias("half_width"))


def latex_table(results: DataFrame) -> str:
    """Coefficients with stars, one line per analysis and outcome, each followed by its joint F-tests, as LaTeX rows."""
    shown = results.where("term = 'is_treatment' or term like 'joint:%'").withColumn("mark", stars(F.col("p")))
    lines = []
    for r in shown.orderBy("analysis_type", "outcome", F.col("term") != "is_treatment", "term").collect():
        if r["term"] == "is_treatment":
            lines.append(f"{r['analysis_type']} & {r['outcome']} & {r['beta']:.4f}{r['mark']} & ({r['se']:.4f}) & {r['n_obs']} \\\\")
        else:
            lines.append(f" & $F$, {r['term'].removeprefix('joint:').replace('_', ' ')} & {r['stat']:.4f}{r['mark']} & [{r['p']:.4f}] & {r['n_obs']} \\\\")
    return "\n".join(["\\begin{tabular}{llrrr}", "analysis & outcome & $\\beta$ & se & $n$ \\\\ \\hline", *lines, "\\end{tabular}"])
