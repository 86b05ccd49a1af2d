"""Fractional logit: coefficients by reweighted least squares on aggregated designs, clustered errors, contrasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import stats

#: Designs of the four models: columns beside the intercept.
DESIGNS = {"A": ["su"], "B": ["su", "logloc"], "interval_A": ["su", "interval"], "interval_B": ["su", "interval", "logloc"]}


def design_columns(model: str, intervals: int) -> list[str]:
    """Names of a model's columns. Interval models have an intercept and a slope for each interval after the first."""
    names = ["one", "su"]
    if model.startswith("interval"):
        names += [f"i{k}" for k in range(1, intervals)] + [f"su_i{k}" for k in range(1, intervals)]
    return names + (["logloc"] if model.endswith("B") else [])


def design(df: DataFrame, names: list[str], su_center: float = 0.0, loc_center: float = 0.0) -> DataFrame:
    """df with the design as an array column x; su and logloc about their centres."""
    su, loc = F.col("su") - su_center, F.col("logloc") - loc_center
    at = lambda n: F.col("interval") == int(n.rpartition("i")[2])
    columns = []
    for n in names:
        if n == "one":
            c = F.lit(1.0)
        elif n == "su":
            c = su
        elif n == "logloc":
            c = loc
        else:
            c = F.when(at(n), su if n.startswith("su_") else F.lit(1.0)).otherwise(0.0)
        columns.append(c.cast("double"))
    return df.withColumn("x", F.array(*columns))


def distinct_design(df: DataFrame) -> DataFrame:
    """(x, n, s): rows of one design counted, with the sum of their outcomes: all that the likelihood needs of them."""
    return df.groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("s"))


def sums(design: DataFrame, beta: np.ndarray) -> dict:
    """Gradient and information of a logit at beta over distinct designs, as aggregates: X'WX, X'(y - mu)."""
    p = len(beta)
    z = sum((F.col("x")[k] * float(b) for k, b in enumerate(beta)), F.lit(0.0))
    d = design.select("n", "s", "x", (1 / (1 + F.exp(-z))).alias("mu"))
    w, r = F.col("n") * F.col("mu") * (1 - F.col("mu")), F.col("s") - F.col("n") * F.col("mu")
    cells = [F.sum(w * F.col("x")[i] * F.col("x")[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
    row = d.agg(*cells, *(F.sum(r * F.col("x")[i]).alias(f"g{i}") for i in range(p)), F.sum("n").alias("n")).first()
    h = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
    return {"h": h, "g": np.array([row[f"g{i}"] for i in range(p)]), "n": row["n"]}


def fit(df: DataFrame, names: list[str], tol: float = 1e-10, most: int = 200) -> tuple[np.ndarray, dict]:
    """Coefficients of the fractional logit of y (in [0, 1]) on x.

    Rows are summed by distinct design once; that table is cached, and each round is one aggregation of it. A singular
    design or a fit that does not settle is an error.
    """
    distinct = distinct_design(df).cache()
    try:
        return _fit(distinct, len(names), tol, most)
    finally:
        distinct.unpersist()


def _fit(distinct: DataFrame, p: int, tol: float, most: int) -> tuple[np.ndarray, dict]:
    beta = np.zeros(p)
    for _ in range(most):
        s = sums(distinct, beta)
        if np.linalg.matrix_rank(s["h"], tol=1e-9 * max(1e-12, np.abs(s["h"]).max())) < p:
            raise ValueError("the design is singular or the outcome separated")
        move = np.linalg.solve(s["h"], s["g"])
        beta = beta + move
        if np.abs(move).max() <= tol * (1 + np.abs(beta).max()):
            return beta, sums(distinct, beta)
    raise ValueError("no convergence")


def sandwich(df: DataFrame, beta: np.ndarray, at: dict, cluster: str = "cluster_id") -> tuple[np.ndarray, int]:
    """CR1 covariance and the number of clusters: G/(G-1) (N-1)/(N-p) times bread, summed score products, bread."""
    p = len(beta)
    z = sum((F.col("x")[k] * float(b) for k, b in enumerate(beta)), F.lit(0.0))
    r = F.col("y") - 1 / (1 + F.exp(-z))
    score = df.groupBy(cluster).agg(*(F.sum(r * F.col("x")[i]).alias(f"s{i}") for i in range(p)))
    row = score.agg(F.count("*").alias("g"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p))).first()
    m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    bread = np.linalg.inv(at["h"])
    g, n = row["g"], at["n"]
    return g / (g - 1) * (n - 1) / (n - p) * bread @ m @ bread, g


def contrast(beta: np.ndarray, cov: np.ndarray, c: np.ndarray, dof: int, level: float = 0.95) -> dict:
    """Estimate, error, t interval and p of c'beta."""
    value, se = float(c @ beta), math.sqrt(float(c @ cov @ c))
    q = stats.t_quantile(0.5 + level / 2, dof)
    t = value / se if se else math.nan
    return {"estimate": value, "se": se, "low": value - q * se, "high": value + q * se, "p": 2 * stats.t_sf(abs(t), dof) if se else math.nan}


def marginal_mean(df: DataFrame, beta: np.ndarray, cov: np.ndarray, dof: int, level: float = 0.95) -> dict:
    """Mean prediction over df's design, its delta-method error, and an interval on the logit scale."""
    p = len(beta)
    z = sum((F.col("x")[k] * float(b) for k, b in enumerate(beta)), F.lit(0.0))
    d = df.select("x", (1 / (1 + F.exp(-z))).alias("mu"))
    row = d.agg(F.avg("mu").alias("m"), *(F.avg(F.col("mu") * (1 - F.col("mu")) * F.col("x")[i]).alias(f"g{i}") for i in range(p))).first()
    g, m = np.array([row[f"g{i}"] for i in range(p)]), row["m"]
    se = math.sqrt(float(g @ cov @ g))
    logit, q = math.log(m / (1 - m)), stats.t_quantile(0.5 + level / 2, dof) * se / (m * (1 - m))
    back = lambda v: 1 / (1 + math.exp(-v))
    return {"mean": m, "se": se, "low": back(logit - q), "high": back(logit + q)}


def wald(beta: np.ndarray, cov: np.ndarray, rows: np.ndarray, dof: int) -> dict:
    """Joint F test that rows @ beta is zero."""
    v = rows @ beta
    f = float(v @ np.linalg.solve(rows @ cov @ rows.T, v)) / len(rows)
    return {"f": f, "p": stats.f_sf(f, len(rows), dof)}


def holm(df: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """p_holm: Holm's adjustment within the family; a missing p takes its place as 1 and stays missing."""
    full = F.coalesce(F.when(~F.isnan(p), F.col(p)), F.lit(1.0))
    part = Window.partitionBy(*family)
    d = df.withColumn("__p", full).withColumns({"__m": F.count("*").over(part), "__r": F.row_number().over(part.orderBy("__p"))})
    running = F.max((F.col("__m") - F.col("__r") + 1) * F.col("__p")).over(part.orderBy("__p", "__r").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("p_holm", F.when(F.col(p).isNotNull() & ~F.isnan(p), F.least(F.lit(1.0), running)))
    return d.drop("__p", "__m", "__r")


def sparse_reasons(df: DataFrame, keys: list[str], rows: int = 30, clusters: int = 10, errors: int = 5, distinct: int = 5, score: str = "y", cluster: str = "cluster_id") -> DataFrame:
    """(keys, reasons): why a group is too sparse for a fit, as an array; empty where it is not."""
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct(cluster).alias("g"), F.count_if(F.col(score) < 1).alias("e"), F.count_if(F.col(score) > 0).alias("c"), F.count_distinct("su").alias("d")
    )
    why = [F.when(F.col("n") < rows, "few_rows"), F.when(F.col("g") < clusters, "few_clusters"), F.when(F.col("e") < errors, "few_errors"), F.when(F.col("c") < errors, "few_correct"), F.when(F.col("d") < distinct, "few_values")]
    return agg.select(*keys, F.array_compact(F.array(*why)).alias("reasons"))


def nonnegative(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """x >= 0 of least |a x - b|, by active sets: columns that lower the residual enter, those driven below zero leave."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = tol * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(30 * a.shape[1] + 30):
        gain = np.where(used, -np.inf, a.T @ (b - a @ x))
        k = int(gain.argmax()) if len(gain) else -1
        if k < 0 or gain[k] <= scale:
            return x
        used[k] = True
        while True:
            z = np.zeros_like(x)
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (z <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            used &= x > 1e-12
            x[~used] = 0
            if not used.any():
                break
        if used.any():
            x = z
    raise ValueError("no convergence")


def separated(x: np.ndarray, y: np.ndarray, tol: float = 1e-7) -> bool:
    """Whether a direction of the design separates outcomes that are all 0 or 1 on its sides (complete or quasi).

    Fractional outcomes pin their rows to X d = 0. Rows of the others, with the sign of their outcome, are A; a
    direction separates if A d >= 0 and not all zero. By the theorem of the alternative there is one unless A' w = 0 for
    some w with all parts at least 1. The least |A' w| over such w decides: where it is zero there is none, else that
    A' w is one, so either answer has its proof.
    """
    free = (y > 0) & (y < 1)
    basis = np.eye(x.shape[1])
    if free.any():
        _, s, v = np.linalg.svd(x[free])
        basis = v[(s > 1e-9 * max(1.0, s.max(initial=0))).sum() :].T
    if not basis.shape[1]:
        return False
    a = np.where(y[~free, None] >= 1, 1.0, -1.0) * (x[~free] @ basis)
    a = a[np.abs(a).max(axis=1) > tol]
    if not len(a):
        return True
    a = np.unique(np.round(a / np.linalg.norm(a, axis=1, keepdims=True), 12), axis=0)
    d = a.sum(axis=0) + a.T @ nonnegative(a.T, -a.sum(axis=0))
    return bool(np.linalg.norm(d) > tol)


def outside(reference: pd.DataFrame, points: pd.DataFrame, columns: tuple[str, str] = ("su", "logloc")) -> float:
    """Share of points outside the hull of the reference group's values."""
    return stats.outside_fraction(reference[list(columns)].to_numpy(float), points[list(columns)].to_numpy(float))
