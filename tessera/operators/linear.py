"""Weighted least squares as aggregates: sums run on the executors, small systems are solved per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_recency(panel: DataFrame, decay: float, into: str = "w") -> DataFrame:
    """Adds exp(-age / (timestamps * decay)), age counted in timestamps of the period."""
    last = F.max("t").over(Window.partitionBy("period"))
    return panel.withColumn(into, F.exp(-(last - F.col("t")) / F.greatest(F.lit(1.0), (last + 1) * F.lit(decay))))


def robust_scales(frame: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per feature the median and 1.4826 * MAD, else the deviation, else 1. Two passes over the values."""
    keys = keys or []
    long = frame.unpivot(keys, features, "feature", "v")
    by = [*keys, "feature"]
    centres = long.groupBy(*by).agg(F.median("v").alias("centre"), F.stddev_pop("v").alias("sd"))
    spread = long.join(centres, by).groupBy(*by, "centre", "sd").agg((1.4826 * F.median(F.abs(F.col("v") - F.col("centre")))).alias("mad"))
    return spread.select(*by, "centre", F.when(F.col("mad") >= 1e-8, F.col("mad")).when(F.col("sd") >= 1e-8, F.col("sd")).otherwise(1.0).alias("scale"))


def gram(frame: DataFrame, features: list[str], y: str, w: str, keys: list[str]) -> DataFrame:
    """(keys, gram: upper triangle by rows, rhs, sw, sy): one row per group, summed map-side first."""
    upper = [F.sum(F.col(w) * F.col(a) * F.col(b)) for i, a in enumerate(features) for b in features[i:]]
    right = [F.sum(F.col(w) * F.col(a) * F.col(y)) for a in features]
    return frame.groupBy(*keys).agg(F.array(*upper).alias("gram"), F.array(*right).alias("rhs"), F.sum(w).alias("sw"), F.sum(F.col(w) * F.col(y)).alias("sy"))


def partial_grams(frame: DataFrame, columns: list[str], weights: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, weight, gram): all sums of products of ``columns``, flat by rows, for each of several weights.

    For many columns, where gram() would be thousands of expressions: tasks add up dense products of
    their rows, a row for each group and batch, and these are added up. One pass for all weights.
    """
    k = len(columns)
    names = [f"__w{i}" for i in range(len(weights))]
    rows = frame.select(*keys, *columns, *(w.cast("double").alias(n) for n, w in zip(names, weights.values())))
    labels = list(weights)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "weight string, part binary"])

    def add(batches):
        for batch in batches:
            out = []
            for key, group in batch.groupby(keys, sort=False, dropna=False):
                x = group[columns].to_numpy(float)
                for label, name in zip(labels, names):
                    out.append((*key, label, ((x * group[name].to_numpy(float)[:, None]).T @ x).tobytes()))
            yield pd.DataFrame(out, columns=[*keys, "weight", "part"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        out = group.iloc[:1][[*keys, "weight"]].copy()
        out["gram"] = [sum(np.frombuffer(p) for p in group["part"]).tolist()]
        return out

    parts = rows.mapInPandas(add, ddl)
    return parts.groupBy(*keys, "weight").applyInPandas(total, ddl.replace("part binary", "gram array<double>"))


def ridge_path(gram: np.ndarray, right: np.ndarray, alphas: list[float]) -> np.ndarray:
    """The ridge coefficients for each of ``alphas``, a row each, from one eigendecomposition."""
    values, vectors = np.linalg.eigh(gram)
    turned = vectors.T @ right
    return (vectors @ (turned[:, None] / (values[:, None] + np.asarray(alphas, float)[None, :]))).T


def solve(sums: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(keys, coefficients) of the ridge regressions of gram()."""
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}

    def run(frames):
        for frame in frames:
            out = frame[keys].copy()
            out["coefficients"] = [_solve(np.asarray(g, float), np.asarray(r, float), alpha) for g, r in zip(frame["gram"], frame["rhs"])]
            yield out

    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return sums.select(*keys, "gram", "rhs").mapInPandas(run, f"{ddl}, coefficients array<double>")


def _solve(upper: np.ndarray, right: np.ndarray, alpha: float) -> list[float]:
    n = len(right)
    full = np.zeros((n, n))
    full[np.triu_indices(n)] = upper
    full = full + np.triu(full, 1).T + alpha * np.eye(n)
    try:
        return np.linalg.solve(full, right).tolist()
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(full) @ right).tolist()


def least_squares(matrix: np.ndarray, y: np.ndarray, weights: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge coefficients of rows that are in memory, from the same sums as gram() and the same solution."""
    weighted = weights[:, None] * matrix
    sums = matrix.T @ weighted
    return np.array(_solve(sums[np.triu_indices(len(sums))], y @ weighted, alpha))
