"""Robust regressions by reweighting: each step is one aggregation and one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import linear


def predict(frame: DataFrame, coefficients: DataFrame, features: list[str], keys: list[str], into: str = "fitted") -> DataFrame:
    """Adds the coefficients' projection."""
    fitted = sum((F.col("coefficients")[i] * F.col(f) for i, f in enumerate(features)), F.lit(0.0))
    return frame.join(coefficients, keys, "left").withColumn(into, fitted).drop("coefficients")


def ridge(frame: DataFrame, features: list[str], y: str, w: str, keys: list[str], alpha: float) -> DataFrame:
    """(keys, coefficients) of weighted ridge regressions without intercept."""
    return linear.solve(linear.gram(frame, features, y, w, keys), keys, alpha)


def intercept(frame: DataFrame, y: str, w: str, keys: list[str]) -> DataFrame:
    """(keys, start): weighted means of the target, fitted outside of the regression."""
    return frame.groupBy(*keys).agg((F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("start"))


def huber(frame: DataFrame, features: list[str], y: str, w: str, keys: list[str], alpha: float, delta: float = 1.0, steps: int = 2) -> DataFrame:
    """Iteratively reweighted: residuals over ``delta`` robust deviations count in proportion to their inverse."""
    coefficients = ridge(frame, features, y, w, keys, alpha)
    for _ in range(steps):
        fitted = predict(frame, coefficients, features, keys).withColumn("__r", F.col(y) - F.col("fitted"))
        spread = fitted.groupBy(*keys).agg(F.greatest(1.4826 * F.median(F.abs(F.col("__r"))), F.lit(1e-8)).alias("__s"))
        scaled: Column = F.abs(F.col("__r")) / F.col("__s")
        again = fitted.join(spread, keys).withColumn("__w", F.col(w) * F.least(F.lit(1.0), delta / F.greatest(scaled, F.lit(1e-12))))
        coefficients = ridge(again, features, y, "__w", keys, alpha)
    return coefficients
