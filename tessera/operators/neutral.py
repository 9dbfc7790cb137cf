"""Taking known signals out of another, timestamp by timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.operators import linear

KEYS = ["period", "t"]


def neutralise(frame: DataFrame, value: str, proxies: list[str], into: str, ridge: float = 0.35) -> DataFrame:
    """``value`` minus its ridge regression on ``proxies``, all centred, per timestamp.

    The normal equations are sums per timestamp, solved row by row, and joined back. A
    proxy that doesn't vary is a column of zeros, whose coefficient is zero.
    """
    missing = F.coalesce(F.col(value), F.lit(0.0))
    wide = frame.select("*", (missing - F.avg(missing).over(X.by_time())).alias("__y"), *((F.coalesce(F.col(p), F.lit(0.0)) - F.avg(F.coalesce(F.col(p), F.lit(0.0))).over(X.by_time())).alias(f"__p{i}") for i, p in enumerate(proxies)), F.lit(1.0).alias("__w"))
    names = [f"__p{i}" for i in range(len(proxies))]
    solved = linear.solve(linear.gram(wide, names, "__y", "__w", KEYS), KEYS, ridge)
    fitted = sum((F.col("coefficients")[i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    return wide.join(solved, KEYS, "left").withColumn(into, F.col("__y") - F.coalesce(fitted, F.lit(0.0))).drop("__y", "__w", "coefficients", *names)


def orthogonalise(frame: DataFrame, value: str, base: str, into: str) -> DataFrame:
    """``value`` without its part along ``base``: window sums only."""
    w = X.by_time()
    frame = frame.withColumn("__a", F.coalesce(X.demean(value), F.lit(0.0))).withColumn("__b", F.coalesce(F.col(base), F.lit(0.0)))
    square = F.sum(F.col("__b") * F.col("__b")).over(w)
    share = F.when(square > 1e-10, F.sum(F.col("__a") * F.col("__b")).over(w) / F.nullif(square, F.lit(0.0))).otherwise(0.0)
    frame = frame.withColumn("__a", F.col("__a") - share * F.col("__b"))
    return frame.withColumn(into, X.demean("__a")).drop("__a", "__b")
