"""Robust scaling of many features as aggregates over the long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(frame: DataFrame, features: list[str], keys: list[str], *, quantile: float = 0.01, centre: str = "median", scale: str = "mad") -> DataFrame:
    """Rows (keys, feature, impute, low, high, centre, scale).

    Median for missing values, clipping at two quantiles, then centre and spread of what
    was filled and clipped: three passes, each an exact aggregate per feature.
    """
    by = [*keys, "feature"]
    long = frame.unpivot(keys, features, "feature", "v")
    medians = long.groupBy(*by).agg(F.coalesce(F.median("v"), F.lit(0.0)).alias("impute"))
    filled = long.join(medians, by).withColumn("v", F.coalesce("v", "impute"))
    cuts = filled.groupBy(*by, "impute").agg(F.percentile("v", quantile).alias("low"), F.percentile("v", 1 - quantile).alias("high"))
    fine = F.col("low") < F.col("high")
    cuts = cuts.select(*by, "impute", F.when(fine, F.col("low")).otherwise(-10.0).alias("low"), F.when(fine, F.col("high")).otherwise(10.0).alias("high"))
    clipped = long.join(cuts, by).withColumn("v", F.least(F.greatest(F.coalesce("v", "impute"), "low"), "high"))
    middle = F.median("v") if centre == "median" else F.avg("v")
    centres = clipped.groupBy(*by, "impute", "low", "high").agg(middle.alias("centre"), F.stddev_pop("v").alias("std"))
    if scale == "mad":
        spreads = clipped.join(centres.select(*by, "centre"), by).groupBy(*by).agg((1.4826 * F.median(F.abs(F.col("v") - F.col("centre")))).alias("scale"))
        centres = centres.join(spreads, by)
    else:
        centres = centres.withColumn("scale", F.col("std"))
    spread = F.when(F.col("scale") >= 1e-8, F.col("scale")).when(F.col("std") >= 1e-8, F.col("std")).otherwise(1.0)
    return centres.select(*by, "impute", "low", "high", "centre", spread.alias("scale"))


def apply(frame: DataFrame, fitted: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """``frame`` with its features filled, clipped and scaled by the row of their keys."""
    wide = fitted.groupBy(*keys).pivot("feature", features).agg(F.first(F.struct("impute", "low", "high", "centre", "scale")))
    wide = wide.select(*keys, *(F.col(f).alias(f"__s_{f}") for f in features))
    joined = frame.join(wide, keys)

    def scaled(f: str) -> Column:
        s = F.col(f"__s_{f}")
        return (F.least(F.greatest(F.coalesce(F.col(f), s.impute), s.low), s.high) - s.centre) / s.scale

    return joined.select(*(scaled(c).alias(c) if c in features else F.col(c) for c in frame.columns))
