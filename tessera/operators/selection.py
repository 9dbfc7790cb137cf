"""Feature selection from one pass of aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross as X


def coverage(frame: DataFrame, features: list[str], share: float = 0.05, std: float = 1e-8) -> DataFrame:
    """(feature, share, std, usable)."""
    row = frame.agg(*(F.struct((F.count(f) / F.count(F.lit(1))).alias("share"), F.stddev_pop(f).alias("std")).alias(f) for f in features))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f)["share"].alias("share"), F.col(f)["std"].alias("std")) for f in features))).alias("s")).select("s.*")
    return long.withColumn("usable", (F.col("share") >= share) & (F.coalesce("std", F.lit(0.0)) >= std))


def correlations(frame: DataFrame, y: str, features: list[str]) -> DataFrame:
    """(feature, corr) with ``y`` over pairs without nulls; 0 where one doesn't vary."""
    sums = frame.agg(*(c for f in features for c in X.correlation_sums(f, y, f"_{f}")))
    made = [F.struct(F.lit(f).alias("feature"), X.correlation(f"_{f}").alias("corr")) for f in features]
    return sums.select(F.explode(F.array(*made)).alias("s")).select("s.*")


def by_correlation(frame: DataFrame, y: str, features: list[str], least: float, most: int, backfill: int = 20) -> list[str]:
    """Features by |correlation|: those above ``least``, at least ``backfill``, at most ``most``."""
    rows = sorted(correlations(frame, y, features).collect(), key=lambda r: (-abs(r["corr"]), r["feature"]))
    kept = [r["feature"] for r in rows if abs(r["corr"]) >= least]
    return (kept if len(kept) >= backfill else [r["feature"] for r in rows[:backfill]])[:most]


def stability(frame: DataFrame, y: str, features: list[str]) -> DataFrame:
    """(feature, score): mean correlation per timestamp, rewarded for one sign and little spread."""
    long = frame.unpivot(["period", "t", "asset", y], features, "feature", "v")
    rows = long.groupBy("period", "t", "feature").agg(*X.correlation_sums("v", y)).select("feature", X.correlation().alias("c"))
    mean, std = F.avg("c"), F.coalesce(F.stddev_pop("c"), F.lit(0.0))
    same = F.avg((F.signum("c") == 1).cast("double"))
    return rows.groupBy("feature").agg((F.abs(mean) * (0.5 + 0.5 * F.greatest(same, 1 - same)) / (0.05 + std)).alias("score"))
