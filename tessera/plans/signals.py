"""Signals and blends that aren't fitted: regimes, agreement gates, adaptive shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import windows as W
from tessera.plans import engine, finish, walkforward
from tessera.plans.features import inputs


def regime_signal(panel: DataFrame) -> DataFrame:
    """Momentum where dispersion runs above its own recent mean, reversion where it runs below."""
    names = inputs(panel)[:3]
    k = len(names)
    frame = panel.select(
        "*",
        *((W.roll_mean(f, 5, 2) - W.roll_mean(f, 20, 3)).alias(f"__m_{f}") for f in names),
        *((W.roll_mean(f, 20, 3) - F.col(f)).alias(f"__v_{f}") for f in names),
    )
    frame = frame.select(
        *panel.columns,
        (sum(X.centred_rank(f"__m_{f}") for f in names) / k).alias("momentum"),
        (sum(X.centred_rank(f"__v_{f}") for f in names) / k).alias("reversion"),
    )
    spread = panel.groupBy("period", "t").agg((sum(F.stddev_pop(f) for f in names) / k).alias("d"))
    w = Window.partitionBy("period").orderBy("t").rowsBetween(-19, 0)
    base = F.when(F.count("d").over(w) >= 3, F.avg("d").over(w))
    ratio = F.col("d") / (F.abs(base) + W.EPS)
    spread = spread.select("period", "t", F.coalesce(X.clip((ratio - 0.85) / 0.50, 0, 1), F.lit(0.5)).alias("gate"))
    signal = F.col("momentum") * F.col("gate") + F.col("reversion") * (1 - F.col("gate"))
    return frame.join(spread, ["period", "t"]).withColumn("signal", F.coalesce(signal, F.lit(0.0)))


def agreement_gate(frame: DataFrame, a: str, b: str, floor: float = 0.75) -> DataFrame:
    """Adds gate: ``floor`` to 1 as two predictions agree within a timestamp."""
    return frame.withColumn("gate", floor + (1 - floor) * X.clip(X.window_correlation(a, b), 0, 1))


def gated(frame: DataFrame, weights: list[float]) -> DataFrame:
    """Blends (ridge, stable ridge, rank, trees) heads; the last two count less where ranks disagree with the ridges."""
    ridge, stable, rank, trees = (w * F.col("heads")[i] for i, w in enumerate(weights))
    frame = agreement_gate(frame.select("*", (ridge + stable).alias("__linear"), rank.alias("__rank")), "__linear", "__rank")
    mixed = F.col("__linear") + F.col("gate") * (F.col("__rank") + trees)
    return finish.clip_finish(frame.withColumn("raw", mixed), "raw", "pred").drop("__linear", "__rank", "gate")


def adaptive_share(frame: DataFrame, how: str = "mad_clip") -> DataFrame:
    """Blends (ridge, tree, rank ridge, rank tree) heads by how far they agree per timestamp, around the period's own share of ranks."""
    ridge, tree, rank_ridge, rank_tree = (F.col("heads")[i] for i in range(4))
    frame = frame.select("*", ridge.alias("__a"), tree.alias("__b"), rank_ridge.alias("__c"), rank_tree.alias("__d"))
    trust = lambda a, b: X.clip(0.5 * (1 + X.window_correlation(a, b)), 0.15, 1.0)
    frame = frame.withColumn("__raw", F.col("__a") + 0.28 * trust("__a", "__b") * (F.col("__b") - F.col("__a")))
    frame = frame.withColumn("__rank", F.col("__c") + 0.72 * trust("__c", "__d") * (F.col("__d") - F.col("__c")))
    frame = frame.withColumn("__agree", X.clip(0.5 * (1 + X.window_correlation("__raw", "__rank")), 0.0, 1.0))
    own = F.coalesce(F.nanvl("share", F.lit(engine.SHARE)), F.lit(engine.SHARE))
    share = X.clip(own + 0.08 * (F.col("__agree") - 0.5), 0.18, 0.42)
    mixed = (1 - share) * F.col("__raw") + share * F.col("__rank")
    value = F.when(F.col("__agree") < 0.30, 0.82 * F.col("__a") + 0.18 * mixed).otherwise(mixed)
    frame = finish.FINISHES[how](frame.withColumn("__value", value), "__value", "pred")
    return frame.drop("__a", "__b", "__c", "__d", "__raw", "__rank", "__agree", "__value")


def with_regime(panel: DataFrame, model: engine.Model, weight: float = 0.15) -> DataFrame:
    """Walk-forward predictions of ``model`` plus the regime signal, which isn't fitted: de-meaned, over its own deviation
    at the timestamp, and scaled by the deviation of the period's training targets."""
    parts = walkforward.split(panel)
    out = engine.predict(model, parts)
    signal = regime_signal(parts).where("not train").select("period", "t", "asset", "signal")
    out = out.join(signal, ["period", "t", "asset"]).withColumn("signal", X.demean("signal"))
    std = F.nullif(X.dispersion("signal"), F.lit(0.0))
    out = out.withColumn("regime", F.coalesce(F.col("signal") / std, F.lit(0.0)) * F.col("spread"))
    mixed = X.demean(F.coalesce("raw", F.lit(0.0))) + weight * F.col("regime")
    return walkforward.shape_safe(finish.finish(out.withColumn("raw", mixed).drop("signal", "regime"), model.finish))
