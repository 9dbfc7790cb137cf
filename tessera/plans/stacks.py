"""Models that are put together from several fits: residual stacks and neutral targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import windows as W
from tessera.operators import linear, neutral, preprocess, robust
from tessera.plans import engine, finish, walkforward
from tessera.plans.lineage import cut
from tessera.plans import features as sets
from tessera.plans.models import MODELS

KEYS = ["period", "t", "asset"]

# -- residual stack -----------------------------------------------------------------


def interactions(columns: list[str]) -> dict[str, Column]:
    """22 interactions of compact features; a missing value counts as 0, and so does a feature that isn't among ``columns``."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0)) if n in columns else F.lit(0.0)
    r = {i: c(f"f{i}_rank") for i in (1, 2, 3)}
    made = {f"r{i}": r[i] for i in r}
    for i, j in ((1, 2), (1, 3), (2, 3)):
        made |= {f"r{i}{j}": r[i] - r[j], f"p{i}{j}": r[i] * r[j]}
    for i in r:
        made |= {f"q{i}": r[i] * F.abs(r[i]), f"r{i}d{i}": r[i] * c(f"f{i}_diff1"), f"r{i}l{i}": r[i] * c(f"f{i}_lag1")}
    return made | {"curve": (r[1] - r[2]) * (r[1] - r[3]), "z1": c("f1_roll_z"), "r1z1": r[1] * c("f1_roll_z"), "momentum": c("f1_mom_spread")}


def chronological(parts: DataFrame, cuts: tuple[float, float] = (0.62, 0.82)) -> DataFrame:
    """Adds block: 0 to fit the base, 1 the residual, 2 to calibrate, 3 to predict."""
    last = F.max(F.when(F.col("train"), F.col("t") + 1)).over(Window.partitionBy("period"))
    parts = parts.withColumn("__n", last)
    base = F.greatest(F.lit(18), F.floor(F.col("__n") * cuts[0]))
    residual = F.least(F.greatest(base + 8, F.floor(F.col("__n") * cuts[1])), F.col("__n") - 8)
    block = F.when(~F.col("train"), 3).when(F.col("t") < base, 0).when(F.col("t") < residual, 1).otherwise(2)
    return parts.withColumn("block", block).drop("__n")


def recency(frame: DataFrame, decay: float) -> DataFrame:
    """Weights within what is given, oldest first."""
    w = Window.partitionBy("period")
    low, high = F.min("t").over(w), F.max("t").over(w)
    return frame.withColumn("w", F.exp(-(high - F.col("t")) / F.greatest(F.lit(1.0), (high - low + 1) * F.lit(decay))))


def residual_stack(panel: DataFrame, model: engine.Model | None = None, *, alpha: float = 24.0, most: float = 0.30) -> DataFrame:
    """Walk-forward predictions of a base model plus an orthogonal correction for what it misses.

    A base fitted on the early part of the training rows is applied to the rest; a ridge
    regression on interactions learns its errors, and calibration rows set the
    correction's weight, which is 0 unless it helps there.
    """
    model = model or MODELS["v33"]
    parts = cut(chronological(walkforward.split(panel)))
    blocks = parts.select(*KEYS, "block")
    early = engine.predict(model, parts.where("block < 3").withColumn("train", F.col("block") == 0).drop("block"))
    compact = sets.compact(parts.drop("y", "train", "block"))
    made = interactions(compact.columns)
    names = list(made)
    extra = compact.select(*KEYS, *(c.alias(n) for n, c in made.items()))
    extra = cut(extra.select(*KEYS, *((F.col(n) - F.avg(n).over(X.by_time())).alias(n) for n in names)))

    known = cut(early.select(*KEYS, "y", F.col("raw").alias("base")).where("y is not null").join(blocks, KEYS).withColumn("miss", F.col("y") - F.col("base")).join(extra, KEYS))
    scales = cut(preprocess.fit(known.where("block = 1"), names, ["period"]))
    learn = recency(preprocess.apply(known.where("block = 1"), scales, names, ["period"]), model.decay)
    start = robust.intercept(learn, "miss", "w", ["period"])
    learn = learn.join(start, "period").withColumn("target", F.col("miss") - F.col("start"))
    learned = cut(linear.solve(linear.gram(learn, names, "target", "w", ["period"]), ["period"], alpha).join(start, "period"))

    def addition(frame: DataFrame) -> DataFrame:
        scaled = preprocess.apply(frame, scales, names, ["period"]).join(learned, "period", "left")
        fitted = sum((F.col("coefficients")[i] * F.col(n) for i, n in enumerate(names)), F.col("start"))
        scaled = scaled.withColumn("add", F.coalesce(fitted, F.lit(0.0))).drop("coefficients", "start", *names)
        return neutral.orthogonalise(scaled, "add", "base", "add")

    held = recency(addition(known.where("block = 2")), model.decay)
    rows = held.groupBy("period", "t").agg(*X.correlation_sums("add", "miss"), F.sum(F.col("w") * F.col("add") * F.col("add")).alias("xx"), F.sum(F.col("w") * F.col("add") * F.col("miss")).alias("xy"), F.sum(F.col("w") * F.col("miss") * F.col("miss")).alias("yy"))
    rows = rows.select("period", "xx", "xy", "yy", X.correlation().alias("c"))
    sums = rows.groupBy("period").agg(F.sum("xx").alias("xx"), F.sum("xy").alias("xy"), F.sum("yy").alias("yy"), F.avg("c").alias("ic"), F.avg((F.col("c") > 0).cast("double")).alias("positive"))
    gamma = X.clip(F.when(F.col("xx") > 1e-10, F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))).otherwise(0.0), 0.0, most)
    sums = sums.withColumn("gamma", gamma)
    better = (2 * F.col("gamma") * F.col("xy") - F.col("gamma") * F.col("gamma") * F.col("xx")) / F.greatest(F.col("yy"), F.lit(1e-10))
    helps = (F.col("gamma") >= 0.02) & (F.col("ic") >= 0.005) & (F.col("positive") >= 0.5) & (better >= 0.001)
    weights = cut(sums.select("period", F.when(helps, F.col("gamma")).otherwise(0.0).alias("gamma")))

    full = engine.predict(model, parts.drop("block"))
    out = addition(full.withColumn("base", F.col("raw")).join(extra, KEYS)).join(weights, "period", "left")
    out = out.withColumn("raw", F.col("raw") + F.coalesce("gamma", F.lit(0.0)) * F.col("add")).drop("add", "gamma", "base")
    return walkforward.shape_safe(finish.finish(out, model.finish))


# -- neutral to simple signals ------------------------------------------------------------


def neutral_model(panel: DataFrame, model: engine.Model | None = None) -> DataFrame:
    """Targets and predictions without what ranks, momentum and reversion of the first inputs explain."""
    model = model or MODELS["v29"]
    parts = walkforward.split(panel)
    parts = parts.withColumn("__mom", W.roll_mean("f1", 5, 2) - W.roll_mean("f1", 20, 4)).withColumn("__rev", W.roll_mean("f1", 5, 2) - F.col("f1"))
    proxies = ["__r1", "__r2", "__r3", "__m", "__v"]
    ranks = [(X.centred_rank(c) if c in parts.columns else F.lit(0.0)).alias(p) for p, c in zip(proxies, ("f1", "f2", "f3", "__mom", "__rev"))]
    parts = parts.select("*", *ranks).drop("__mom", "__rev")
    cleared = neutral.neutralise(parts, "y", proxies, "cleared")
    fitted = cleared.withColumn("y", F.when(F.col("y").isNotNull(), F.col("cleared"))).drop("cleared", *proxies)
    out = finish.finish(engine.predict(model, fitted), "neutral").drop("y")
    out = out.join(parts.select(*KEYS, "y", *proxies), KEYS)
    out = neutral.neutralise(out, "pred", proxies, "pred").drop(*proxies)
    std = F.nullif(X.dispersion("pred"), F.lit(0.0))
    out = out.withColumn("pred", X.clip(F.coalesce(X.demean("pred") / std, F.lit(0.0)), -3.5, 3.5))
    return walkforward.shape_safe(out)
