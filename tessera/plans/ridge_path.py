"""Penalty and decay of a ridge regression chosen per period, and a score of how steady its predictions are.

The early part of a period's training rows is summed once: a dense product of its scaled features for each
weighting (equal weights, and weights that fade at each decay), in one pass. A small eigendecomposition of
each gives the coefficients for all penalties. The late part is predicted by all of them in one pass
over its rows, and every candidate is scored from aggregates per (candidate, timestamp).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.operators import linear, preprocess, sampling
from tessera.plans import engine, finish, walkforward
from tessera.plans import features as sets
from tessera.plans import search as weights
from tessera.plans.lineage import cut

#: Penalties in the order of their trial, decays likewise, and what holds without a trial. Fixed values.
ALPHAS, DECAYS, ALPHA, DECAY = (2.0, 4.0, 8.0, 16.0, 32.0), (0.12, 0.20, 0.30, 0.45), 8.0, 0.20
#: Bounds on the rows of statistics: for penalties, and for decays on both sides. Fixed values.
ROWS, DECAY_ROWS = 40_000, (15_000, 10_000)
CANDIDATE = ["period", "candidate"]


# -- scores --------------------------------------------------------------------------


def by_timestamp(frame: DataFrame, pred: str = "pred") -> DataFrame:
    """(period, candidate, t, n, ic, ret, recent_ret, flat, place, places) from (.., t, asset, y, pred) over dense timestamps.

    A timestamp without any target is left out; cells without one count as a prediction of 0. ret is the
    product of the de-meaned predictions a timestamp before with the targets; recent_ret the same inside the last 30 %.
    """
    known = F.col("y").isNotNull()
    w = Window.partitionBy(*CANDIDATE, "t")
    frame = frame.select(*CANDIDATE, "t", "asset", "y", F.when(known, F.coalesce(pred, F.lit(0.0))).alias("p"), F.max(known).over(w).alias("any")).where("any")
    frame = frame.withColumn("held", F.coalesce("p", F.lit(0.0)) - F.avg(F.coalesce("p", F.lit(0.0))).over(w))
    frame = frame.withColumn("before", F.lag("held").over(Window.partitionBy(*CANDIDATE, "asset").orderBy("t")))
    rows = frame.groupBy(*CANDIDATE, "t").agg(
        F.count("y").alias("n"), *X.correlation_sums("p", "y", "_c"), F.stddev_pop("p").alias("sp"), F.stddev_pop("y").alias("sy"),
        F.sum(F.col("before") * F.coalesce("y", F.lit(0.0))).alias("ret"), F.stddev_pop("held").alias("flat"),
    )
    order = Window.partitionBy(*CANDIDATE).orderBy("t")
    fine = (F.col("n") >= 3) & (F.col("sp") >= 1e-12) & (F.col("sy") >= 1e-12)
    rows = rows.select(*CANDIDATE, "t", "n", F.when(fine, X.correlation("_c")).alias("ic"), "ret", "flat", (F.row_number().over(order) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy(*CANDIDATE)).alias("places"))
    return rows.withColumn("start", F.greatest(F.lit(0), F.floor(F.col("places") * 0.70)))


def _sharpe(got: Column) -> Column:
    """Mean over sample deviation of at least five values, else -1."""
    std = F.stddev_samp(got)
    return F.when((F.count(got) >= 5) & (std > 0), F.avg(got) / F.nullif(std, F.lit(0.0))).otherwise(-1.0)


def scores(rows: DataFrame) -> DataFrame:
    """(period, candidate, plain, stable, recent_ic, recent_sharpe) from by_timestamp().

    plain: Sharpe ratio of lagged returns, the mean correlation and its spread, and a penalty where predictions are flat.
    stable: that with the last 30 % by itself, the share of positive correlations, the size of predictions and the
    spread of four blocks' correlations. Weights are fixed values.
    """
    block = F.lit(3)
    for i in (2, 1, 0):
        block = F.when(F.col("place") < F.floor((i + 1) * F.col("places") / 4), i).otherwise(block)
    recent = F.col("place") >= F.col("start")
    after = F.col("place") > F.col("start")  # the first of the recent ones has none before it
    rows = rows.withColumn("block", block)
    blocks = rows.where("places >= 4").groupBy(*CANDIDATE, "block").agg(F.sum("n").alias("rows"), F.coalesce(F.avg("ic"), F.lit(-1.0)).alias("m")).where("rows >= 10")
    blocks = blocks.groupBy(*CANDIDATE).agg(F.when(F.count("m") > 1, F.stddev_pop("m")).otherwise(0.0).alias("block_std"))
    sums = rows.groupBy(*CANDIDATE).agg(
        _sharpe(F.when(F.col("place") > 0, F.col("ret"))).alias("sharpe"),
        F.coalesce(F.avg("ic"), F.lit(-1.0)).alias("ic"),
        F.when(F.count("ic") > 1, F.stddev_pop("ic")).otherwise(0.0).alias("ic_std"),
        F.coalesce(F.avg((F.col("ic") > 0).cast("double")), F.lit(0.0)).alias("positive"),
        F.coalesce(F.median("flat"), F.lit(0.0)).alias("size"),
        F.first("places").alias("places"),
        F.sum(F.when(recent, F.col("n"))).alias("recent_rows"),
        _sharpe(F.when(after, F.col("ret"))).alias("recent_sharpe"),
        F.coalesce(F.avg(F.when(recent, F.col("ic"))), F.lit(-1.0)).alias("recent_ic"),
    )
    flat = F.when(F.col("size") < 1e-8, 0.5).otherwise(0.0)
    enough = (F.col("places") >= 3) & (F.col("recent_rows") >= 10)
    late = {c: F.when(enough, F.col(c)).otherwise(-1.0) for c in ("recent_sharpe", "recent_ic")}
    sums = sums.select(*CANDIDATE, (F.col("sharpe") + 0.25 * F.col("ic") - 0.15 * F.col("ic_std") - flat).alias("plain"), "positive", "size", flat.alias("flat"), *(c.alias(n) for n, c in late.items()))
    sums = sums.join(blocks, CANDIDATE, "left").withColumn("block_std", F.coalesce("block_std", F.lit(0.0)))
    stable = (
        0.30 * F.col("plain") + 0.25 * F.col("recent_sharpe") + 0.20 * F.col("recent_ic") + 0.10 * F.col("positive")
        + 0.05 * F.log(F.col("size") + 1e-8) - 0.15 * F.col("block_std") - F.col("flat")
    )
    return sums.select(*CANDIDATE, "plain", stable.alias("stable"), "recent_ic", "recent_sharpe")


def best(found: DataFrame, score: str, order: Sequence[str]) -> DataFrame:
    """(period, candidate, score) with the highest score; ties go to the first in ``order``, as do periods without any score."""
    place = F.array_position(F.lit(list(order)), F.col("candidate"))
    top = found.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy("period").agg(F.max_by(F.struct("candidate", F.col(score).alias("score")), F.struct(score, -place)).alias("top"))
    return top.select("period", "top.candidate", "top.score")


# -- the path ------------------------------------------------------------------------


def early_late(known: DataFrame, share: float = 0.80) -> DataFrame:
    """Adds ``early`` to training rows: the first ``share`` of the period's timestamps."""
    sizes = known.groupBy("period").agg((F.max("t") + 1).alias("__n"))
    at = F.when(F.col("__n") < 5, F.greatest(F.lit(1), F.col("__n") - 1)).otherwise(F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.floor(F.col("__n") * share))))
    return known.join(sizes.select("period", at.alias("__at")), "period").withColumn("early", F.col("t") < F.col("__at")).drop("__at")


def label(alpha: float, decay: float | None) -> str:
    return f"{alpha:g}" if decay is None else f"{alpha:g}/{decay:g}"


def path(early: DataFrame, names: list[str], alphas: Sequence[float], decays: Sequence[float | None]) -> DataFrame:
    """(period, candidate, start, coefficients) for every penalty at every decay (None: equal weights).

    ``early`` has scaled ``names``, y, and position and total among the rows that fading goes by. Targets
    are centred by their plain mean; weights have mean 1.
    """
    fade = {str(d): F.lit(1.0) if d is None else F.exp((F.col("position") + 1 - F.col("total")) / F.greatest(F.lit(1.0), F.col("total") * F.lit(float(d)))) for d in decays}
    early = early.select("period", "y", *names, *(w.alias(f"__fade_{i}") for i, w in enumerate(fade.values())))
    means = early.groupBy("period").agg(F.avg("y").alias("start"), *(F.avg(f"__fade_{i}").alias(f"__mean_{i}") for i in range(len(fade))))
    means = cut(means)  # a row for each period
    rows = early.join(F.broadcast(means), "period").withColumn("__y", F.col("y") - F.col("start"))
    weights = {label: F.col(f"__fade_{i}") / F.col(f"__mean_{i}") for i, label in enumerate(fade)}
    sums = linear.partial_grams(rows, [*names, "__y"], weights, ["period"])
    k, alphas = len(names), [float(a) for a in alphas]

    def run(frames):
        for frame in frames:
            made = []
            for period, weight, flat in zip(frame["period"], frame["weight"], frame["gram"]):
                whole = np.asarray(flat, float).reshape(k + 1, k + 1)
                decay = None if weight == "None" else float(weight)
                for alpha, row in zip(alphas, linear.ridge_path(whole[:k, :k], whole[:k, k], alphas)):
                    made.append((period, label(alpha, decay), row.tolist()))
            yield pd.DataFrame(made, columns=["period", "candidate", "coefficients"])

    return sums.mapInPandas(run, "period int, candidate string, coefficients array<double>").join(F.broadcast(means.select("period", "start")), "period")


def predicted(late: DataFrame, names: list[str], candidates: DataFrame) -> DataFrame:
    """(period, candidate, t, asset, y, pred) of the rows of ``late`` for each candidate of their period."""
    held = candidates.groupBy("period").agg(F.collect_list(F.struct("candidate", "start", "coefficients")).alias("cs"))  # as many as are tried
    rows = late.select("period", "t", "asset", "y", F.array(*names).alias("x")).join(held, "period").withColumn("c", F.explode("cs"))
    product = F.aggregate(F.zip_with("x", F.col("c.coefficients"), lambda x, b: x * b), F.lit(0.0), lambda total, v: total + v)
    return rows.select("period", F.col("c.candidate").alias("candidate"), "t", "asset", "y", (F.col("c.start") + product).alias("pred"))


def sides(frame: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The early and the late training rows of ``frame`` with features scaled by the early ones. Late rows keep those without a target."""
    trial = early_late(frame.where("train").select("period", "t", "asset", "asset_ord", F.when(F.abs("y") < float("inf"), F.col("y")).alias("y"), *names))
    early = trial.where(F.col("early") & F.col("y").isNotNull())
    scales = cut(preprocess.fit(sampling.even_rows(early, ROWS), names, ["period"], quantile=0.005, centre="mean"))
    scaled = cut(preprocess.apply(trial, scales, names, ["period"]))
    return scaled.where(F.col("early") & F.col("y").isNotNull()).drop("early"), scaled.where(~F.col("early")).drop("early")


def bounded(late: DataFrame, most: int) -> DataFrame:
    """``late`` with the targets of at most ``most`` evenly placed rows of a period; the others count as without one."""
    known = sampling.even_rows(late.where("y is not null"), most).select("period", "t", "asset", F.col("y").alias("__y"))
    return late.join(known, ["period", "t", "asset"], "left").withColumn("y", F.col("__y")).drop("__y")


def search(frame: DataFrame, names: list[str], *, alphas: Sequence[float] = ALPHAS, decays: Sequence[float] = DECAYS) -> DataFrame:
    """(period, alpha, decay, score): the penalty that predicts the late training rows best, then the decay that does so most steadily.

    Decays lose 0.10 for each of the recent correlation and Sharpe ratio that lies 0.05 under the best
    one's. Periods that can't be scored have the first penalty and the default decay.
    """
    early, late = sides(frame, names)
    tried = path(sampling.even_rows(early, ROWS, positions=True), names, alphas, [None])
    plain = scores(by_timestamp(predicted(bounded(late, ROWS), names, tried)))
    alpha = best(plain, "plain", [label(a, None) for a in alphas]).select("period", F.col("candidate").cast("double").alias("alpha"))
    every = frame.select("period").distinct()
    alpha = cut(every.join(alpha, "period", "left").select("period", F.coalesce("alpha", F.lit(float(alphas[0]))).alias("alpha")))

    fading = path(sampling.even_rows(early, DECAY_ROWS[0], positions=True), names, alphas, decays)
    fading = fading.join(alpha, "period").where(F.substring_index("candidate", "/", 1).cast("double") == F.col("alpha")).drop("alpha")
    fading = fading.withColumn("candidate", F.substring_index("candidate", "/", -1))
    found = scores(by_timestamp(predicted(bounded(late, DECAY_ROWS[1]), names, fading)))
    w = Window.partitionBy("period")
    lost = sum(F.when(F.col(c) < F.max(c).over(w) - 0.05, 0.10).otherwise(0.0) for c in ("recent_ic", "recent_sharpe"))
    found = found.select("period", "candidate", (F.col("stable") - lost).alias("score"))
    decay = best(found, "score", [f"{d:g}" for d in decays])
    decay = decay.select("period", F.col("candidate").cast("double").alias("decay"), "score")
    return alpha.join(decay, "period", "left").select("period", "alpha", F.coalesce("decay", F.lit(DECAY)).alias("decay"), "score")


def searched(panel: DataFrame, model: engine.Model, presets: dict[str, Sequence[float]], rank_share: float = 0.25) -> DataFrame:
    """Walk-forward predictions of ``model`` with penalty, decay, head weights and a blend with ranks chosen per period.

    Head weights are those of ``presets`` that score best on the late training rows for heads fitted with equal
    weights on the early ones; ranks are blended in if that scores better there for the final fit.
    """
    parts = walkforward.split(panel)
    frame = cut(sets.SETS[model.features](parts))
    names = sets.feature_names(frame)
    most = engine.largest(panel)
    chosen = cut(search(frame, names))
    trial = early_late(frame.where("train")).withColumn("train", F.col("early")).drop("early")
    equal = engine.with_name(model, f"{model.name}+trial", decay=0.0)
    heads = engine.predict_features(equal, trial, names, most, chosen.select("period", "alpha"))
    found = weights.spread_out(heads, presets).withColumnRenamed("raw", "pred")
    preset = best(scores(by_timestamp(found)), "plain", list(presets)).select("period", "candidate")
    preset = cut(every_period(frame, preset, next(iter(presets))))

    # the late training rows are predicted too, as rows that aren't trained on
    late = trial.where(~F.col("train"))
    out = engine.predict_features(model, frame.unionByName(late), names, None if most is None else 2 * most, chosen)
    out = cut(weights.spread_out(out, presets).join(preset, ["period", "candidate"], "left_semi").drop("candidate"))
    shares = {"plain": 0.0, "ranked": rank_share}
    both = out.withColumn("candidate", F.explode(F.array(*map(F.lit, shares))))
    both = weights.with_ranks(both, shares)
    seen = frame.where("train").select("period", "t").distinct()
    on_late = both.join(seen, ["period", "t"], "left_semi").withColumnRenamed("raw", "pred")
    blend = best(scores(by_timestamp(on_late)), "plain", list(shares)).select("period", "candidate")
    blend = every_period(frame, blend, "plain")
    kept = both.join(seen, ["period", "t"], "left_anti").join(blend, ["period", "candidate"], "left_semi").drop("candidate")
    return walkforward.shape_safe(finish.finish(kept, model.finish))


def every_period(frame: DataFrame, chosen: DataFrame, default: str) -> DataFrame:
    return frame.select("period").distinct().join(chosen, "period", "left").select("period", F.coalesce("candidate", F.lit(default)).alias("candidate"))
