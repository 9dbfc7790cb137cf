"""Choosing head weights on the training part alone, period by period.

Candidates share their fitted heads and differ in weights, so a fold is fitted once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.plans import engine, finish, walkforward

#: Expanding training shares and the ends of their validation parts.
FOLDS = ((0.50, 0.65), (0.65, 0.80), (0.80, 1.00))


def blend(weights: Sequence[float]) -> Column:
    return sum((F.lit(float(w)) * F.col("heads")[i] for i, w in enumerate(weights)), F.lit(0.0))


def spread_out(frame: DataFrame, candidates: dict[str, Sequence[float]]) -> DataFrame:
    """A row for each candidate, with its blend as raw."""
    made = F.array(*(F.struct(F.lit(n).alias("candidate"), blend(w).alias("raw")) for n, w in candidates.items()))
    return frame.drop("raw").withColumn("__c", F.explode(made)).select("*", "__c.candidate", "__c.raw").drop("__c")


def fold_scores(parts: DataFrame, model: engine.Model, candidates: dict[str, Sequence[float]]) -> DataFrame:
    """(period, candidate, fold, score): Sharpe ratio of same-row returns plus 0.35 of the mean correlation."""
    last = parts.where("train").groupBy("period").agg((F.max("t") + 1).alias("__n"))
    known = parts.where("train").join(last, "period")
    found = []
    for fold, (start, end) in enumerate(FOLDS):
        cut = F.greatest(F.lit(8), F.floor(F.col("__n") * start))
        stop = F.least(F.col("__n"), F.greatest(cut + 2, F.floor(F.col("__n") * end)))
        part = known.where(F.col("t") < stop).withColumn("train", F.col("t") < cut).drop("__n")
        out = spread_out(engine.predict(model, part), candidates)
        out = out.withColumn("p", F.col("raw") - F.avg("raw").over(Window.partitionBy("candidate", "period", "t")))
        rows = out.groupBy("candidate", "period", "t").agg(F.avg(F.col("p") * F.col("y")).alias("ret"), *X.correlation_sums("p", "y")).select("candidate", "period", "ret", X.correlation().alias("c"))
        std = F.stddev_pop("ret")
        sharpe = F.when(std > 1e-8, F.avg("ret") / F.nullif(std, F.lit(0.0))).otherwise(0.0)
        found.append(rows.groupBy("candidate", "period").agg((sharpe + 0.35 * F.avg("c")).alias("score")).withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, found)


def choose(parts: DataFrame, model: engine.Model, candidates: dict[str, Sequence[float]]) -> DataFrame:
    """(period, candidate): the best mean score less half its deviation, among those that win two folds over the first.

    The first candidate is the default.
    """
    first = next(iter(candidates))
    base = F.max(F.when(F.col("candidate") == first, F.col("score"))).over(Window.partitionBy("period", "fold"))
    scores = fold_scores(parts, model, candidates).withColumn("base", base)
    robust = scores.groupBy("period", "candidate").agg((F.avg("score") - 0.5 * F.coalesce(F.stddev_pop("score"), F.lit(0.0))).alias("robust"), F.sum((F.col("score") > F.col("base")).cast("int")).alias("wins"))
    fit = robust.where((F.col("candidate") == first) | (F.col("wins") >= 2))
    return fit.groupBy("period").agg(F.max_by("candidate", F.struct("robust", "candidate")).alias("candidate"))


def searched(panel: DataFrame, model: engine.Model, candidates: dict[str, Sequence[float]], **options) -> DataFrame:
    """Walk-forward predictions with the weights chosen for each period."""
    parts = walkforward.split(panel, **options)
    out = spread_out(engine.predict(model, parts), candidates).join(choose(parts, model, candidates), ["period", "candidate"], "left_semi")
    return walkforward.shape_safe(finish.finish(out, model.finish))


def rank_shares(model: engine.Model, shares: Sequence[float] = (0.0, 0.02, 0.04, 0.06), alpha: float = 20.0) -> tuple[engine.Model, dict[str, list[float]]]:
    """``model`` with a rank head added, and candidates that give it a share of the weight."""
    wider = engine.with_name(model, f"{model.name}+rank", heads=(*model.heads, engine.Head(0.0, "rank", alpha)))
    return wider, {f"{s:g}": [h.weight * (1 - s) for h in model.heads] + [s] for s in shares}


# -- one held-out part and a score of many terms ----------------------------------------


def with_ranks(frame: DataFrame, shares: dict[str, float]) -> DataFrame:
    """raw of each candidate de-meaned and blended with its percent ranks, by the candidate's share."""
    keys = ("candidate", "period", "t")
    w = Window.partitionBy(*keys)
    frame = frame.withColumn("raw", F.col("raw") - F.avg("raw").over(w))
    share = F.coalesce(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("candidate")], F.lit(0.0))
    mixed = (1 - share) * F.col("raw") + share * (X.percent_rank("raw", keys) - 0.5)
    frame = frame.withColumn("raw", F.when(share > 0, mixed).otherwise(F.col("raw")))
    return frame.withColumn("raw", F.col("raw") - F.avg("raw").over(w))


def held_scores(frame: DataFrame) -> DataFrame:
    """(period, candidate, score) from raw and y: correlations, their steadiness, and returns of held positions."""
    keys = ("candidate", "period", "t")
    held = F.lag("raw").over(Window.partitionBy("candidate", "period", "asset").orderBy("t"))
    known = F.when(F.col("y").isNotNull(), F.col("raw"))
    frame = frame.select(*keys, "y", "raw", (held * F.col("y")).alias("got"), X.percent_rank(known, keys).alias("rp"), X.percent_rank("y", keys).alias("ry"))
    rows = frame.groupBy(*keys).agg(*X.correlation_sums("raw", "y", "_l"), *X.correlation_sums("rp", "ry", "_r"), F.sum("got").alias("ret"), F.count("y").alias("n"), F.stddev_pop("raw").alias("sp"), F.stddev_pop("y").alias("sy"))
    fine = (F.col("n") >= 3) & (F.col("sp") >= 1e-12) & (F.col("sy") >= 1e-12)
    rows = rows.select(*keys, "ret", F.when(fine, X.correlation("_l")).alias("ic"), F.when(fine, X.correlation("_r")).alias("rank_ic"))
    quarter = F.ntile(4).over(Window.partitionBy("candidate", "period").orderBy("t"))
    blocks = rows.where("ic is not null").withColumn("block", quarter).groupBy("candidate", "period", "block").agg(F.avg("ic").alias("m"))
    blocks = blocks.groupBy("candidate", "period").agg(F.min("m").alias("worst"), F.stddev_pop("m").alias("block_std"), F.count("m").alias("blocks"))
    sums = rows.groupBy("candidate", "period").agg(
        F.avg("ic").alias("ic"), F.stddev_pop("ic").alias("ic_std"), F.avg("rank_ic").alias("rank_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"),
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"),
    )
    full = F.col("blocks") == 4
    sharpe = F.when((F.col("n") >= 5) & (F.col("std") > 1e-12), F.col("mean") / F.nullif(F.col("std"), F.lit(0.0))).otherwise(-1.0)
    # The weights of the score's terms.
    score = 0.42 * F.col("ic") + 0.18 * F.col("rank_ic") + 0.25 * sharpe + 0.10 * F.col("positive") + 0.12 * F.when(full, F.col("worst")).otherwise(F.col("ic")) - 0.16 * F.col("ic_std") - 0.10 * F.when(full, F.col("block_std")).otherwise(0.0)
    return sums.join(blocks, ["candidate", "period"], "left").select("period", "candidate", score.alias("score"))


def held_out(panel: DataFrame, model: engine.Model, probe: engine.Model, candidates: dict[str, Sequence[float]], shares: dict[str, float], *, cut: float = 0.82, least_times: int = 30, least_rows: int = 100) -> DataFrame:
    """Walk-forward predictions with the candidate that scores best on the late part of the training rows.

    ``probe`` is the model fitted for that choice. Periods too short for it take the first candidate.
    """
    parts = walkforward.split(panel)
    known = parts.where("train and y is not null")
    sizes = known.groupBy("period").agg(F.count_distinct("t").alias("times"), (F.max("t") + 1).alias("n"))
    at = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * cut)))
    trial = parts.where("train").join(sizes.where(F.col("times") >= least_times).select("period", at.alias("at")), "period")
    trial = trial.withColumn("train", F.col("t") < F.col("at")).drop("at")
    enough = trial.where("y is not null").groupBy("period").agg(F.count(F.when(F.col("train"), 1)).alias("early"), F.count(F.when(~F.col("train"), 1)).alias("late"))
    trial = trial.join(enough.where((F.col("early") >= least_rows) & (F.col("late") >= least_rows)).select("period"), "period", "left_semi")
    order = {n: i for i, n in enumerate(candidates)}
    scores = held_scores(with_ranks(spread_out(engine.predict(probe, trial), candidates), shares))
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.col("candidate")]
    best = scores.where("score is not null").groupBy("period").agg(F.max_by("candidate", F.struct("score", -rank)).alias("chosen"))
    chosen = parts.select("period").distinct().join(best, "period", "left").select("period", F.coalesce("chosen", F.lit(next(iter(candidates)))).alias("candidate"))
    out = spread_out(engine.predict(model, parts), candidates).join(chosen, ["period", "candidate"], "left_semi")
    return walkforward.shape_safe(finish.finish(with_ranks(out, shares), model.finish))
