"""From raw predictions to bounded signals whose timestamps have mean zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions.windows import clean


def bounded(frame: DataFrame, value: str = "raw", into: str = "pred") -> DataFrame:
    """Missing to 0, clipped to the model's limit."""
    return frame.withColumn(into, X.clip(F.coalesce(clean(value), F.lit(0.0)), -F.col("limit"), F.col("limit")))


def centred(frame: DataFrame, into: str = "pred") -> DataFrame:
    return frame.withColumn(into, F.col(into) - X.mean(into))


def clip_finish(frame: DataFrame, value: str = "raw", into: str = "pred") -> DataFrame:
    return centred(bounded(frame, value, into), into)


def double_finish(frame: DataFrame, value: str = "raw", into: str = "pred") -> DataFrame:
    """De-meaned twice, which takes rounding leftovers along."""
    return centred(clip_finish(frame, value, into), into)


def mad_cap_finish(frame: DataFrame, value: str = "raw", into: str = "pred", width: float = 4.0) -> DataFrame:
    """Capped at ``width`` robust deviations around the timestamp's median, then de-meaned."""
    frame = bounded(frame, value, into).withColumn("__median", X.median(into))
    frame = frame.withColumn("__mad", X.median(F.abs(F.col(into) - F.col("__median"))))
    cap = F.nullif(width * 1.4826 * F.col("__mad"), F.lit(0.0))
    capped = F.when(cap.isNull(), F.col(into)).otherwise(X.clip(into, F.col("__median") - cap, F.col("__median") + cap))
    return double_demean(frame.withColumn(into, capped).drop("__median", "__mad"), into)


def double_demean(frame: DataFrame, into: str) -> DataFrame:
    return centred(centred(frame, into), into)


def conviction_finish(frame: DataFrame, value: str = "raw", into: str = "pred", power: float = 1.25, zone: float = 0.25, weak: float = 0.35, raw_share: float = 0.2) -> DataFrame:
    """Ranks raised to a power, weak ones damped, blended with the squashed values."""
    frame = clip_finish(frame, value, into)
    frame = frame.withColumn("__score", 2 * X.percent_rank(into) - 1).withColumn("__std", X.dispersion(into))
    shaped = F.signum("__score") * F.pow(F.abs("__score"), power) * F.when(F.abs("__score") < zone, weak).otherwise(1.0)
    squashed = F.when(F.col("__std") > 1e-8, F.tanh(F.col(into) / F.nullif(F.col("__std"), F.lit(0.0)))).otherwise(0.0)
    return centred(frame.withColumn(into, (1 - raw_share) * shaped + raw_share * squashed).drop("__score", "__std"), into)


def neutral_finish(frame: DataFrame, value: str = "raw", into: str = "pred") -> DataFrame:
    """Capped at three absolute deviations, then standard scores and ranks blended."""
    frame = clip_finish(frame, value, into).withColumn("__median", X.median(into))
    frame = frame.withColumn("__mad", F.nullif(X.median(F.abs(F.col(into) - F.col("__median"))), F.lit(0.0)))
    capped = F.coalesce(X.clip(into, F.col("__median") - 3 * F.col("__mad"), F.col("__median") + 3 * F.col("__mad")), F.lit(0.0))
    frame = frame.withColumn(into, F.when(F.col("__mad").isNull(), F.col(into)).otherwise(capped)).drop("__median", "__mad")
    score = F.coalesce(X.demean(into) / F.nullif(X.dispersion(into), F.lit(0.0)), F.lit(0.0))
    return frame.withColumn(into, 0.72 * score + 0.28 * X.centred_rank(into))


def mad_capped(frame: DataFrame, value: str, into: str, width: float) -> DataFrame:
    """Missing to 0, capped at ``width`` robust deviations (or plain ones) around the timestamp's median."""
    frame = frame.withColumn(into, F.coalesce(clean(value), F.lit(0.0)))
    frame = frame.withColumn("__median", X.median(into)).withColumn("__std", X.dispersion(into))
    frame = frame.withColumn("__mad", 1.4826 * X.median(F.abs(F.col(into) - F.col("__median"))))
    cap = width * F.when(F.col("__mad") > 1e-7, F.col("__mad")).when(F.col("__std") > 1e-7, F.col("__std")).otherwise(1.0)
    return frame.withColumn(into, X.clip(into, F.col("__median") - cap, F.col("__median") + cap)).drop("__median", "__mad", "__std")


def mad_first_finish(frame: DataFrame, value: str = "raw", into: str = "pred", width: float = 3.5) -> DataFrame:
    """Capped at ``width`` robust deviations, de-meaned and only then clipped."""
    frame = centred(mad_capped(frame, value, into, width), into)
    return frame.withColumn(into, X.clip(into, -F.col("limit"), F.col("limit")))


def mad_clip_finish(frame: DataFrame, value: str = "raw", into: str = "pred", width: float = 3.5) -> DataFrame:
    """Capped at ``width`` robust deviations, clipped to the limit and then de-meaned."""
    return centred(bounded(mad_capped(frame, value, into, width), into, into), into)


FINISHES = {"mad_first": mad_first_finish, "mad_clip": mad_clip_finish, "neutral": neutral_finish, "clip": clip_finish, "double": double_finish, "mad_cap": mad_cap_finish, "conviction": conviction_finish}


def place(by: Column | str) -> Column:
    """Position within the timestamp by value; ties by asset order."""
    return F.row_number().over(Window.partitionBy("period", "t").orderBy(F.col(by) if isinstance(by, str) else by, "asset_ord"))


def rank_transport(frame: DataFrame, base: str = "pred", horizon: str = "horizon", into: str = "transported", power: float = 0.60) -> DataFrame:
    """Gives the asset with the k-th smallest ``base`` the k-th smallest ``horizon`` value, reshaped.

    The sorted values of a timestamp are one array as long as its assets, read by position.
    """
    w = Window.partitionBy("period", "t")
    std = F.greatest(F.stddev_pop(horizon).over(w), F.lit(1e-8))
    shaped = F.signum(horizon) * F.pow(F.abs(horizon) / std, power) * std
    frame = frame.withColumn("__shaped", shaped).withColumn("__place", place(base))
    # shaping keeps the order, so shaped values sort like the values themselves
    sorted_values = F.array_sort(F.collect_list("__shaped").over(w))
    frame = frame.withColumn(into, F.element_at(sorted_values, F.col("__place"))).drop("__shaped", "__place")
    return clip_finish(frame, into, into)


def finish(frame: DataFrame, how: str, transport: float = 0.0) -> DataFrame:
    """Adds pred; with ``transport``, that share of forward predictions placed by rank."""
    frame = FINISHES[how](frame)
    if not transport:
        return frame
    frame = clip_finish(frame, "forward", "horizon")
    frame = rank_transport(frame)
    mixed = (1 - transport) * F.col("pred") + transport * F.col("transported")
    return clip_finish(frame.withColumn("mixed", mixed), "mixed", "pred").drop("mixed", "transported", "horizon")


def fallback(panel: DataFrame, second: float = 0.0, limit: float = 10.0) -> DataFrame:
    """Untrained models: the rank of the first feature, with a share ``second`` of that of its short mean. Without both it is 0."""
    from tessera.functions import windows as W

    frame = panel.withColumn("__ma5", W.roll_mean("f1", 5, 2))
    raw = X.centred_rank("f1")
    if second:
        raw = (1 - second) * raw + second * X.centred_rank("__ma5")
    return clip_finish(frame.withColumn("raw", F.coalesce(raw, F.lit(0.0))).withColumn("limit", F.lit(limit)).drop("__ma5"))
