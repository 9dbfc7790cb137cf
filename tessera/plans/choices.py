"""What a period's model takes from its training rows before the fit, as data.

A choice is a row for each period: ``kept``, the features to fit in their order, and where a search has
found them ``alpha`` and ``decay``. Null leaves the model's own. Statistics are aggregates over a
long table of at most ``rows`` evenly placed rows of a period, which is the models' own bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.operators import linear, sampling

KEY = ["period", "feature"]


@dataclass(frozen=True)
class Pick:
    """How a model picks its features.

    ``rule``: priority (those in ``first`` by their order, then the rest), listed (those in ``first`` only),
    patterns (by the first regular expression in ``first`` that is found in the name), correlation (by size),
    stability (by the steadiness of correlations over timestamps, if there are more than ``most``), or pruned (steady
    rank correlations, ``first`` always stays, and none that another one repeats).
    """

    rule: str
    most: int
    first: tuple[str, ...] = ()
    rows: int = 40_000
    redundancy: float = 0.985
    times: int = 256
    decay: float = 0.45


def long_form(rows: DataFrame, names: list[str]) -> DataFrame:
    """(period, t, asset_ord, y, feature, v) of ``rows``; what isn't finite is null."""
    rows = rows.select("period", "t", "asset_ord", "y", *(F.when(F.abs(n) < float("inf"), F.col(n)).cast("double").alias(n) for n in names))
    return rows.unpivot(["period", "t", "asset_ord", "y"], names, "feature", "v")


def position_of(names: list[str] | tuple[str, ...]) -> Column:
    """The feature's place in ``names`` from 1, or 0."""
    return F.array_position(F.lit(list(names)), F.col("feature")) if names else F.lit(0)


def usable(long: DataFrame, *extra: Column) -> DataFrame:
    """(period, feature, ..) of features with 5 % of values that vary, and the aggregates ``extra``."""
    found = long.groupBy(*KEY).agg((F.count("v") / F.count(F.lit(1))).alias("share"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("std"), *extra)
    return found.where((F.col("share") >= 0.05) & (F.col("std") >= 1e-8)).drop("share", "std")


def ranked(found: DataFrame, names: list[str], *order: Column, most: int) -> DataFrame:
    """(period, kept) of the first ``most``; ties by the column's place."""
    w = Window.partitionBy("period").orderBy(*order, position_of(names))
    top = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return top.groupBy("period").agg(F.array_sort(F.collect_list(F.struct("place", "feature"))).alias("k")).select("period", F.col("k.feature").alias("kept"))


def _priority(rows: DataFrame, names: list[str], pick: Pick) -> DataFrame:
    at = position_of(pick.first)
    return ranked(usable(long_form(rows, names)), names, F.when(at > 0, at).otherwise(len(pick.first) + 1), most=pick.most)


def _listed(rows: DataFrame, names: list[str], pick: Pick) -> DataFrame:
    allowed = [n for n in names if n in pick.first]
    return ranked(usable(long_form(rows, allowed)), names, position_of(pick.first), most=pick.most)


def _patterns(rows: DataFrame, names: list[str], pick: Pick) -> DataFrame:
    place = F.lit(len(pick.first))
    for i in range(len(pick.first) - 1, -1, -1):
        place = F.when(F.col("feature").rlike(pick.first[i]), i).otherwise(place)
    return ranked(usable(long_form(rows, names)), names, place, most=pick.most)


def _correlation(rows: DataFrame, names: list[str], pick: Pick) -> DataFrame:
    found = usable(long_form(rows, names), *X.correlation_sums("v", "y")).where("n >= 20")
    return ranked(found.select(*KEY, F.abs(X.correlation()).alias("score")), names, F.desc("score"), most=pick.most)


def filled(long: DataFrame) -> DataFrame:
    """Missing values as the period's median of the feature, or 0."""
    medians = long.groupBy(*KEY).agg(F.coalesce(F.median("v"), F.lit(0.0)).alias("impute"))
    return long.join(medians, KEY).withColumn("v", F.coalesce("v", "impute")).drop("impute")


def stability_scores(rows: DataFrame, names: list[str]) -> DataFrame:
    """(period, feature, score): the mean correlation per timestamp, for one sign and little spread, over usable features."""
    long = long_form(rows, names)
    by_t = filled(long).groupBy(*KEY, "t").agg(*X.correlation_sums("v", "y")).where("n >= 5").select(*KEY, X.clip(X.correlation(), -1.0, 1.0).alias("c"))
    sums = by_t.groupBy(*KEY).agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.collect_list("c").alias("cs"))  # a number for each timestamp
    same = F.aggregate("cs", F.lit(0), lambda a, c: a + (F.signum(c) == F.signum("mean")).cast("int")) / F.size("cs")
    score = F.abs("mean") * (0.5 + 0.5 * same) / (0.05 + F.col("std"))
    return usable(long).join(sums.select(*KEY, score.alias("score")), KEY, "left")


def _stability(rows: DataFrame, names: list[str], pick: Pick) -> DataFrame:
    scores = stability_scores(rows, names).withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("period")))
    # with few features all stay, in their order
    score = F.when(F.col("many") > pick.most, F.coalesce("score", F.lit(-1.0))).otherwise(0.0)
    return ranked(scores.select(*KEY, score.alias("score")), names, F.desc("score"), most=pick.most)


def steady_scores(rows: DataFrame, names: list[str], pick: Pick) -> DataFrame:
    """(period, feature, score): rank correlations per timestamp, blended of all and recent ones.

    At most ``pick.times`` evenly placed timestamps of a period count; fewer than 8 give no scores (0).
    """
    long = long_form(rows, names)
    places = rows.select("period", "t").distinct().withColumn("place", F.row_number().over(Window.partitionBy("period").orderBy("t")) - 1)
    places = places.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("period"))).where("total >= 8")
    places = places.where((F.col("total") <= pick.times) | sampling.even(F.col("place"), F.col("total"), F.lit(pick.times)))
    keys = ("period", "t", "feature")
    shown = long.join(places, ["period", "t"]).select(*keys, "place", "total", X.percent_rank("v", keys).alias("a"), X.percent_rank("y", keys).alias("b"))
    have = F.col("a").isNotNull()
    sums = shown.groupBy(*keys, "place", "total").agg(
        F.count("a").alias("n"), F.count("b").alias("all"), F.sum("a").alias("sa"), F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.when(have, F.col("b"))).alias("sb"),
        F.sum(F.col("a") * F.col("b")).alias("sab"), F.sum("b").alias("tb"), F.sum(F.col("b") * F.col("b")).alias("tbb"),
    )
    n = F.nullif(F.col("n"), F.lit(0))
    below = F.sqrt(F.greatest(F.col("saa") - F.col("sa") * F.col("sa") / n, F.lit(0.0)) * F.greatest(F.col("tbb") - F.col("tb") * F.col("tb") / F.col("all"), F.lit(0.0)))
    fine = (F.col("all") >= 4) & (F.col("n") >= 4) & (below > 1e-10)
    c = F.when(fine, (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.nullif(below, F.lit(0.0)))
    start = F.greatest(F.lit(0), F.col("total") - F.greatest(F.lit(8), F.floor(F.col("total") * 0.35)))
    late = F.col("place") >= start
    w = F.exp(-(F.col("total") - 1 - F.col("place")) / F.greatest(F.lit(1.0), F.col("total") * F.lit(pick.decay)))
    ics = sums.select(*KEY, "place", c.alias("c"), late.alias("late"), w.alias("w"))

    def mean(when: Column) -> Column:
        held = when & F.col("c").isNotNull()
        return F.sum(F.when(held, F.col("w") * F.col("c"))) / F.nullif(F.sum(F.when(held, F.col("w"))), F.lit(0.0))

    every, early = F.lit(True), ~F.col("late")
    held = ics.groupBy(*KEY).agg(
        mean(every).alias("mean"), mean(F.col("late")).alias("recent"), mean(early).alias("before"), F.count(F.when(early, 1)).alias("early"),
        F.count("c").alias("many"), F.count(F.lit(1)).alias("places"), F.collect_list(F.struct("c", "w")).alias("all"),
    )
    some = F.filter("all", lambda x: x["c"].isNotNull())
    weight = F.aggregate(some, F.lit(0.0), lambda a, x: a + x["w"])
    spread = F.aggregate(some, F.lit(0.0), lambda a, x: a + x["w"] * (x["c"] - F.col("mean")) * (x["c"] - F.col("mean"))) / F.nullif(weight, F.lit(0.0))
    same = F.aggregate(some, F.lit(0), lambda a, x: a + (F.signum(x["c"]) == F.signum("mean")).cast("int")) / F.nullif(F.col("many"), F.lit(0))
    before = F.when(F.col("early") < 3, F.col("mean")).otherwise(F.col("before"))
    agree = F.when(before * F.col("recent") >= 0, 1.0).otherwise(0.35)
    blended = 0.40 * F.col("mean") + 0.60 * F.col("recent")
    score = F.abs(blended) * (0.5 + 0.5 * same) * agree * F.sqrt(F.col("many") / F.col("places")) / (0.08 + F.coalesce(F.sqrt(spread), F.lit(1.0)))
    return usable(long).join(held.select(*KEY, score.alias("score")), KEY, "left").select(*KEY, F.coalesce("score", F.lit(0.0)).alias("score"))


def correlation_matrices(rows: DataFrame, names: list[str]) -> DataFrame:
    """(period, matrix): correlations of all pairs of features by rows, flat; missing values count as medians.

    Sums of products are made where rows lie, then added up: a row moves for each period and batch.
    """
    medians = long_form(rows, names).groupBy(*KEY).agg(F.coalesce(F.median("v"), F.lit(0.0)).alias("m"))
    medians = medians.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("feature", "m"))).alias("ms"))
    fill = [F.coalesce(F.when(F.abs(n) < float("inf"), F.col(n)).cast("double"), F.col("ms")[n]).alias(n) for n in names]
    whole = rows.join(medians, "period").select("period", *fill, F.lit(1.0).alias("__one"))
    sums = linear.partial_grams(whole, [*names, "__one"], {"all": F.lit(1.0)}, ["period"])

    def run(frames):
        for frame in frames:
            out = frame[["period"]].copy()
            out["matrix"] = [_correlations(np.asarray(g, float), len(names)).ravel().tolist() for g in frame["gram"]]
            yield out

    return sums.mapInPandas(run, "period int, matrix array<double>")


def _correlations(flat: np.ndarray, k: int) -> np.ndarray:
    whole = flat.reshape(k + 1, k + 1)
    n, total = whole[k, k], whole[:k, k]
    cov = whole[:k, :k] / n - np.outer(total, total) / (n * n)
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    std = np.where(np.isfinite(std) & (std >= 1e-8), std, 1.0)
    return np.clip(np.nan_to_num(cov / np.outer(std, std)), -1.0, 1.0)


def pruned(rows: DataFrame, names: list[str], pick: Pick) -> DataFrame:
    """(period, kept): ``pick.first``, then features by steady_scores() that no kept one repeats, then others until there are enough.

    The greedy choice is a fold over the ranked features of a period inside the plan.
    """
    scores = steady_scores(rows, names, pick)
    order = F.struct(-F.col("score"), position_of(names).alias("at"))
    found = scores.groupBy("period").agg(F.array_sort(F.collect_list(order)).alias("o"))
    matrix = correlation_matrices(sampling.even_rows(rows, pick.rows), names)
    found = found.join(matrix, "period").select("period", "matrix", F.transform("o", lambda x: x["at"].cast("int")).alias("order"))
    k = len(names)
    core = F.array(*(F.lit(names.index(n) + 1) for n in pick.first if n in names)).cast("array<int>")
    core = F.filter(core, lambda i: F.array_contains("order", i))

    def step(kept: Column, i: Column, free: bool) -> Column:
        repeats = F.exists(kept, lambda j: F.abs(F.get("matrix", (i - 1) * k + j - 1)) >= pick.redundancy) if not free else F.lit(False)
        return F.when((F.size(kept) >= pick.most) | F.array_contains(kept, i) | repeats, kept).otherwise(F.concat(kept, F.array(i)))

    found = found.select("period", "matrix", "order", F.aggregate("order", core, lambda kept, i: step(kept, i, False)).alias("kept"))
    found = found.select("period", F.aggregate("order", F.col("kept"), lambda kept, i: step(kept, i, True)).alias("kept"))
    return found.select("period", F.transform(F.slice("kept", 1, pick.most), lambda i: F.get(F.lit(list(names)), i - 1)).alias("kept"))


RULES = {"priority": _priority, "listed": _listed, "patterns": _patterns, "correlation": _correlation, "stability": _stability}


def kept(rows: DataFrame, names: list[str], pick: Pick) -> DataFrame:
    """(period, kept) for training ``rows`` (period, t, asset_ord, y, features) by the model's rule."""
    if pick.rule == "pruned":
        return pruned(rows, names, pick)  # its statistics take all timestamps, bounded by their number
    return RULES[pick.rule](sampling.even_rows(rows, pick.rows), names, pick)


def as_settings(chosen: DataFrame) -> DataFrame:
    """(of, kept, alpha, decay) with nulls for what isn't chosen; ``of`` is the period, under a name that the rows don't have."""
    have = {"kept": "array<string>", "alpha": "double", "decay": "double"}
    return chosen.select(F.col("period").alias("of"), *((F.col(c) if c in chosen.columns else F.lit(None)).cast(kind).alias(c) for c, kind in have.items()))


@dataclass
class Setting:
    """A period's choice inside a task."""

    kept: list[str] | None = None
    alpha: float | None = None
    decay: float | None = None

    @staticmethod
    def of(rows: pd.DataFrame) -> Setting:
        if not len(rows):
            return Setting()
        row = rows.iloc[0]
        known = lambda v: None if v is None or np.isnan(v) else float(v)
        return Setting(None if row["kept"] is None else list(row["kept"]), known(row["alpha"]), known(row["decay"]))
