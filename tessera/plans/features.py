"""Feature sets as two projections: series windows first, then cross-sections.

A set is a function of a panel with f1..fk. Everything that shares a window is in one
``select``, so a panel is sorted once by asset and once by time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import windows as W

KEYS = ("period", "time", "t", "asset", "asset_ord")


def inputs(panel: DataFrame) -> list[str]:
    """f1, f2, ... in order of number."""
    return sorted((c for c in panel.columns if re.fullmatch(r"f\d+", c)), key=lambda c: int(c[1:]))


def build(panel: DataFrame, series: dict[str, Column], cross: dict[str, Column], after: dict[str, Column] | None = None) -> DataFrame:
    """``series`` over assets, then ``cross`` over timestamps, which may use series, then ``after`` over both."""
    first = panel.select("*", *(c.alias(n) for n, c in series.items()))
    second = first.select("*", *(c.alias(n) for n, c in cross.items()))
    return second.select("*", *(c.alias(n) for n, c in (after or {}).items()))


def compact(panel: DataFrame) -> DataFrame:
    """29 features: values and ranks of all inputs, short histories of the first three.

    Ranks take a sort each, so they come first, while rows are narrow.
    """
    names = inputs(panel)
    ranks = {f"{f}_rank": X.centred_rank(f) for f in names} | {"f1_demean": X.median_demean("f1")}
    panel = W.with_ewma(panel, {"f1_ewma5": ("f1", 5, 2)}).select("*", *(c.alias(n) for n, c in ranks.items()))
    series: dict[str, Column] = {}
    for f in names[:3]:
        series |= {f"{f}_lag1": W.lag(f), f"{f}_diff1": W.diff(f)}
    series |= {
        "f1_lag3": W.lag("f1", 3),
        "f1_diff3": W.diff("f1", 3),
        "f1_ma5": W.roll_mean("f1", 5, 2),
        "f1_ma20": W.roll_mean("f1", 20, 4),
        "f1_sd20": W.roll_std("f1", 20, 4),
    }
    mixed = {"f1_roll_z": (F.col("f1") - F.col("f1_ma5")) / (F.col("f1_sd20") + W.EPS), "f1_mom_spread": F.col("f1_ma5") - F.col("f1_ma20")}
    if len(names) >= 2:
        mixed["rank12"] = F.col("f1_rank") - F.col("f2_rank")
    if len(names) >= 3:
        mixed["rank13"] = F.col("f1_rank") - F.col("f3_rank")
    return build(panel, series, mixed)


def classic(panel: DataFrame) -> DataFrame:
    """24 features: ranks and changes of the first three, means up to 60 rows of the first."""
    names = inputs(panel)
    series = {f"{f}_diff1": W.diff(f) for f in names[:3]}
    series |= {
        "f1_ma5": W.roll_mean("f1", 5, 2),
        "f1_ma20": W.roll_mean("f1", 20, 3),
        "f1_ma60": W.roll_mean("f1", 60, 5),
        "f1_sd20": F.coalesce(W.roll_std("f1", 20, 3), F.lit(0.0)),
    }
    panel = W.with_ewma(panel, {"f1_ewma5": ("f1", 5, 2)})
    cross = {f"{f}_rank": X.centred_rank(f) for f in [*names[:3], "f1_ma5", "f1_ma20", "f1_ma60"]}
    cross |= {"f1_roll_z": (F.col("f1") - F.col("f1_ma5")) / (F.col("f1_sd20") + W.EPS), "f1_mom_spread": F.col("f1_ma5") - F.col("f1_ma60"), "f1_demean": X.median_demean("f1")}
    after = {"rank_spread": F.col("f1_rank") - F.col("f2_rank")} if len(names) >= 2 else {}
    return build(panel, series, cross, after)


def ranked(panel: DataFrame) -> DataFrame:
    """Classic with changes of ranks, volatility-adjusted changes and the spread over features."""
    names = inputs(panel)
    base = classic(panel)
    series = {f"{f}_rankchg": W.diff(f"{f}_rank") for f in names[:3]} | {f"{f}_voladj": F.col(f"{f}_diff1") / (W.roll_std(f, 20, 3) + W.EPS) for f in names[:3]}
    ranks = [F.col(f"{f}_rank") for f in names[:3]]
    return base.select("*", *(c.alias(n) for n, c in series.items()), X.row_mean(ranks).alias("rank_mean"), X.row_spread(ranks).alias("rank_dispersion"))


def robust(panel: DataFrame) -> DataFrame:
    """Cross-sections only: ranks, robust z-scores and deviations of all inputs, and their consensus."""
    names = inputs(panel)
    first = panel.select("*", *(X.centred_rank(f).alias(f"{f}_rank") for f in names), *(X.median_demean(f).alias(f"{f}_demean") for f in names))
    second = first.select("*", *(X.median(F.abs(F.col(f"{f}_demean"))).alias(f"{f}_mad") for f in names))
    third = second.select("*", *(X.over_deviation(f"{f}_demean", f"{f}_mad", 5.0).alias(f"{f}_robust_z") for f in names)).drop(*(f"{f}_mad" for f in names))
    ranks, scores = [F.col(f"{f}_rank") for f in names], [F.col(f"{f}_robust_z") for f in names]
    pairs = [(a, b) for i, a in enumerate(names[:3]) for b in names[i + 1 : 3]]
    more = {f"spread_{a}_{b}": F.col(f"{a}_rank") - F.col(f"{b}_rank") for a, b in pairs} | {f"product_{a}_{b}": F.col(f"{a}_rank") * F.col(f"{b}_rank") for a, b in pairs}
    more |= {"rank_consensus": X.present_mean(ranks), "rank_disagreement": X.present_spread(ranks), "rank_range": X.present_range(ranks), "z_consensus": X.present_mean(scores), "z_disagreement": X.present_spread(scores)}
    return third.select("*", *(c.alias(n) for n, c in more.items()))


def horizons(panel: DataFrame) -> DataFrame:
    """Compact with volatility, range, reversal and regime features of the first input."""
    base = W.with_ewma(compact(panel), {"f1_ewma8": ("f1", 8, 3)})
    f = F.col("f1")
    rank = lambda i: F.col(f"f{i}_rank") if f"f{i}_rank" in base.columns else F.lit(0.0)  # noqa: E731  an absent feature is 0
    series = {
        "f1_vol10": W.roll_std("f1", 10, 3),
        "f1_range10": W.range_position("f1", 10, 3),
        "f1_range20": W.range_position("f1", 20, 4),
        "f1_rank_lag1": W.lag("f1_rank"),
        "f1_accel": W.acceleration("f1"),
    }
    wide = base.select("*", *(c.alias(n) for n, c in series.items()))
    more = {
        "f1_vol_ratio": F.col("f1_vol10") / (F.col("f1_sd20") + W.EPS),
        "f1_mom3_vol": F.col("f1_diff3") / (F.col("f1_sd20") + W.EPS),
        "f1_rank_change": F.col("f1_rank") - F.col("f1_rank_lag1"),
        "f1_reversal5": F.col("f1_ma5") - f,
        "f1_reversal8": F.col("f1_ewma8") - f,
        "core": 0.55 * rank(1) - 0.30 * rank(2) + 0.15 * rank(3),
        "regime": X.dispersion("f1"),
    }
    return wide.select("*", *(c.alias(n) for n, c in more.items()))


def late(panel: DataFrame) -> DataFrame:
    """Features of the last three inputs only."""
    names = inputs(panel)[-3:]
    series: dict[str, Column] = {}
    for f in names:
        series |= {f"{f}_diff1": W.diff(f), f"{f}_diff3": W.diff(f, 3), f"{f}_ma5": W.roll_mean(f, 5, 2), f"{f}_sd5": W.roll_std(f, 5, 2), f"{f}_sd20": W.roll_std(f, 20, 4)}
    cross = {f"{f}_rank": X.centred_rank(f) for f in names} | {f"{f}_demean": X.median_demean(f) for f in names}
    cross |= {f"{f}_reversal5": F.col(f"{f}_ma5") - F.col(f) for f in names} | {f"{f}_vol_ratio": F.col(f"{f}_sd5") / (F.col(f"{f}_sd20") + W.EPS) for f in names}
    after = {"late_spread": F.col(f"{names[0]}_rank") - F.col(f"{names[-1]}_rank")}
    return build(panel.drop(*[f for f in inputs(panel) if f not in names]), series, cross, after)


def changes(panel: DataFrame, ranked_inputs: int = 3) -> DataFrame:
    """33 features: histories of the first three inputs with changes of their ranks and changes over volatility."""
    names = inputs(panel)
    ranks = {f"{f}_rank": X.centred_rank(f) for f in names[:ranked_inputs]}
    base = W.with_ewma(panel, {"f1_ewma5": ("f1", 5, 2)}).select("*", *(c.alias(n) for n, c in ranks.items()))
    series: dict[str, Column] = {}
    for f in names[:3]:
        series |= {
            f"{f}_diff1": W.diff(f),
            f"{f}_ma5": W.roll_mean(f, 5, 2),
            f"{f}_ma20": W.roll_mean(f, 20, 3),
            f"{f}_sd20": F.coalesce(W.roll_std(f, 20, 3), F.lit(0.0)),
            f"{f}_rankchg": W.diff(f"{f}_rank"),
        }
    series["f1_ma60"] = W.roll_mean("f1", 60, 5)
    mixed = {f"{f}_voladj": F.col(f"{f}_diff1") / (F.col(f"{f}_sd20") + W.EPS) for f in names[:3]}
    mixed |= {"f1_roll_z": (F.col("f1") - F.col("f1_ma5")) / (F.col("f1_sd20") + W.EPS), "f1_mom_spread": F.col("f1_ma5") - F.col("f1_ma60")}
    mixed["rank_mean"] = X.row_mean([F.col(n) for n in ranks])
    if len(names) >= 2:
        mixed["rank12"] = F.col("f1_rank") - F.col("f2_rank")
    return build(base, series, mixed)


def momenta(panel: DataFrame) -> DataFrame:
    """42 features: changes, momentum and reversion of the first three inputs, and the means of their ranks."""
    names = inputs(panel)[:3]
    parts = {"momentum": {f"{f}_mom20": F.col(f"{f}_ma5") - F.col(f"{f}_ma20") for f in names}, "reversion": {f"{f}_revert20": F.col(f"{f}_ma20") - F.col(f) for f in names}}
    wide = changes(panel).select("*", *(c.alias(n) for part in parts.values() for n, c in part.items()))
    ranked_parts = wide.select("*", *(X.centred_rank(n).alias(f"__{n}") for part in parts.values() for n in part))
    means = [X.row_mean([F.col(f"__{n}") for n in part]).alias(f"{kind}_mean") for kind, part in parts.items()]
    spread = X.row_spread([F.col(f"{f}_rank") for f in names]).alias("rank_dispersion")
    return ranked_parts.select(*wide.columns, spread, *means)


def four_ranks(panel: DataFrame) -> DataFrame:
    """37 features: changes with the ranks of four inputs, their dispersion and the mean change of three."""
    names = inputs(panel)
    more = {"rank_dispersion": X.row_spread([F.col(f"{f}_rank") for f in names[:4]]), "rank_accel": X.row_mean([F.col(f"{f}_rankchg") for f in names[:3]])}
    if len(names) >= 3:
        more["rank13"] = F.col("f1_rank") - F.col("f3_rank")
    return changes(panel, 4).select("*", *(c.alias(n) for n, c in more.items()))


def weighed_ranks(panel: DataFrame) -> DataFrame:
    """38 features: four_ranks and the mean product of value and rank."""
    return four_ranks(panel).withColumn("raw_rank", X.row_mean([F.col(f) * F.col(f"{f}_rank") for f in inputs(panel)[:4]]))


def agreement(panel: DataFrame) -> DataFrame:
    """30 features: classic with robust scores and rank changes of the first two inputs and their mean rank."""
    names = inputs(panel)[:2]
    base = classic(panel)
    own = base.columns
    base = base.select("*", *(X.median_demean(f).alias(f"__{f}") for f in names))
    base = base.select("*", *(X.median(F.abs(F.col(f"__{f}"))).alias(f"__mad_{f}") for f in names))
    more = {f"{f}_robust_z": X.over_deviation(f"__{f}", f"__mad_{f}", 6.0) for f in names} | {f"{f}_rankchg": W.diff(f"{f}_rank") for f in names}
    more["f1_trend_accel"] = F.col("f1_ma5") - 2 * F.col("f1_ma20") + F.col("f1_ma60")
    if len(names) == 2:
        more["rank_agree"] = X.row_mean([F.col(f"{f}_rank") for f in names])
    return base.select(*own, *(c.alias(n) for n, c in more.items()))


#: Inputs that come first where a panel has them. Fixed values.
PRIMARY = ("f4", "f5", "f6")


def primary_inputs(names: list[str]) -> list[str]:
    """Three inputs: the preferred ones, then those from the end; without any preferred one, the last three in order."""
    wanted = [f for f in PRIMARY if f in names]
    return (wanted + [f for f in reversed(names) if f not in wanted])[:3] if wanted else names[-3:]


def primary(panel: DataFrame) -> DataFrame:
    """31 features of three inputs: positions at the timestamp, short changes, reversals, and how ranks persist."""
    names = primary_inputs(inputs(panel))
    first = names[0]
    panel = panel.drop(*[f for f in inputs(panel) if f not in names])
    base = W.with_ewma(panel, {f"__ewma_{f}": (f, 8, 3) for f in names[:2]})
    base = base.select("*", *(X.centred_rank(f).alias(f"{f}_rank") for f in names), *(X.median_demean(f).alias(f"{f}_demean") for f in names))
    own = [*panel.columns, *(f"{f}_{k}" for f in names for k in ("rank", "demean"))]
    series = {f"{f}_{k}": c for f in names for k, c in (("lag1", W.lag(f)), ("diff1", W.diff(f)), ("diff3", W.diff(f, 3)))}
    for f in names[:2]:
        x = F.col(f)
        series |= {f"{f}_reversal5": W.roll_mean(f, 5, 2) - x, f"{f}_reversal8": F.col(f"__ewma_{f}") - x, f"{f}_z10": W.zscore(f, W.roll_mean(f, 10, 3), W.roll_std(f, 10, 3))}
    before = W.lag(f"{first}_rank")
    series |= {
        f"{first}_rank_persist": F.col(f"{first}_rank") * before,
        f"{first}_rank_turnover": F.abs(F.col(f"{first}_rank") - before),
        f"{first}_vol_ratio": W.roll_std(first, 5, 2) / (W.roll_std(first, 20, 4) + W.EPS),
    }
    r = [F.col(f"{f}_rank") for f in names]
    more = {f"rank{i + 1}{j + 1}": r[i] - r[j] for i, j in ((0, 1), (0, 2), (1, 2)) if j < len(r)}
    if len(r) == 3:
        more["relative"] = r[0] + r[1] - 2 * r[2]
    return base.select(*own, *(c.alias(n) for n, c in series.items())).select("*", *(c.alias(n) for n, c in more.items()))


def deviation(x: str, mean: str, std: str) -> Column:
    return (F.col(x) - F.col(mean)) / (F.col(std) + W.EPS)


def over(x: str, std: str) -> Column:
    return F.col(x) / (F.col(std) + W.EPS)


def ordered(frame: DataFrame, panel: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``panel`` that aren't features, then ``names``, of which a feature that can't be made is left out."""
    rest = [c for c in panel.columns if c not in inputs(panel)]
    return frame.select(*rest, *(n for n in names if n in frame.columns))


def _ranked_inputs(panel: DataFrame, ewmas: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Exponential means of several spans in one pass, then ranks of all inputs and the first one's deviation from the median."""
    names = inputs(panel)
    ranks = [X.centred_rank(f).alias(f"{f}_rank") for f in names]
    return W.with_ewma(panel, ewmas).select("*", *ranks, X.median_demean(names[0]).alias(f"{names[0]}_demean"))


def _core(names: list[str]) -> Column:
    return 0.55 * F.col(f"{names[0]}_rank") - 0.30 * F.col(f"{names[1]}_rank") + 0.15 * F.col(f"{names[2]}_rank")


def paths(panel: DataFrame) -> DataFrame:
    """57 features: means and volatilities of the first input at several lengths, ranks and their changes, sums and products of ranks.

    Windows over assets share one sort, so that 57 columns take no more sorts by asset than 29.
    """
    names = inputs(panel)
    a, few = names[0], names[:3]
    base = _ranked_inputs(panel, {f"{a}_ew3": (a, 3, 2), f"{a}_ew8": (a, 8, 3), f"{a}_ew21": (a, 21, 5)})
    series = {f"{f}_{n}": c for f in few for n, c in (("d1", W.diff(f)), ("d3", W.diff(f, 3)), ("rank_d1", W.diff(f"{f}_rank")), ("lag1", W.lag(f)))}
    series |= {f"{a}_lag3": W.lag(a, 3), f"{a}_rank_lag1": W.lag(f"{a}_rank"), f"{a}_rank_lag3": W.lag(f"{a}_rank", 3), "__d5": W.diff(a, 5), f"{a}_accel": W.acceleration(a)}
    series |= {f"{a}_ma{n}": W.roll_mean(a, n, least) for n, least in ((3, 2), (8, 3), (21, 5), (60, 8))} | {f"{a}_vol{n}": W.roll_std(a, n, least) for n, least in ((8, 3), (21, 5))}
    series |= {f"{f}_ma5": W.roll_mean(f, 5, 2) for f in few[1:]} | {"__ma10": W.roll_mean(f, 10, 3) for f in few[1:2]} | {"__vol10": W.roll_std(f, 10, 3) for f in few[1:2]}
    cross = {
        f"{a}_z8": deviation(a, f"{a}_ma8", f"{a}_vol8"),
        f"{a}_z21": deviation(a, f"{a}_ma21", f"{a}_vol21"),
        f"{a}_trend3_21": F.col(f"{a}_ma3") - F.col(f"{a}_ma21"),
        f"{a}_ewspread": F.col(f"{a}_ew3") - F.col(f"{a}_ew21"),
        f"{a}_mom3vol": over(f"{a}_d3", f"{a}_vol8"),
        f"{a}_mom5vol": over("__d5", f"{a}_vol21"),
        f"{a}_rank_persist": F.col(f"{a}_rank") + F.col(f"{a}_rank_lag1"),
        f"{a}_rank_reversal": F.col(f"{a}_rank_lag1") - F.col(f"{a}_rank"),
    }
    for f in few[1:2]:
        r, q = F.col(f"{a}_rank"), F.col(f"{f}_rank")
        cross |= {f"{f}_reversal": F.col(f"{f}_ma5") - F.col(f), f"{f}_z10": deviation(f, "__ma10", "__vol10"), "rank12_spread": r - q, "rank12_sum": r + q, "rank12_product": r * q}
    for f in few[2:]:
        r, q = F.col(f"{a}_rank"), F.col(f"{f}_rank")
        cross |= {f"{f}_rank_ma5": X.centred_rank(f"{f}_ma5"), "rank13_spread": r - q, "rank13_product": r * q, "core": _core(names)}
    first = "lag1 lag3 rank_lag1 rank_lag3 ma3 ma8 ma21 ma60 ew3 ew8 ew21 vol8 vol21 z8 z21 trend3_21 ewspread accel mom3vol mom5vol rank_persist rank_reversal demean"
    own = dict(zip(few, (first, "lag1 ma5 reversal z10", "lag1 ma5 rank_ma5")))
    order = [n for f in names for n in (f, f"{f}_rank", *((f"{f}_{k}" for k in f"d1 d3 rank_d1 {own[f]}".split()) if f in few else ()))]
    return ordered(build(base, series, cross), panel, [*order, "rank12_spread", "rank12_sum", "rank12_product", "rank13_spread", "rank13_product", "core"])


def trails(panel: DataFrame) -> DataFrame:
    """58 features: three lags and changes of three inputs, long means of the first, and the rank of how far the ranks disagree."""
    names = inputs(panel)
    a, few = names[0], names[:3]
    base = _ranked_inputs(panel, {f"{a}_ew4": (a, 4, 2), f"{a}_ew12": (a, 12, 3), f"{a}_ew32": (a, 32, 5)})
    base = base.withColumn("__spread", X.present_spread([F.col(f"{f}_rank") for f in names]))
    series = {f"{f}_lag{k}": W.lag(f, k) for f in few for k in (1, 2, 3)} | {f"{f}_d{k}": W.diff(f, k) for f in few for k in (1, 3, 5)}
    series |= {f"{a}_rank_lag1": W.lag(f"{a}_rank"), f"{a}_accel": W.acceleration(a)}
    series |= {f"{a}_ma{n}": W.roll_mean(a, n, least) for n, least in ((3, 2), (8, 3), (21, 5), (60, 8))} | {f"{a}_vol{n}": W.roll_std(a, n, least) for n, least in ((8, 3), (21, 5))}
    series |= {f"__ma5_{f}": W.roll_mean(f, 5, 2) for f in few[1:]} | {"__ma10": W.roll_mean(f, 10, 3) for f in few[1:2]} | {"__vol10": W.roll_std(f, 10, 3) for f in few[1:2]}
    rank, before = F.col(f"{a}_rank"), F.col(f"{a}_rank_lag1")
    cross = {
        f"{a}_rank_persist": rank * before,
        f"{a}_rank_reversal": before - rank,
        f"{a}_z8": deviation(a, f"{a}_ma8", f"{a}_vol8"),
        f"{a}_z21": deviation(a, f"{a}_ma21", f"{a}_vol21"),
        f"{a}_mom3vol": over(f"{a}_d3", f"{a}_vol8"),
        f"{a}_mom5vol": over(f"{a}_d5", f"{a}_vol21"),
        f"{a}_trend3_21": F.col(f"{a}_ma3") - F.col(f"{a}_ma21"),
        f"{a}_trend8_60": F.col(f"{a}_ma8") - F.col(f"{a}_ma60"),
        "dispersion": X.centred_rank("__spread"),
    }
    for f in few[1:2]:
        cross |= {f"{f}_reversal5": F.col(f"__ma5_{f}") - F.col(f), f"{f}_z10": deviation(f, "__ma10", "__vol10"), "rank12": rank - F.col(f"{f}_rank"), "product12": rank * F.col(f"{f}_rank")}
    for f in few[2:]:
        cross |= {f"{f}_ma5rank": X.centred_rank(f"__ma5_{f}"), "rank13": rank - F.col(f"{f}_rank"), "core": _core(names)}
    first = "rank_lag1 rank_persist rank_reversal ma3 ma8 ma21 ma60 ew4 ew12 ew32 vol8 vol21 z8 z21 mom3vol mom5vol trend3_21 trend8_60 accel demean"
    own = dict(zip(few, (first, "reversal5 z10", "ma5rank")))
    order = [n for f in names for n in (f, f"{f}_rank", *((f"{f}_{k}" for k in f"lag1 lag2 lag3 d1 d3 d5 {own[f]}".split()) if f in few else ()))]
    return ordered(build(base, series, cross), panel, [*order, "rank12", "product12", "rank13", "core", "dispersion"])


def regimes(panel: DataFrame) -> DataFrame:
    """38 features: momentum over volatility, persistence and ranges of the first input, and its spread over assets."""
    names = inputs(panel)
    a, few = names[0], names[:3]
    base = _ranked_inputs(panel, {f"__ew_{f}": (f, 8, 3) for f in {a, *few[2:]}})
    series = {f"{f}_{n}": c for f in few for n, c in (("lag1", W.lag(f)), ("diff1", W.diff(f)))}
    series |= {f"{a}_lag3": W.lag(a, 3), f"{a}_diff3": W.diff(a, 3), "__d5": W.diff(a, 5), "__before": W.lag(f"{a}_rank"), f"{a}_accel": W.acceleration(a)}
    series |= {f"__ma{n}": W.roll_mean(a, n, least) for n, least in ((5, 2), (10, 3), (20, 4))} | {f"__vol{n}": W.roll_std(a, n, least) for n, least in ((10, 3), (20, 4))}
    series |= {f"{a}_range10": W.range_position(a, 10, 3), f"{a}_range20": W.range_position(a, 20, 4)}
    series |= {f"{f}_reversal5": W.roll_mean(f, 5, 2) - F.col(f) for f in few[1:2]} | {f"{f}_ewma_resid": F.col(f) - F.col(f"__ew_{f}") for f in few[2:]}
    rank, before = F.col(f"{a}_rank"), F.col("__before")
    cross = {
        f"{a}_mom3vol10": over(f"{a}_diff3", "__vol10"),
        f"{a}_mom5vol20": over("__d5", "__vol20"),
        f"{a}_rank_persist": rank * before,
        f"{a}_rank_turnover": F.abs(rank - before),
        f"{a}_ewma_resid": F.col(a) - F.col(f"__ew_{a}"),
        f"{a}_z10": deviation(a, "__ma10", "__vol10"),
        f"{a}_trend5_20": F.col("__ma5") - F.col("__ma20"),
        f"{a}_vol_ratio": over("__vol10", "__vol20"),
        "regime": X.dispersion(a),
    }
    for f in few[1:2]:
        cross["rank12"] = rank - F.col(f"{f}_rank")
    for f in few[2:]:
        cross |= {"rank13": rank - F.col(f"{f}_rank"), "core": _core(names)}
    first = "lag3 diff3 mom3vol10 mom5vol20 rank_persist rank_turnover ewma_resid z10 range10 range20 trend5_20 vol_ratio demean accel"
    own = dict(zip(few, (first, "reversal5", "ewma_resid")))
    order = [n for f in names for n in (f, f"{f}_rank", *((f"{f}_{k}" for k in f"lag1 diff1 {own[f]}".split()) if f in few else ()))]
    return ordered(build(base, series, cross), panel, [*order, "rank12", "rank13", "core", "regime"])


def moments(panel: DataFrame) -> DataFrame:
    """52 features: ranks of changes, momentum and reversal of every input, their pairs, and how far inputs disagree.

    Without a second to sixth input its part in pairs and proxies is 0.
    """
    names = inputs(panel)
    base = W.with_ewma(panel, {f"__{k}_{f}": (f, span, least) for f in names for k, span, least in (("fast", 4, 2), ("slow", 16, 4))})
    series = {f"__d1_{f}": W.diff(f) for f in names}
    base = base.select("*", *(c.alias(n) for n, c in series.items()))
    base = base.select("*", *(W.roll_std(f"__d1_{f}", 12, 3).alias(f"__v_{f}") for f in names))
    parts = {"rank": F.col, "d1": lambda f: F.col(f"__d1_{f}"), "rev": lambda f: F.col(f) - F.col(f"__fast_{f}"), "mom": lambda f: F.col(f"__fast_{f}") - F.col(f"__slow_{f}"), "vd1": lambda f: over(f"__d1_{f}", f"__v_{f}")}
    base = base.select("*", *(c(f).alias(f"__x_{k}_{f}") for f in names for k, c in parts.items()))
    base = base.select("*", *(X.centred_rank(f"__x_{k}_{f}").alias(f"{f}_{k}") for f in names for k in parts), *(X.median_demean(f).alias(f"{f}_demean") for f in names))
    at = lambda i, k: F.col(f"{names[i]}_{k}") if i < len(names) else F.lit(0.0)  # noqa: E731  an absent feature is 0
    mixed = {"proxy_rank1": at(0, "rank"), "proxy_rank2": at(1, "rank"), "proxy_rank3": at(2, "rank"), "proxy_mom": at(0, "mom"), "proxy_rev": at(0, "rev")}
    for i in (0, 2, 4):
        pair = f"{i + 1}{i + 2}"
        mixed |= {f"spread{pair}": at(i, "rank") - at(i + 1, "rank"), f"product{pair}": at(i, "rank") * at(i + 1, "rank"), f"mom{pair}": at(i, "mom") - at(i + 1, "mom")}
    mixed |= {f"__{k}disp": X.present_spread([F.col(f"{f}_{k}") for f in names]) for k in ("rev", "mom")}
    base = base.select("*", *(c.alias(n) for n, c in mixed.items()))
    base = base.select("*", X.centred_rank("__revdisp").alias("revdisp"), X.centred_rank("__momdisp").alias("momdisp"))
    order = [f"{f}_{k}" for f in names for k in ("rank", "d1", "rev", "mom", "vd1", "demean")]
    return ordered(base, panel, [*order, *(n for n in mixed if not n.startswith("__")), "revdisp", "momdisp"])


def broad(panel: DataFrame) -> DataFrame:
    """75 features: histories of all inputs, longer ones of the first three, and the first one's state over all assets."""
    names = inputs(panel)
    a, few = names[0], names[:3]
    base = W.with_ewma(panel, {f"{a}_ewma5": (a, 5, 2)}).select("*", *(X.centred_rank(f).alias(f"{f}_rank") for f in names), *(X.median_demean(f).alias(f"{f}_demean") for f in names), X.median(a).alias("__median"))
    series = {f"{f}_ma{n}": W.roll_mean(f, n, least) for f in names for n, least in ((5, 2), (20, 3))} | {f"{f}_sd20": F.coalesce(W.roll_std(f, 20, 3), F.lit(0.0)) for f in names}
    series |= {f"{'' if f == a else '__'}{f}_ma60": W.roll_mean(f, 60, 5) for f in few} | {f"{f}_diff{k}": W.diff(f, k) for f in names for k in ((1, 2, 5) if f in few else (1,))}
    series |= {f"{f}_rankchg": W.diff(f"{f}_rank") for f in few}
    cross = {f"{f}_product": F.col(f) * F.col(f"{f}_rank") for f in names}
    cross |= {f"{a}_ma{n}_rank": X.centred_rank(f"{a}_ma{n}") for n in (5, 20, 60)}
    for f in few:
        cross |= {f"{f}_roll_z": deviation(f, f"{f}_ma5", f"{f}_sd20"), f"{f}_voladj": over(f"{f}_diff1", f"{f}_sd20"), f"{f}_momspread": F.col(f"{f}_ma5") - F.col(f"{'' if f == a else '__'}{f}_ma60")}
    cross |= {"mean": X.mean(a), "std": X.dispersion(a), "above": X.above_median(a)}
    if len(names) >= 2:
        cross["rank12"] = F.col(f"{a}_rank") - F.col(f"{names[1]}_rank")
    order = []
    for f in names:
        order += [f, *(f"{f}_{k}" for k in "rank demean product ma5 ma20 sd20".split())]
        order += [f"{f}_{k}" for k in "ma60 ewma5 ma5_rank ma20_rank ma60_rank".split() if f == a]
        order += [f"{f}_{k}" for k in "diff1 diff2 diff5 roll_z voladj momspread rankchg".split()] if f in few else [f"{f}_diff1"]
    return ordered(build(base, series, cross).drop("__median"), panel, [*order, "mean", "std", "above", "rank12"])


SETS = {
    "compact": compact,
    "classic": classic,
    "ranked": ranked,
    "robust": robust,
    "horizons": horizons,
    "late": late,
    "changes": changes,
    "momenta": momenta,
    "four_ranks": four_ranks,
    "weighed_ranks": weighed_ranks,
    "agreement": agreement,
    "primary": primary,
    "paths": paths,
    "trails": trails,
    "regimes": regimes,
    "moments": moments,
    "broad": broad,
}


def feature_names(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in (*KEYS, "y", "y_next", "train", "n_times", "weight", "__median")]
