"""Causal time-series expressions: per asset, over rows of a dense time grid.

All take and give columns, so Catalyst evaluates everything that shares a window in one
sort. Frames count rows; ``least`` counts non-null values, and where there are fewer the
result is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

EPS = 1e-6


def by_asset() -> WindowSpec:
    return Window.partitionBy("period", "asset").orderBy("t")


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """A number, or null for what isn't one: text, NaN and infinities."""
    x = column(x).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(column(x), k).over(by_asset())


def lead(x: Column | str, k: int = 1) -> Column:
    return F.lead(column(x), k).over(by_asset())


def diff(x: Column | str, k: int = 1) -> Column:
    return column(x) - lag(x, k)


def roll(function, x: Column | str, rows: int, least: int) -> Column:
    frame = by_asset().rowsBetween(1 - rows, 0)
    return F.when(F.count(column(x)).over(frame) >= least, function(column(x)).over(frame))


def roll_mean(x: Column | str, rows: int, least: int) -> Column:
    return roll(F.avg, x, rows, least)


def roll_std(x: Column | str, rows: int, least: int) -> Column:
    """Population standard deviation."""
    return roll(F.stddev_pop, x, rows, least)


def roll_min(x: Column | str, rows: int, least: int) -> Column:
    return roll(F.min, x, rows, least)


def roll_max(x: Column | str, rows: int, least: int) -> Column:
    return roll(F.max, x, rows, least)


def with_ewma(panel: DataFrame, wanted: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Adds exponentially weighted means, name: (column, span, least).

    The mean follows y = a * y_before + b * x at each value, where a gap of g rows decays
    like g more steps; rows without a value keep the mean. Unrolled, it is a running sum of
    b * x over the product of the a's, taken within blocks of rows so long that what
    lies before the block before weighs less than 1e-18. So it takes windows only, in time
    linear in the rows, and no number grows out of range.
    """
    w, before = by_asset(), by_asset().rowsBetween(Window.unboundedPreceding, -1)
    upto = by_asset().rowsBetween(Window.unboundedPreceding, 0)
    xs = {n: F.col(c) for n, (c, _, _) in wanted.items()}
    keep = {n: 1.0 - 2.0 / (span + 1.0) for n, (_, span, _) in wanted.items()}
    rows = {n: 2 * math.ceil(math.log(1e-18) / math.log(q)) for n, q in keep.items()}
    own = panel.columns
    panel = panel.select("*", *(F.last(F.when(x.isNotNull(), F.col("t")), True).over(before).alias(f"__t_{n}") for n, x in xs.items()))
    old = {n: F.pow(F.lit(q), (F.col("t") - F.col(f"__t_{n}")).cast("double")) for n, q in keep.items()}
    fresh = {n: xs[n].isNotNull() & F.col(f"__t_{n}").isNotNull() for n in xs}
    panel = panel.select(
        "*",
        *(F.floor(F.col("t") / rows[n]).alias(f"__block_{n}") for n in xs),
        *(F.when(fresh[n], F.log(old[n] / (old[n] + 1.0 - keep[n]))).otherwise(0.0).alias(f"__log_{n}") for n in xs),
        *(F.when(fresh[n], (1.0 - keep[n]) / (old[n] + 1.0 - keep[n]) * xs[n]).otherwise(F.coalesce(xs[n], F.lit(0.0))).alias(f"__add_{n}") for n in xs),
    )
    inside = {n: Window.partitionBy("period", "asset", f"__block_{n}").orderBy("t").rowsBetween(Window.unboundedPreceding, 0) for n in xs}
    panel = panel.select("*", *(F.sum(f"__log_{n}").over(inside[n]).alias(f"__sum_{n}") for n in xs))
    panel = panel.select("*", *(F.sum(F.exp(-F.col(f"__sum_{n}")) * F.col(f"__add_{n}")).over(inside[n]).alias(f"__run_{n}") for n in xs))
    ends = {n: F.when(F.col("t") % rows[n] == rows[n] - 1, F.exp(f"__sum_{n}") * F.col(f"__run_{n}")) for n in xs}
    carried = {n: F.coalesce(F.last(ends[n], True).over(before), F.lit(0.0)) for n in xs}
    made = [F.when(F.count(xs[n]).over(upto) >= max(1, least), F.exp(f"__sum_{n}") * (carried[n] + F.col(f"__run_{n}"))).alias(n) for n, (_, _, least) in wanted.items()]
    return panel.select(*own, *made)


def zscore(x: Column | str, mean: Column, std: Column) -> Column:
    return (column(x) - mean) / (std + EPS)


def range_position(x: Column | str, rows: int, least: int) -> Column:
    low, high = roll_min(x, rows, least), roll_max(x, rows, least)
    return (column(x) - low) / (high - low + EPS) - 0.5


def acceleration(x: Column | str) -> Column:
    return column(x) - 2 * lag(x, 1) + lag(x, 2)
