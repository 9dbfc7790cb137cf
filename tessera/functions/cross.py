"""Cross-sectional expressions: over the assets of one timestamp.

Ranks are average ranks with nulls kept null. ``centred_rank`` divides by the number of
all assets, missing ones included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tessera.functions.windows import EPS, column


def by_time() -> WindowSpec:
    return Window.partitionBy("period", "t")


def average_rank(x: Column | str, over: tuple[str, ...] = ("period", "t")) -> Column:
    """Ties share the mean of their ranks; built-in ranks have no such form.

    Rank and ties (a range frame of the current value) share one sort.
    """
    x = column(x)
    w = Window.partitionBy(*over).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def centred_rank(x: Column | str) -> Column:
    """Average rank mapped to [-1, 1] by the number of all assets."""
    n = F.count(F.lit(1)).over(by_time())
    return (average_rank(x) - (n + 1) / 2) / (0.5 * F.greatest(n - 1, F.lit(1)))


def percent_rank(x: Column | str, over: tuple[str, ...] = ("period", "t")) -> Column:
    """Average rank over the number of values."""
    return average_rank(x, over) / F.count(column(x)).over(Window.partitionBy(*over))


def ordinal_rank(x: Column | str, tie: str = "asset_ord") -> Column:
    """Rank in [-1, 1] without ties: equal values go by ``tie``."""
    n = F.count(F.lit(1)).over(by_time())
    return 2.0 * (F.row_number().over(by_time().orderBy(column(x), F.col(tie))) - 1) / F.greatest(n - 1, F.lit(1)) - 1.0


def mean(x: Column | str) -> Column:
    return F.avg(column(x)).over(by_time())


def demean(x: Column | str) -> Column:
    return column(x) - mean(x)


def median(x: Column | str) -> Column:
    return F.median(column(x)).over(by_time())


def median_demean(x: Column | str) -> Column:
    return column(x) - median(x)


def dispersion(x: Column | str) -> Column:
    return F.stddev_pop(column(x)).over(by_time())


def clip(x: Column | str, low, high) -> Column:
    """Null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(column(x).isNotNull(), F.least(F.greatest(column(x), low), high))


def above_median(x: Column | str) -> Column:
    """Share of all assets above the median; missing values count as not above."""
    return F.avg(F.coalesce(column(x) > F.col("__median"), F.lit(False)).cast("double")).over(by_time())


def over_deviation(deviation: Column | str, absolute_median: Column | str, limit: float) -> Column:
    """Robust z-score of a deviation from the median; a spread of zero gives null."""
    return clip(column(deviation) / (1.4826 * F.nullif(column(absolute_median), F.lit(0.0)) + EPS), -limit, limit)


def row_mean(xs: list[Column]) -> Column:
    """Null if any is null."""
    return reduce(lambda a, b: a + b, xs) / len(xs)


def row_spread(xs: list[Column]) -> Column:
    m = row_mean(xs)
    square = row_mean([x * x for x in xs])
    return F.when(m.isNotNull(), F.sqrt(F.greatest(square - m * m, F.lit(0.0))))


def present(xs: list[Column]) -> Column:
    return F.filter(F.array(*xs), lambda x: x.isNotNull())


def present_mean(xs: list[Column]) -> Column:
    """Mean of those that aren't null."""
    some = present(xs)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


def present_spread(xs: list[Column]) -> Column:
    """Population deviation of those that aren't null."""
    some, m = present(xs), present_mean(xs)
    return F.when(F.size(some) > 0, F.sqrt(F.aggregate(some, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(some)))


def present_range(xs: list[Column]) -> Column:
    return F.array_max(present(xs)) - F.array_min(present(xs))


def correlation_sums(a: Column | str, b: Column | str, suffix: str = "") -> list[Column]:
    """Aggregates that correlation() needs, over pairs without nulls."""
    a, b = column(a), column(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return [F.count(a).alias(f"n{suffix}"), F.sum(a).alias(f"sa{suffix}"), F.sum(b).alias(f"sb{suffix}"), F.sum(a * a).alias(f"saa{suffix}"), F.sum(b * b).alias(f"sbb{suffix}"), F.sum(a * b).alias(f"sab{suffix}")]


def correlation(suffix: str = "") -> Column:
    """Pearson's correlation from correlation_sums(); 0 where a side doesn't vary."""
    n, sa, sb, saa, sbb, sab = (F.col(f"{c}{suffix}") for c in ("n", "sa", "sb", "saa", "sbb", "sab"))
    va, vb = F.greatest(saa - sa * sa / F.nullif(n, F.lit(0)), F.lit(0.0)), F.greatest(sbb - sb * sb / F.nullif(n, F.lit(0)), F.lit(0.0))
    scale = F.sqrt(va * vb)
    return F.when(scale > 1e-12, (sab - sa * sb / F.nullif(n, F.lit(0))) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)


def window_correlation(a: Column | str, b: Column | str) -> Column:
    """The same per timestamp, for every row. Values are centred first."""
    a, b = column(a), column(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    w = by_time()
    ma, mb, n = F.avg(a).over(w), F.avg(b).over(w), F.count(a).over(w)
    va, vb = F.avg(a * a).over(w) - ma * ma, F.avg(b * b).over(w) - mb * mb
    scale = F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))
    return F.when((n > 0) & (scale > 1e-12), (F.avg(a * b).over(w) - ma * mb) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)
