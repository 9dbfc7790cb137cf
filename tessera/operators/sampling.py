"""Samples by position and chronological splits, all as predicates on positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail(panel: DataFrame, rows: int) -> DataFrame:
    """A period's last ``rows`` timestamps."""
    return panel.withColumn("__last", F.max("t").over(Window.partitionBy("period"))).where(F.col("t") > F.col("__last") - rows).drop("__last")


def bridge(train: DataFrame, new: DataFrame, rows: int) -> DataFrame:
    """New rows with the tail of the history before them; ``is_new`` tells them apart after windows."""
    return tail(train, rows).withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))


def even(pos: Column, start: Column, older: Column) -> Column:
    """Is ``pos`` one of ``older`` evenly spaced integers from 0 to start - 1 (truncated)?

    Those are trunc(i * (start - 1) / (older - 1)); the i that could give ``pos`` is looked up.
    """
    span, steps = (start - 1).cast("double"), F.greatest(older - 1, F.lit(1)).cast("double")
    i = F.ceil(pos * steps / F.greatest(span, F.lit(1.0)) - 1e-9)
    near = [F.floor(F.greatest(i + k, F.lit(0)) * span / steps) for k in (-1, 0, 1)]
    inside = [(i + k >= 0) & (i + k < older) & (n == pos) for k, n in zip((-1, 0, 1), near)]
    return (pos < start) & (older > 0) & (inside[0] | inside[1] | inside[2])


def place_times(panel: DataFrame) -> DataFrame:
    """A row per (period, t) of ``panel``: its rows, its place among the period's timestamps, the rows before it, and both totals.

    Everything about positions comes from this table of timestamps, so that no task sees a whole period.
    """
    w = Window.partitionBy("period")
    before = w.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return panel.groupBy("period", "t").agg(F.count(F.lit(1)).alias("__n")).select(
        "period",
        "t",
        "__n",
        (F.row_number().over(w.orderBy("t")) - 1).alias("__place"),
        F.count(F.lit(1)).over(w).alias("__places"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(w).alias("__rows"),
        F.floor(F.median("__n").over(w)).alias("__typical"),
    )


def by_rows(panel: DataFrame, budget: int, recent: float, positions: bool = False) -> DataFrame:
    """Per period the latest rows (time-major), and an even selection of older ones.

    ``positions`` adds position and total, of the row among all rows of the period.
    """
    order = Window.partitionBy("period", "t").orderBy("asset_ord")
    frame = panel.join(place_times(panel), ["period", "t"]).withColumn("position", F.col("__before") + F.row_number().over(order) - 1)
    late = max(1, int(budget * recent))
    start = F.col("__rows") - late
    keep = (F.col("__rows") <= budget) | (F.col("position") >= start) | even(F.col("position"), start, F.lit(budget - late))
    frame = frame.where(keep).withColumn("total", F.col("__rows"))
    return frame.select(*panel.columns, *(["position", "total"] if positions else []))


def even_rows(panel: DataFrame, most: int, positions: bool = False) -> DataFrame:
    """At most ``most`` rows of a period, evenly placed in time-major order: a bound before statistics.

    ``positions`` adds position and total, of the row among all rows of the period.
    """
    order = Window.partitionBy("period", "t").orderBy("asset_ord")
    frame = panel.join(place_times(panel), ["period", "t"]).withColumn("position", F.col("__before") + F.row_number().over(order) - 1)
    frame = frame.where((F.col("__rows") <= most) | even(F.col("position"), F.col("__rows"), F.lit(most))).withColumn("total", F.col("__rows"))
    return frame.select(*panel.columns, *(["position", "total"] if positions else []))


def by_times(panel: DataFrame, budget: int, recent: float, positions: bool = False) -> DataFrame:
    """Whole timestamps: as many as the median number of rows of one fits into the budget.

    ``positions`` adds position and total, of the timestamp among all of the period.
    """
    times = place_times(panel).withColumn("__budget", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("__typical")))).cast("int"))
    late = F.greatest(F.lit(1), F.floor(F.col("__budget") * recent)).cast("int")
    start = F.col("__places") - late
    keep = (F.col("__places") <= F.col("__budget")) | (F.col("__place") >= start) | even(F.col("__place"), start, F.col("__budget") - late)
    times = times.where(keep).select("period", "t", F.col("__place").alias("position"), F.col("__places").alias("total"))
    return panel.join(times, ["period", "t"]).select(*panel.columns, *(["position", "total"] if positions else []))


def blocks(panel: DataFrame, cuts: tuple[float, ...]) -> DataFrame:
    """Chronological blocks of a period at the given shares of its timestamps."""
    n = F.max("t").over(Window.partitionBy("period")) + 1
    frame = panel.withColumn("__n", n)
    block = F.lit(0)
    for cut in cuts:
        block = block + (F.col("t") >= F.floor(F.col("__n") * cut)).cast("int")
    return frame.withColumn("block", block).drop("__n")
