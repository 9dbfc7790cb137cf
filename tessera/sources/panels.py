"""Panels: the canonical long table (period, time, t, asset, asset_ord, f1.., y).

Time is positional: ``t`` numbers a period's timestamps from 0, and the grid has a row for
every timestamp and asset, with nulls where there is no value. Features are made from
exact integer sums and one division, so that any engine gets the same doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.functions.windows import clean

KEYS = ["period", "t", "asset"]


def cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def whole(x: str) -> Column:
    return F.round(F.col(x)).cast("long")


def mean_of(total: Column) -> Column:
    return F.sum(total).cast("double") / F.count(F.lit(1))


def densify(cells: DataFrame, times: DataFrame, assets: DataFrame) -> DataFrame:
    """A row for every timestamp and asset. ``assets`` is the dimension, which is small."""
    grid = times.crossJoin(F.broadcast(assets))
    return grid.join(cells, ["period", "time", "asset"], "left")


def number_times(times: DataFrame) -> DataFrame:
    """Adds t, the position of each (period, time) in its period."""
    return times.withColumn("t", (F.dense_rank().over(Window.partitionBy("period").orderBy("time")) - 1).cast("int"))


def trade_panel(spark: SparkSession, sf_dir: str, hold: Callable[[DataFrame], DataFrame] = lambda cells: cells) -> DataFrame:
    """Weeks by supplier nation, a period a year, from lineitem.

    ``hold`` may write the cells, a row for each week and nation, where many steps read the panel.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line, supplier, nation = read("lineitem"), read("supplier"), read("nation")
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"])
    time = F.date_trunc("week", "l_shipdate")
    revenue = cents("l_extendedprice") * (100 - cents("l_discount"))
    cells = rows.groupBy(F.year(time).alias("period"), time.cast("timestamp").alias("time"), F.col("n_name").alias("asset")).agg(
        mean_of(cents("l_extendedprice")).alias("f1"),
        mean_of(whole("l_quantity")).alias("f2"),
        mean_of(cents("l_discount")).alias("f3"),
        mean_of(cents("l_tax")).alias("f4"),
        F.count(F.lit(1)).cast("double").alias("f5"),
        (F.sum(revenue).cast("double") / 10000).alias("f6"),
    )
    cells = hold(cells)
    times = number_times(cells.select("period", "time").distinct())
    return densify(cells, times, nation.select(F.col("n_name").alias("asset"), F.col("n_nationkey").cast("int").alias("asset_ord")))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours by event type, a period a week, from events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("time"), F.col("event_type").alias("asset")).agg(
        mean_of(cents("value")).alias("f1"), F.count(F.lit(1)).cast("double").alias("f2"), F.max(cents("value")).cast("double").alias("f3"), F.countDistinct("user_id").cast("double").alias("f4")
    )
    cells = cells.withColumn("period", F.floor((F.dayofmonth("time") - 1) / 7).cast("int"))
    times = number_times(cells.select("period", "time").distinct())
    names = events.select(F.col("event_type").alias("asset")).distinct()
    assets = names.withColumn("asset_ord", (F.row_number().over(Window.orderBy("asset")) - 1).cast("int"))
    return densify(cells, times, assets)


def with_target(panel: DataFrame, feature: str = "f1") -> DataFrame:
    """Adds y: the de-meaned change of a feature."""
    change = F.col(feature) - F.lag(feature).over(Window.partitionBy("period", "asset").orderBy("t"))
    panel = panel.withColumn("y", change)
    return panel.withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy("period", "t")))


def from_wide(wide: DataFrame, time: str = "time", separator: str = "|", period: int = 0) -> DataFrame:
    """A long panel of a wide one.

    Columns are named ``feature|asset`` in either order, or by asset alone (one feature).
    Of repeated assets the first stays. Values that aren't finite numbers become null.
    """
    names = [c for c in wide.columns if c != time]
    pairs = [tuple(c.split(separator, 1)) if separator in c else (None, c) for c in names]
    feature_at = infer_levels(pairs)
    found: dict[tuple[str, str], str] = {}
    for name, pair in zip(names, pairs):
        feature, asset = ("Feature.1", pair[1]) if pair[0] is None else (pair[feature_at], pair[1 - feature_at])
        found.setdefault((feature, asset), name)
    features = list(dict.fromkeys(f for f, _ in found))
    assets = list(dict.fromkeys(a for _, a in found))
    cells = []
    for place, asset in enumerate(assets):
        values = [clean(F.col(f"`{found[f, asset]}`")).alias(f"f{i}") if (f, asset) in found else F.lit(None).cast("double").alias(f"f{i}") for i, f in enumerate(features, 1)]
        cells.append(F.struct(F.lit(asset).alias("asset"), F.lit(place).alias("asset_ord"), *values))
    # only the distinct times are numbered in one place, not the rows
    times = number_times(wide.select(F.lit(period).alias("period"), F.col(time).alias("time")).distinct())
    rows = wide.withColumn("__time", F.col(time)).join(times, F.col("__time").eqNullSafe(times["time"])) if time != "time" else wide.join(times.withColumnRenamed("time", "__time"), F.col("time").eqNullSafe(F.col("__time")))
    rows = rows.select("period", F.col("__time").alias("time"), "t", F.explode(F.array(*cells)).alias("c"))
    return rows.select("period", "time", "t", "c.*")


def infer_levels(pairs: list[tuple]) -> int:
    """Which place of (a, b) column names holds the feature.

    The place whose names speak of features or factors; else the one with fewer distinct
    names; else the first.
    """
    pairs = [p for p in pairs if p[0] is not None]
    if not pairs:
        return 0
    names = [{p[i] for p in pairs} for i in (0, 1)]
    speaks = [all(any(w in n.lower() for w in ("feature", "factor")) for n in own) for own in names]
    if speaks[0] != speaks[1]:
        return 0 if speaks[0] else 1
    return 0 if len(names[0]) <= len(names[1]) else 1


def to_wide(panel: DataFrame, value: str, assets: list[str]) -> DataFrame:
    """Time by asset; the given assets, so that Spark needn't look for them. Missing cells are 0."""
    wide = panel.groupBy("period", "t").pivot("asset", assets).agg(F.first(value))
    return wide.select("period", "t", *(F.coalesce(F.col(f"`{a}`"), F.lit(0.0)).alias(a) for a in assets))


def melt(panel: DataFrame, columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return panel.unpivot([c for c in panel.columns if c not in columns], columns, name, value)


def numeric(frame: DataFrame) -> DataFrame:
    """The columns of ``frame`` that hold numbers, by its schema; booleans and dates aren't numbers."""
    return frame.select(*(F.col(f"`{f.name}`") for f in frame.schema if isinstance(f.dataType, NumericType)))


def long_target(target: DataFrame, key: str, separator: str = "|") -> DataFrame:
    """(key, period if it has one, asset, y) of a target in any layout, which its columns tell.

    A column ``asset`` and one of values: long already. ``level|asset`` in either order: the asset's level is
    kept, and of repeated assets the first. Else a column for each asset, so that one column alone is one asset.
    What isn't a finite number is null; of rows that repeat a key and asset the largest value counts.
    """
    on = [c for c in ("period", key) if c in target.columns]
    names = [c for c in target.columns if c not in on]
    if "asset" in names:
        values = [c for c in names if c != "asset"]
        if len(values) != 1:
            raise ValueError(f"a long target has one column of values, not {values}")
        rows = target.select(*on, F.col("asset").cast("string").alias("asset"), clean(F.col(f"`{values[0]}`")).alias("y"))
    else:
        if not names:
            raise ValueError("a target needs a column of values")
        pairs = [tuple(c.split(separator, 1)) if separator in c else (None, c) for c in names]
        level = infer_levels(pairs)
        found: dict[str, str] = {}
        for name, pair in zip(names, pairs):
            found.setdefault(pair[1] if pair[0] is None else pair[1 - level], name)
        cells = [F.struct(F.lit(a).alias("asset"), clean(F.col(f"`{c}`")).alias("y")) for a, c in found.items()]
        rows = target.select(*on, F.explode(F.array(*cells)).alias("c")).select(*on, "c.asset", "c.y")
    return rows.groupBy(*on, "asset").agg(F.max("y").alias("y"))


def attach_target(panel: DataFrame, target: DataFrame, separator: str = "|") -> DataFrame:
    """``panel`` with y from ``target``, matched by time (or t) and asset, and de-meaned over the assets that have one.

    Assets and times of the target that the panel doesn't have are left out; those that it alone has get null.
    """
    key = next((c for c in ("time", "t") if c in target.columns), None)
    if key is None:
        raise ValueError("a target needs a column time or t")
    rows = long_target(target, key, separator)
    joined = panel.drop("y").join(rows, [c for c in rows.columns if c != "y"], "left")
    joined = joined.withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy("period", "t")))
    return joined.select(*(c for c in panel.columns if c != "y"), "y")
