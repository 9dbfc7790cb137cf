"""Metrics of predictions: frames with period, t, asset, asset_ord, pred and y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross as X

TINY = 1e-12


def safe_ratio(a: Column, b: Column, tiny: float = TINY) -> Column:
    return F.when(b > tiny, a / F.nullif(b, F.lit(0.0))).otherwise(0.0)


def sharpe(column: str = "ret") -> Column:
    """Mean over sample deviation; 0 without variation."""
    mean, std = F.avg(column), F.stddev_samp(column)
    return F.when(std > TINY, mean / F.nullif(std, F.lit(0.0))).otherwise(0.0)


def rows(frame: DataFrame, pred: str = "pred", keys: tuple[str, ...] = ("period", "t")) -> DataFrame:
    """Per timestamp: ret, ic, dispersion, concentration, compression, pred_scale, in one aggregation.

    ret: predictions against the next row's targets, over the sum of their sizes; null in
    a period's last row, which has no next one.
    """
    outer = [k for k in keys if k != "t"]
    p = F.col(pred)
    ranked = frame.select(
        *keys,
        p.alias("p"),
        "y",
        F.lead("y").over(Window.partitionBy(*outer, "asset").orderBy("t")).alias("ahead"),
        F.max("t").over(Window.partitionBy(*outer)).alias("last"),
        X.percent_rank(pred, keys).alias("rp"),
        X.percent_rank("y", keys).alias("ry"),
        F.tanh(p / F.greatest(F.stddev_pop(pred).over(Window.partitionBy(*keys)), F.lit(1e-6))).alias("squashed"),
    )
    size = F.sum(F.abs("p"))
    sums = ranked.groupBy(*keys).agg(
        F.first("last").alias("last"),
        F.coalesce(F.sum(F.col("p") * F.col("ahead")), F.lit(0.0)).alias("got"),
        size.alias("size"),
        *X.correlation_sums("rp", "ry", "_ic"),
        *X.correlation_sums("p", "squashed", "_tanh"),
        F.stddev_pop("y").alias("dispersion"),
        F.stddev_pop("p").alias("pred_scale"),
        (F.sum(F.col("p") * F.col("p")) / F.greatest(size * size, F.lit(1e-15))).alias("concentration"),
    )
    ret = F.when(F.col("t") < F.col("last"), safe_ratio(F.col("got"), F.col("size")))
    return sums.select(*keys, ret.alias("ret"), X.correlation("_ic").alias("ic"), X.correlation("_tanh").alias("compression"), "dispersion", "pred_scale", "concentration")


def statistics(frame: DataFrame, pred: str = "pred") -> DataFrame:
    """One row of metrics over all periods."""
    summed = rows(frame, pred).agg(
        sharpe().alias("sharpe"),
        F.countDistinct("period").alias("periods"),
        F.count(F.lit(1)).alias("observations"),
        F.avg("ic").alias("ic"),
        F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("ic_std"),
        F.avg("concentration").alias("concentration"),
        (F.avg("compression") - 1).alias("compression_loss"),
        *X.correlation_sums("ic", "dispersion", "_d"),
    )
    return summed.withColumn("ic_dispersion_corr", X.correlation("_d")).drop(*(f"{c}_d" for c in ("n", "sa", "sb", "saa", "sbb", "sab")))


def period_metrics(frame: DataFrame, pred: str = "pred") -> DataFrame:
    return rows(frame, pred).groupBy("period").agg(
        F.coalesce(F.avg("ret"), F.lit(0.0)).alias("return_mean"),
        F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("return_std"),
        sharpe().alias("sharpe"),
        F.avg("ic").alias("ic"),
        F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("ic_std"),
        F.avg("dispersion").alias("dispersion"),
        F.avg("concentration").alias("concentration"),
        F.avg("pred_scale").alias("pred_scale"),
        F.count(F.lit(1)).alias("rows"),
    )


def folds(frame: DataFrame, width: int = 7, pred: str = "pred") -> DataFrame:
    """Metrics of consecutive blocks of ``width`` periods."""
    numbered = frame.select("period").distinct().withColumn("fold", F.floor((F.dense_rank().over(Window.orderBy("period")) - 1) / width).cast("int"))
    return rows(frame, pred).join(numbered, "period").groupBy("fold").agg(
        F.min("period").alias("period_start"), F.max("period").alias("period_end"), sharpe().alias("sharpe"), F.avg("ic").alias("ic"), F.avg("concentration").alias("concentration")
    )


def feature_ic(frame: DataFrame, names: tuple[str, ...] = ("f1", "f2", "f3")) -> DataFrame:
    """Per period and feature: mean rank and linear correlation with the target."""
    long = frame.unpivot(["period", "t", "asset", "y"], list(names), "feature", "value")
    keys = ("period", "t", "feature")
    long = long.withColumn("__a", X.percent_rank("value", keys)).withColumn("__b", X.percent_rank("y", keys))
    sums = long.groupBy(*keys).agg(*X.correlation_sums("__a", "__b", "_r"), *X.correlation_sums("value", "y", "_l"))
    return sums.select(*keys, X.correlation("_r").alias("r"), X.correlation("_l").alias("l")).groupBy("period", "feature").agg(F.avg("r").alias("raw_ic"), F.avg("l").alias("linear_corr"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Period metrics of two models side by side with their differences."""
    left = a.select("period", *(F.col(c).alias(f"{c}_a") for c in a.columns if c != "period"))
    right = b.select("period", *(F.col(c).alias(f"{c}_b") for c in b.columns if c != "period"))
    joined = left.join(right, "period")
    return joined.select("*", (F.col("sharpe_b") - F.col("sharpe_a")).alias("sharpe_delta"), (F.col("ic_b") - F.col("ic_a")).alias("ic_delta"))


def prediction_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean, least and 10 % quantile of two models' correlation per timestamp."""
    pairs = a.select("period", "t", "asset", F.col("pred").alias("a")).join(b.select("period", "t", "asset", F.col("pred").alias("b")), ["period", "t", "asset"])
    rows = pairs.groupBy("period", "t").agg(*X.correlation_sums("a", "b")).select(X.correlation().alias("c"))
    return rows.agg(F.avg("c").alias("mean"), F.min("c").alias("least"), F.percentile("c", 0.1).alias("p10"))


def components(frame: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Metrics of each head of an ensemble, from the array column ``heads``."""
    heads = frame.select("period", "t", "asset", "y", F.posexplode("heads").alias("at", "value"))
    heads = heads.withColumn("component", F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1))
    return rows(heads, "value", ("component", "period", "t")).groupBy("component").agg(sharpe().alias("sharpe"), F.avg("ic").alias("ic"), F.avg("concentration").alias("concentration"))


def runs(frame: DataFrame, flag: str, over: str = "t", keys: tuple[str, ...] = ("period",)) -> DataFrame:
    """Runs of consecutive ``over`` within ``keys`` where ``flag`` holds: gaps and islands. One row per keys and ``over``."""
    held = frame.where(flag).select(*keys, over)
    island = F.col(over) - F.row_number().over(Window.partitionBy(*keys).orderBy(over))
    return held.withColumn("island", island).groupBy(*keys, "island").agg(F.min(over).alias("first"), F.max(over).alias("last"), F.count(F.lit(1)).alias("length")).drop("island")


def head_correlations(frame: DataFrame, heads: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, corr) of all pairs of the ``heads`` entries of one array column, from sums in one aggregation.

    Rows where an entry is missing don't count for its pairs; 0 where one doesn't vary.
    """
    pairs = [(i, j) for i in range(heads) for j in range(i + 1, heads)]
    sums = frame.groupBy(*keys).agg(*(c for i, j in pairs for c in X.correlation_sums(F.get("heads", F.lit(i)), F.get("heads", F.lit(j)), f"_{i}_{j}")))
    made = F.array(*(F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), X.correlation(f"_{i}_{j}").alias("corr")) for i, j in pairs))
    return sums.select(*keys, F.explode(made).alias("p")).select(*keys, "p.a", "p.b", "p.corr")
