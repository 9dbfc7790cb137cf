"""Walk-forward evaluation: train on a period's beginning, predict its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.operators import gauge as gauges
from tessera.plans import engine, finish, metrics
from tessera.plans.models import MODELS


class Counters:
    """Seconds and failures of an evaluation, observed in the job that makes its result: nothing runs twice for them.

    Given to walk_forward() or evaluate(); get() holds once the result has been computed.
    """

    def __init__(self) -> None:
        self.split, self.out = Observation(), Observation()

    def get(self) -> dict[str, float]:
        """periods, skipped (too short to be split), rows, unfitted_rows (no usable feature or too few rows), fit_seconds, predict_seconds."""
        found = self.split.get | self.out.get
        return {k: 0 if v is None else v for k, v in found.items()}


#: Rows that are sent to all executors at most.
MOST_BROADCAST = 1_000_000


def split(panel: DataFrame, fraction: float = 0.20, most: int = 800, least_train: int = 10, counters: Counters | None = None, periods: int | None = None) -> DataFrame:
    """Adds ``train``; periods with under ``least_train`` training rows go.

    A row for each period is broadcast to the panel if their number, counted if it isn't given, allows it. Rows then stay where
    they are, and windows over (period, asset) and (period, t) spread a period with most rows over all tasks.

    The last max(2, min(most, ceil(fraction * n))) timestamps of a period are for validation.
    """
    # a row per period, joined back: windows over whole periods would put each into one task
    sizes = panel.groupBy("period").agg((F.max("t") + 1).alias("n_times"))
    valid = F.greatest(F.lit(2), F.least(F.lit(most), F.ceil(F.col("n_times") * fraction)))
    sizes = sizes.select("period", (F.col("n_times") - valid).alias("cut"))
    if counters is not None:
        sizes = sizes.observe(counters.split, F.count(F.lit(1)).alias("periods"), F.count(F.when(F.col("cut") < least_train, 1)).alias("skipped"))
    sizes = sizes.where(F.col("cut") >= least_train)
    periods = panel.select("period").distinct().count() if periods is None else periods
    sizes = F.broadcast(sizes) if periods <= MOST_BROADCAST else sizes
    return panel.join(sizes, "period").withColumn("train", F.col("t") < F.col("cut")).drop("cut")


def shape_safe(frame: DataFrame) -> DataFrame:
    """Missing predictions to 0, timestamps de-meaned."""
    frame = frame.withColumn("pred", F.coalesce(F.when(F.abs("pred") < float("inf"), F.col("pred")), F.lit(0.0)))
    return frame.withColumn("pred", F.col("pred") - X.mean("pred"))


def walk_forward(panel: DataFrame, model: engine.Model | str, *, gauge: bool = False, counters: Counters | None = None, **options) -> DataFrame:
    """(period, t, asset, asset_ord, y, pred, raw, heads) of the validation rows.

    Validation rows see the history before them: features are causal and computed over the
    whole period, of which models only see training rows. ``gauge`` takes predictions through a random rotation
    and back at each timestamp (then raw and heads go); ``counters`` are filled by the job.
    """
    model = MODELS[model] if isinstance(model, str) else model
    most, periods = engine.sizes(panel)
    parts = split(panel, counters=counters, periods=periods, **options)
    out = engine.predict(model, parts, most)
    if counters is not None:
        out = out.observe(counters.out, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("used") == 0, 1)).alias("unfitted_rows"), F.sum("fit_seconds").alias("fit_seconds"), F.sum("predict_seconds").alias("predict_seconds"))
    out = shape_safe(finish.finish(out, model.finish, model.transport))
    return gauges.gauge_fix(out) if gauge else out


def timings(out: DataFrame) -> DataFrame:
    """(period, rows, used, fit_seconds, predict_seconds) of predictions that walk_forward() or engine.predict() gave."""
    return out.groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.max("used").alias("used"), F.sum("fit_seconds").alias("fit_seconds"), F.sum("predict_seconds").alias("predict_seconds"))


def evaluate(panel: DataFrame, model: engine.Model | str, **options) -> DataFrame:
    return metrics.statistics(walk_forward(panel, model, **options))
