"""Counters, the gauge option and models from files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import gauge
from tessera.plans import engine, loader, registry, walkforward
from tessera.sources import synthetic

KEYS = ["period", "t", "asset"]


@pytest.fixture(scope="module")
def panel(spark):
    short = synthetic.dataset(spark, 1, 11, 6).withColumn("period", F.lit(90))  # under ten training rows
    return synthetic.dataset(spark, 2, 50, 6).unionByName(short).cache()


@pytest.mark.parametrize("largest", [None, 1 << 40])
def test_counters_come_out_of_the_same_job(spark, panel, monkeypatch, largest):
    if largest:
        monkeypatch.setattr(engine, "sizes", lambda panel: (largest, 3))
    counters = walkforward.Counters()
    out = walkforward.walk_forward(panel, "v37", counters=counters)
    rows = out.collect()
    got = counters.get()
    assert (got["periods"], got["skipped"], got["rows"], got["unfitted_rows"]) == (3, 1, len(rows), 0) and len(rows) == 2 * 10 * 6
    assert got["fit_seconds"] > 0 and got["predict_seconds"] > 0
    by_period = {r["period"]: r for r in walkforward.timings(walkforward.walk_forward(panel, "v37")).collect()}
    assert set(by_period) == {0, 1} and all(r["fit_seconds"] > 0 and r["rows"] == 60 and r["used"] == 29 for r in by_period.values())


def test_unfitted_periods_are_counted(spark, panel):
    counters = walkforward.Counters()
    empty = panel.withColumn("y", F.when(F.col("period") == 0, None).otherwise(F.col("y")))
    assert walkforward.walk_forward(empty, "v37", counters=counters).where("period = 0 and pred <> 0").count() == 0
    assert counters.get()["unfitted_rows"] == 60


def test_evaluation_takes_counters_and_gauge(spark, panel):
    counters = walkforward.Counters()
    plain = walkforward.evaluate(panel, "v37", counters=counters).first()
    turned = walkforward.evaluate(panel, "v37", gauge=True).first()
    assert counters.get()["skipped"] == 1 and abs(plain["ic"] - turned["ic"]) < 0.2
    want = gauge.gauge_fix(walkforward.walk_forward(panel, "v37")).select(*KEYS, F.col("pred").alias("p"))
    both = walkforward.walk_forward(panel, "v37", gauge=True).join(want, KEYS)
    assert both.where("abs(pred - p) < 1e-12").count() == 120


OWN = """
import pandas as pd
from tessera.plans.loader import Predictor


class Helper:
    def predict(self, features):
        raise RuntimeError("isn't a model")


class Aardvark:
    def train(self, features, target):
        raise RuntimeError("a derived class comes first")

    predict = train


class Mine(Predictor):
    def train(self, features, target):
        assert features.columns.names == ["feature", "asset"] and list(features["f1"].columns) == sorted(target.columns, key=list(features["f1"].columns).index)
        if len(features) == 32:
            raise ValueError("this period is refused")
        self.scale = float(target.stack().std())
        return self

    def predict(self, features):
        return features["f1"] * self.scale
"""


def test_a_model_file_runs_per_period(spark, tmp_path):
    file = tmp_path / "own_model.py"
    file.write_text(OWN)
    panel = synthetic.dataset(spark, 2, 50, 6).unionByName(synthetic.dataset(spark, 1, 40, 6).withColumn("period", F.lit(7)))
    registry.register("from a file", loader.runner(file))
    out = registry.run(panel, "from a file").toPandas()
    assert len(out) == (2 * 10 + 8) * 6 and set(out.loc[out["failed"].notna(), "period"]) == {7} and (out.loc[out["period"] == 7, "pred"] == 0).all()
    rows = walkforward.split(panel).toPandas()
    for period in (0, 1):
        part = rows[rows["period"] == period]
        scale = part.loc[part["train"], "y"].std()
        want = part[~part["train"]].set_index(["t", "asset"])["f1"] * scale
        want = want - want.groupby("t").transform("mean")
        got = out[out["period"] == period].set_index(["t", "asset"])["pred"]
        np.testing.assert_allclose(got.sort_index(), want.sort_index(), atol=1e-9)
    assert isinstance(out, pd.DataFrame)


def test_files_without_a_model_are_refused(spark, tmp_path):
    file = tmp_path / "nothing.py"
    file.write_text("class Half:\n    def train(self, x, y):\n        pass\n")
    with pytest.raises(TypeError, match="no class"):
        loader.walk_forward(synthetic.dataset(spark, 1, 20, 3), file)
    with pytest.raises(FileNotFoundError):
        loader.walk_forward(synthetic.dataset(spark, 1, 20, 3), tmp_path / "absent.py")


def test_a_hot_period_is_spread_over_tasks(spark):
    """A period with most rows: no task of the features has twice the rows of the median one."""
    from tessera.plans import features

    hot = spark.range(60 * 400).select(F.lit(1).alias("period"), (F.col("id") / 60).cast("int").alias("t"), (F.col("id") % 60).cast("string").alias("asset"), (F.col("id") % 60).cast("int").alias("asset_ord"))
    rest = spark.range(60 * 40).select(F.lit(2).alias("period"), (F.col("id") / 60).cast("int").alias("t"), (F.col("id") % 60).cast("string").alias("asset"), (F.col("id") % 60).cast("int").alias("asset_ord"))
    panel = hot.unionByName(rest).withColumn("y", F.rand(1)).select("*", *(F.rand(i).alias(f"f{i}") for i in (2, 3, 4))).withColumnsRenamed({"f4": "f1"})
    made = features.compact(walkforward.split(panel))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        every = F.sum(F.xxhash64(*made.columns).cast("decimal(38,0)"))  # or no window would be needed
        rows = sorted(r["n"] for r in made.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n"), every).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 4 and rows[-1] < 2 * rows[len(rows) // 2] and sum(rows) == 26_400
