import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import windows as W


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(3)
    frame = pd.DataFrame([(p, t, f"a{i}", i) for p in range(2) for t in range(60) for i in range(7)], columns=["period", "t", "asset", "asset_ord"])
    frame["f1"] = np.round(rng.normal(size=len(frame)), 1)
    frame.loc[rng.random(len(frame)) < 0.15, "f1"] = np.nan
    frame.loc[(frame["t"] == 9), "f1"] = np.nan
    frame.loc[(frame["t"] == 11), "f1"] = 2.0
    return frame


@pytest.fixture(scope="module")
def table(spark, panel):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in panel.itertuples(index=False)]
    return spark.createDataFrame(rows, "period int, t int, asset string, asset_ord int, f1 double")


def values(frame, name="v"):
    out = frame.select("period", "t", "asset", name).toPandas().sort_values(["period", "t", "asset"])
    return out[name].to_numpy(float)


def expected(panel, function, by):
    panel = panel.sort_values(["period", "t", "asset"])
    return panel.groupby(by, sort=False)["f1"].transform(function).to_numpy(float)


@pytest.mark.parametrize(
    ("column", "function"),
    [
        (lambda: W.lag("f1", 2), lambda s: s.shift(2)),
        (lambda: W.diff("f1", 3), lambda s: s.diff(3)),
        (lambda: W.roll_mean("f1", 5, 2), lambda s: s.rolling(5, min_periods=2).mean()),
        (lambda: W.roll_std("f1", 20, 4), lambda s: s.rolling(20, min_periods=4).std(ddof=0)),
        (lambda: W.roll_min("f1", 10, 3), lambda s: s.rolling(10, min_periods=3).min()),
        (lambda: W.roll_max("f1", 10, 3), lambda s: s.rolling(10, min_periods=3).max()),
    ],
)
def test_series(table, panel, column, function):
    np.testing.assert_allclose(values(table.withColumn("v", column())), expected(panel, function, ["period", "asset"]), atol=1e-9)


@pytest.mark.parametrize(("span", "least"), [(3, 1), (5, 2), (8, 3), (21, 5)])
def test_ewma(table, panel, span, least):
    got = values(W.with_ewma(table, {"v": ("f1", span, least)}))
    np.testing.assert_allclose(got, expected(panel, lambda s: s.ewm(span=span, adjust=False, min_periods=least).mean(), ["period", "asset"]), atol=1e-12)


def test_ewma_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = pd.Series(rng.normal(size=3000))
    x[rng.random(3000) < 0.3] = np.nan
    rows = [(0, t, "a", None if np.isnan(v) else float(v)) for t, v in enumerate(x)]
    out = W.with_ewma(spark.createDataFrame(rows, "period int, t int, asset string, f1 double"), {"v": ("f1", 3, 1)}).orderBy("t").toPandas()["v"]
    np.testing.assert_allclose(out.to_numpy(float), x.ewm(span=3, adjust=False).mean().to_numpy(), atol=1e-12)


@pytest.mark.parametrize(
    ("column", "function"),
    [
        (lambda: X.average_rank("f1"), lambda s: s.rank(method="average")),
        (lambda: X.percent_rank("f1"), lambda s: s.rank(method="average", pct=True)),
        (lambda: X.centred_rank("f1"), lambda s: (s.rank() - (len(s) + 1) / 2) / (0.5 * max(len(s) - 1, 1))),
        (lambda: X.demean("f1"), lambda s: s - s.mean()),
        (lambda: X.median_demean("f1"), lambda s: s - s.median()),
        (lambda: X.dispersion("f1"), lambda s: s * 0 + s.std(ddof=0)),
    ],
)
def test_cross_sections(table, panel, column, function):
    got, want = values(table.withColumn("v", column())), expected(panel, function, ["period", "t"])
    shown = ~np.isnan(want)
    np.testing.assert_allclose(got[shown], want[shown], atol=1e-12)


def test_clean_numbers(spark):
    rows = [("1.5",), ("x",), ("NaN",), ("Infinity",), (None,), ("-2e3",)]
    got = [r["v"] for r in spark.createDataFrame(rows, "s string").select(W.clean("s").alias("v")).collect()]
    assert got == [1.5, None, None, None, None, -2000.0]


def test_correlation_without_variation_is_zero(spark):
    frame = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 4.0), (2, None, 1.0)], "g int, a double, b double")
    got = frame.groupBy("g").agg(*X.correlation_sums("a", "b")).select(X.correlation().alias("c"))
    assert [r["c"] for r in got.collect()] == [0.0, 0.0]
    assert F is not None
