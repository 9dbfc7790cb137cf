"""Targets in every layout, matched with a panel."""

import pytest

from tessera.sources import panels

SCHEMA = "period int, time int, t int, asset string, asset_ord int, f1 double"
ROWS = [(0, 10 + t, t, a, i, 0.0) for t in range(3) for i, a in enumerate("AB")]


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def attached(panel, target):
    return {(r["t"], r["asset"]): r["y"] for r in panels.attach_target(panel, target).collect()}


WANT = {(0, "A"): -1.0, (0, "B"): 1.0, (1, "A"): 0.0, (1, "B"): None, (2, "A"): None, (2, "B"): None}


def test_layouts_give_the_same(spark, panel):
    layouts = [
        spark.createDataFrame([(10, "A", 1.0), (10, "B", 3.0), (11, "A", 5.0), (11, "B", None), (99, "A", 1.0), (10, "Z", 7.0)], "time int, asset string, value double"),
        spark.createDataFrame([(10, 1.0, 3.0, 9.0), (11, 5.0, float("inf"), 9.0)], "time int, A double, B double, Z double"),
        spark.createDataFrame([(10, 1.0, 3.0), (11, 5.0, None)], "time int, `target factor|A` double, `target factor|B` double"),
        spark.createDataFrame([(10, "1", "3", 8.0), (11, "5", "x", 8.0)], "time int, `A|Feature.1` string, `B|Feature.1` string, `A|Feature.2` double"),
        spark.createDataFrame([(0, 0, 1.0, 3.0), (0, 1, 5.0, None), (4, 0, 8.0, 8.0)], "period int, t int, A double, B double"),
        spark.createDataFrame([(10, "A", 1.0), (10, "A", 0.5), (10, "B", 3.0), (11, "A", 5.0)], "time int, asset string, value double"),
    ]
    for target in layouts:
        assert attached(panel, target) == WANT
    assert panels.attach_target(panel.withColumn("y", panel["f1"]), layouts[0]).columns == [*panel.columns, "y"]


def test_one_column_is_one_asset(spark, panel):
    got = attached(panel, spark.createDataFrame([(10, 4.0), (12, 6.0)], "time int, B double"))
    assert got == {k: 0.0 if k in ((0, "B"), (2, "B")) else None for k in WANT}


def test_what_cannot_be_a_target(spark, panel):
    for ddl in ("asset string, v double", "time int", "time int, asset string, v double, w double"):
        with pytest.raises(ValueError, match="target"):
            panels.attach_target(panel, spark.createDataFrame([], ddl))


def test_numeric_columns_by_schema(spark):
    frame = spark.createDataFrame([], "a int, b string, c double, d boolean, e date, f decimal(9,2), `g.h` long")
    assert panels.numeric(frame).columns == ["a", "c", "f", "g.h"]
