import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import common


def test_scratch_goes_with_its_consumer(spark):
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with common.scratch(spark):
        rows = common.materialize(spark.range(10), "tens")
        with common.scratch(spark):
            assert common.materialize(rows, "inner").count() == 10
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before
    kept = common.staged(spark, lambda: common.materialize(spark.range(5), "inner"), "outer")
    assert kept.count() == 5 and [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["outer"]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session())
    Context.master = "local[2]"
    assert common.shared_dir(Session()).startswith("file:///")


def test_without_decides_by_row(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "a")], "doc_id long, text string")
    gone = docs.where("text = 'a' and (doc_id = 1 or doc_id is null)").select("doc_id", common.row_key().alias("row_key"))
    assert sorted(((r[0], r[1]) for r in common.without(docs, gone).collect()), key=str) == [(1, "b"), (2, "a"), (None, None)]
    gone = docs.where("text is null").select("doc_id", common.row_key().alias("row_key"))
    assert common.without(docs, gone).where(F.col("text").isNull()).count() == 0
