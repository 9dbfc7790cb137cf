import pytest
from oracle import compare

from tessera import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_the_sql(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.SQL[name])


def test_registry_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/", 2)[0]).stdout) > 80


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_models_read_the_tables_once(spark):
    """Models read the panel in many jobs, which must not go back to lineitem each time."""
    from tessera import queries

    frame = queries.QUERIES["model_v06"](spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in name for name in frame.inputFiles())
    assert frame.count() > 0
