"""Reading and writing results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(frame: DataFrame, path: str) -> None:
    """For results of a few rows: one file with a header."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(frame: DataFrame, path: str) -> None:
    """One JSON document per row."""
    frame.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def as_json(frame: DataFrame, indent: int = 2, most: int = 1_000_000) -> str:
    """The rows of a small result (statistics, folds, period metrics) as text. More than ``most`` rows raise: they are for write_json()."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write_json() has no limit")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=indent, default=str)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def report(frame: DataFrame, rows: int = 20) -> str:
    """The console form of a small result."""
    return frame._show_string(rows, False) if hasattr(frame, "_show_string") else "\n".join(map(str, frame.limit(rows).collect()))
