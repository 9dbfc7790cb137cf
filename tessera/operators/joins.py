"""Joins of panels on their keys. Catalyst picks the strategy; nothing is forced to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["period", "t", "asset"]


def align(x: DataFrame, y: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows that both have."""
    return x.join(y, on or KEYS, "inner")


def reindex(facts: DataFrame, grid: DataFrame, on: list[str] | None = None) -> DataFrame:
    """A row for each of ``grid``, with nulls where there is no fact."""
    return grid.join(facts, on or KEYS, "left")


def members(frame: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``chosen``."""
    return frame.join(chosen, on, "left_semi")


def merge(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner join; columns that both have get suffixes."""
    both = (set(a.columns) & set(b.columns)) - set(on)
    left = a.select(*on, *(F.col(c).alias(c + suffixes[0] if c in both else c) for c in a.columns if c not in on))
    right = b.select(*on, *(F.col(c).alias(c + suffixes[1] if c in both else c) for c in b.columns if c not in on))
    return left.join(right, on, "inner")
