"""Random rotations of predictions and distance from random directions.

Random numbers come from NumPy generators seeded per period and timestamp, so that each
timestamp is a task's group of its own, made anywhere and in any order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotations(rows: int, assets: int, seed: int) -> np.ndarray:
    """Per row an orthonormal basis of the space without the common direction."""
    rng = np.random.default_rng(seed)
    common = np.full((assets, 1), 1 / math.sqrt(assets))
    out = np.empty((rows, assets - 1, assets))
    for row in range(rows):
        drawn = rng.standard_normal((assets, assets - 1))
        out[row] = np.linalg.qr(drawn - common @ (common.T @ drawn))[0].T
    return out


def gauge_fix(frame: DataFrame, seed: int = 314159) -> DataFrame:
    """Rotates each timestamp's predictions, de-means there, and rotates back."""
    schema = "period int, t int, asset string, asset_ord int, y double, pred double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("asset_ord", kind="stable").reset_index(drop=True)
        if len(group) < 2:
            return group.assign(pred=0.0)
        # SeedSequence takes whole numbers from 0
        own = np.random.SeedSequence([seed, *(int(group[k].iloc[0]) + (1 << 31) for k in ("period", "t"))]).generate_state(1)[0]
        basis = rotations(1, len(group), int(own))[0]
        turned = np.nan_to_num(basis @ np.nan_to_num(group["pred"].to_numpy(float)))
        back = basis.T @ (turned - turned.mean())
        return group.assign(pred=back - back.mean())

    return frame.select("period", "t", "asset", "asset_ord", "y", "pred").groupBy("period", "t").applyInPandas(run, schema)


def novelty(frame: DataFrame, directions: int = 12, seed: int = 271828) -> DataFrame:
    """(angle, nearest): the smallest angle in degrees between all predictions and random directions.

    Each timestamp adds its sums per direction; nothing but those sums is brought together.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = [int(group[k].iloc[0]) + (1 << 31) for k in ("period", "t")]
        p = group.sort_values("asset_ord", kind="stable")["pred"].to_numpy(float)
        p = p[np.isfinite(p)]
        rows = []
        for d in range(directions):
            c = np.random.default_rng([seed, d, *own]).standard_normal(len(p))
            rows.append((d, float(len(p)), p.sum(), c.sum(), p @ p, c @ c, p @ c))
        return pd.DataFrame(rows, columns=["d", "n", "sa", "sb", "saa", "sbb", "sab"])

    sums = frame.groupBy("period", "t").applyInPandas(run, "d int, n double, sa double, sb double, saa double, sbb double, sab double")
    total = sums.groupBy("d").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    scale = F.sqrt(F.greatest(F.col("saa") - F.col("sa") ** 2 / F.col("n"), F.lit(0.0)) * F.greatest(F.col("sbb") - F.col("sb") ** 2 / F.col("n"), F.lit(0.0)))
    cosine = F.when(scale > 1e-15, (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)
    angles = total.select("d", F.degrees(F.acos(F.least(F.abs(cosine), F.lit(1.0)))).alias("angle"))
    return angles.agg(F.min("angle").alias("angle"), F.min_by("d", "angle").alias("nearest"))
