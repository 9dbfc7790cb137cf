"""Models from a file: a class with ``train`` and ``predict`` on wide pandas frames, run per period.

The file is shipped to executors and imported there by path. A period's history and its new rows become wide frames
(timestamps by (feature, asset)), so such a model holds a period in one task, as its interface asks.
"""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import walkforward
from tessera.plans.features import inputs


class Predictor:
    """What a file's class may derive from; any class with both methods will do."""

    def train(self, features: pd.DataFrame, target: pd.DataFrame) -> object:
        raise NotImplementedError

    def predict(self, features: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


def module_of(path: str | Path) -> ModuleType:
    path = Path(path).expanduser().resolve()
    if not path.is_file():
        raise FileNotFoundError(f"no model file: {path}")
    spec = importlib.util.spec_from_file_location(f"tessera_model_{path.stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def chosen(module: ModuleType) -> type:
    """The class to run: one that the file defines itself and that can be trained, derived ones of Predictor first, then by name."""
    found = [c for _, c in inspect.getmembers(module, inspect.isclass) if c.__module__ == module.__name__ and all(callable(getattr(c, m, None)) for m in ("train", "predict"))]
    if not found:
        raise TypeError(f"{module.__name__} has no class with train and predict")
    return min(found, key=lambda c: (not issubclass(c, Predictor), c.__name__))


@lru_cache(maxsize=8)
def shipped(name: str) -> type:
    """The class of a file that the session has shipped, once for each worker."""
    return chosen(module_of(SparkFiles.get(name)))


def wide(rows: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """Timestamps by (feature, asset), assets in their order."""
    assets = rows.drop_duplicates("asset").sort_values("asset_ord", kind="stable")["asset"].tolist()
    parts = {c: rows.pivot(index="t", columns="asset", values=c).reindex(columns=assets).astype(float) for c in columns}
    return pd.concat(parts, axis=1, names=["feature", "asset"])


def walk_forward(panel: DataFrame, path: str | Path, **options) -> DataFrame:
    """(period, t, asset, asset_ord, y, pred) of the validation rows by the class in the file ``path``.

    A period whose model raises, or gives no numbers, predicts 0; ``failed`` has the exception's text.
    """
    path = Path(path).expanduser().resolve()
    chosen(module_of(path))  # what can't be imported is told here
    panel.sparkSession.sparkContext.addFile(str(path))
    names, file = inputs(panel), path.name
    frame = walkforward.split(panel, **options).select("period", "t", "asset", "asset_ord", "train", "y", *(F.col(n).cast("double").alias(n) for n in names))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "asset_ord"], kind="stable")
        known, new = rows[rows["train"]], rows[~rows["train"]]
        out, failed = new[["period", "t", "asset", "asset_ord", "y"]].copy(), None
        try:
            model = shipped(file)()
            model.train(wide(known, names), known.pivot(index="t", columns="asset", values="y").astype(float))
            made = pd.DataFrame(model.predict(wide(new, names)))
            place = made.stack(future_stack=True)
            pred = place.reindex(pd.MultiIndex.from_arrays([new["t"], new["asset"]])).to_numpy(float)
        except Exception as error:  # noqa: BLE001  a model of someone else's
            pred, failed = np.zeros(len(new)), repr(error)
        return out.assign(pred=np.where(np.isfinite(pred), pred, np.nan), failed=failed)

    made = frame.groupBy("period").applyInPandas(run, "period int, t int, asset string, asset_ord int, y double, pred double, failed string")
    return walkforward.shape_safe(made)


def runner(path: str | Path, **options) -> Callable[[DataFrame], DataFrame]:
    """For ``registry.register``: a function from a panel to predictions by the file's class."""
    return lambda panel: walk_forward(panel, path, **options)
