"""Models by name, and a hook for one's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.plans import engine, finish, ridge_path, search, signals, stacks, walkforward
from tessera.plans.models import MODELS

Runner = Callable[[DataFrame], DataFrame]
_own: dict[str, Runner] = {}


def register(name: str, runner: engine.Model | Runner) -> None:
    """Adds a declared model, or a function from a panel to walk-forward predictions."""
    _own[name] = (lambda panel: walkforward.walk_forward(panel, runner)) if isinstance(runner, engine.Model) else runner


def _untrained(panel: DataFrame) -> DataFrame:
    """A model that never trains: validation rows get the fallback of the whole history."""
    parts = finish.fallback(walkforward.split(panel), 0.25)
    return walkforward.shape_safe(parts.where("not train"))


register("v06", _untrained)
#: Weights of (ridge, huber ridge, trees, rank): from trees alone to even linear parts. The linear share is
#: 0.7 and 0.3 of the two ridges, multiplied out as they are separate heads; ranks run from -1 to 1, so theirs is halved. Fixed values.
PRESETS = {"trees": (0.0, 0.0, 1.0, 0.0), "mostly trees": (0.175, 0.075, 0.70, 0.025), "mixed": (0.385, 0.165, 0.40, 0.025), "even": (0.315, 0.135, 0.45, 0.05)}
#: Penalties are multiples of the one that a period chooses.
_V01 = engine.Model("v01", (engine.Head(0.0, alpha=1.0), engine.Head(0.0, alpha=1.0, delta=1.0), engine.Head(1.0, tree=engine.Tree(40, 0.05, 200.0)), engine.Head(0.0, "unscaled_rank", 1.0)), "broad", rows=250_000, extra={"plain_start": True})
register("v01", lambda panel: ridge_path.searched(panel, _V01, PRESETS))
#: Weights of (ridge, slow ridge, rank, trees on residuals) and the share of ranks. Fixed values.
BLENDS = {"plain": (0.7, 0.2, 0.1, 0.1, 0.0), "some ranks": (0.62, 0.23, 0.15, 0.15, 0.05), "more ranks": (0.58, 0.22, 0.2, 0.15, 0.08), "more trees": (0.68, 0.17, 0.15, 0.22, 0.05)}


def _v05(rounds: int, rows: int) -> engine.Model:
    tree = engine.Tree(rounds, 0.045, 240.0, 0.15, 3.0, 0.82, 0.78)
    heads = (engine.Head(0.72), engine.Head(0.28, decay=0.45), engine.Head(0.0, "rank", 16.0, 0.30), engine.Head(0.0, "residual", decay=((0.65, 0.20), (0.35, 0.45)), tree=tree))
    return engine.Model("v05", heads, "weighed_ranks", rows=rows, recent=0.65, scale="std")


register("v05", lambda panel: search.held_out(panel, _v05(16, 85_000), _v05(8, 45_000), {n: b[:4] for n, b in BLENDS.items()}, {n: b[4] for n, b in BLENDS.items()}))
register("v10", lambda panel: signals.gated(walkforward.walk_forward(panel, MODELS["v10"]), [h.weight for h in MODELS["v10"].heads]))
register("v16", lambda panel: search.searched(panel, *search.rank_shares(MODELS["v02"])))
register("v29", stacks.neutral_model)
register("v04", lambda panel: signals.with_regime(panel, MODELS["v04"]))
register("v42", stacks.residual_stack)
register("v32", lambda panel: signals.adaptive_share(walkforward.walk_forward(panel, MODELS["v32"])))


def names() -> list[str]:
    return sorted({*MODELS, *_own})


def run(panel: DataFrame, name: str) -> DataFrame:
    """Walk-forward predictions of the model of that name."""
    return _own[name](panel) if name in _own else walkforward.walk_forward(panel, MODELS[name])
