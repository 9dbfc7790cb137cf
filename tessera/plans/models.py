"""The models, by name. Names and numbers are fixed values of their definitions."""

from __future__ import annotations

import math
from dataclasses import replace

from tessera.plans.choices import Pick
from tessera.plans.engine import Head, Model, Tree, with_name

# -- the order in which features are picked. Fixed values ------------------------------


def each(pattern: str, *numbers: int) -> tuple[str, ...]:
    return tuple(pattern.format(n) for n in numbers)


ALL, FIRST, LAST = (1, 2, 3, 4, 5, 6), (1, 2, 3), (4, 5, 6)
PICK04 = Pick("priority", 40, (
    *each("f{}", *ALL), *each("f{}_rank", *FIRST), "rank_mean", "rank_dispersion", "rank12", *each("f{}_diff1", *FIRST), "momentum_mean", "reversion_mean",
    *each("f{}_ma5", *FIRST), *each("f{}_ma20", *FIRST), *each("f{}_sd20", *FIRST), *each("f{}_rankchg", *FIRST), *each("f{}_voladj", *FIRST),
    *each("f{}_mom20", *FIRST), *each("f{}_revert20", *FIRST), "f1_ma60", "f1_ewma5", "f1_roll_z", "f1_mom_spread",
))
PICK29 = Pick("listed", 42, (
    *each("f{}_rank", *LAST), *each("f{}_d1", *LAST), *each("f{}_rev", *LAST), *each("f{}_mom", *LAST), *each("f{}_d1", 2, 3), *each("f{}_rev", 2, 3), *each("f{}_mom", 2, 3),
    "f1_d1", *each("f{}_vd1", *ALL), *each("f{}_demean", *ALL), "spread12", "spread34", "spread56", "product12", "product34", "product56", "mom12", "mom34", "mom56", "revdisp", "momdisp",
))
PICK31 = Pick("patterns", 44, ("^core$", "_rank|^rank", "_lag1", "_rank_lag1", "^f[0-9]+$", "^rank12_spread$", "_ma", "_ew", "_mom", "_trend", "_z"))
PICK32 = Pick("priority", 44, (
    *each("f{}", *ALL), *each("f{}_rank", *ALL), *each("f1_lag{}", 1, 2, 3), "f2_lag1", "f3_lag1", *each("f1_d{}", 1, 3, 5), "f2_d1", "f2_d3", "f3_d1",
    "f1_rank_lag1", "f1_rank_persist", "f1_rank_reversal", *each("f1_ma{}", 3, 8, 21, 60), *each("f1_ew{}", 4, 12, 32), "f1_vol8", "f1_vol21", "f1_z8", "f1_z21",
    "f1_mom3vol", "f1_mom5vol", "f1_trend3_21", "f1_trend8_60", "f1_accel", "f1_demean", "f2_reversal5", "f2_z10", "f3_ma5rank", "rank12", "rank13", "product12", "core", "dispersion",
))
PICK35 = Pick("priority", 34, (
    *each("f{}", *ALL), *each("f{}_rank", *ALL), "f1_lag1", "f1_lag3", "f2_lag1", "f3_lag1", "f1_diff1", "f1_diff3", "f2_diff1", "f3_diff1", "f1_mom3vol10", "f1_mom5vol20",
    "f1_rank_persist", "f1_rank_turnover", "f1_ewma_resid", "f1_z10", "f1_range10", "f1_range20", "f1_trend5_20", "f1_vol_ratio", "f2_reversal5", "f3_ewma_resid", "rank12", "rank13", "core", "regime",
))
PICK36 = Pick("priority", 22, (
    *each("f{}", *LAST), *each("f{}_rank", *LAST), *each("f{}_demean", *LAST), *each("f{}_diff1", *LAST), *each("f{}_diff3", *LAST), "f4_reversal5", "f4_reversal8", "f4_z10",
    "f4_rank_persist", "f4_vol_ratio", "rank12", "rank13", "f5_reversal5", "f5_reversal8", "f5_z10", "rank23", "relative", "f4_rank_turnover", *each("f{}_lag1", *LAST),
))
PICK40 = Pick("pruned", 24, (*each("f{}", *FIRST), *each("f{}_rank", *FIRST)))

PLAIN = Tree(15, 0.05, 200.0)
FIRM = Tree(15, 0.05, 200.0, 0.02, 1.5)
CORE = ("f1", "f2", "f3", "f1_rank", "f2_rank", "f3_rank", "f1_lag1", "f2_lag1", "f3_lag1", "rank12", "rank13")

_v02 = Model("v02", (Head(0.75), Head(0.25, tree=PLAIN)))
_v15 = Model("v15", (Head(0.72), Head(0.24, tree=Tree(14, 0.05, 200.0, 0.02, 1.5)), Head(0.04, "rank", 20.0)), clip=0.995)
_tree33 = Tree(9, 0.04, 280.0, 0.08, 2.5, 0.82, 0.70, 3301)
_v33 = Model("v33", (Head(0.62, alpha=12.0), Head(0.23, "rank", 28.0), Head(0.15, tree=_tree33)), "compact", 0.30, "times", 0.55, demean=True, clip=0.995, centre="median", quantile=0.01, least=60)
_linear33 = (Head(0.72 * 0.62, alpha=12.0), Head(0.72 * 0.23, "rank", 28.0), Head(0.72 * 0.15, tree=_tree33), Head(0.28 * 0.62, alpha=30.0, columns=CORE), Head(0.28 * 0.38, "rank", 46.0, columns=CORE))

#: Weights have their half-life after this share of the history.
HALF_LIFE = 0.28 / math.log(2)
_tree31 = Tree(11, 0.045, 180.0, 0.04, 2.1, 0.84, 0.78, 3101)
_heads31 = (
    Head(-0.03787056, alpha=9.0),
    Head(-0.01682583, tree=_tree31),
    Head(0.05846655, "rank", 22.0),
    Head(0.08021127, "rank", tree=replace(_tree31, rounds=10, rows=0.90, columns=0.70, seed=3119)),
    Head(-0.07269948, "ahead", 13.0),
    Head(0.15893598, "ahead", tree=replace(_tree31, rows=0.87, columns=0.76, seed=3137)),
    Head(0.19806513, "slow", 18.0),
    Head(-0.14585455, "slow", tree=replace(_tree31, rounds=8, rows=0.90, columns=0.68, seed=3163)),
    Head(0.15628094, "signal", columns=("f1_rank",)),
    Head(0.02679317, "signal", columns=("f1_rank_lag1",)),
    Head(0.01993833, "signal", columns=("f2_rank",)),
    Head(0.00849446, "signal", columns=("f3_rank",)),
    Head(-0.01956375, "signal", columns=("core",)),
)

_tree32 = Tree(12, 0.045, 210.0, 0.04, 2.0, 0.84, 0.80, 3201)

_ALL = (
    _v02,
    with_name(_v02, "v08"),
    with_name(_v02, "v12"),
    Model("v03", (Head(0.35, decay=0.12), Head(0.35, decay=0.45), Head(0.05, "unscaled_rank", 16.0), Head(0.25, tree=PLAIN)), "changes", scale="std"),
    Model("v04", (Head(0.25, decay=0.12), Head(0.20, decay=0.45), Head(0.20, "rank", 16.0), Head(0.20, tree=Tree(15, 0.05, 200.0, 0.1, 2.0))), "momenta", scale="std", pick=PICK04),
    Model("v07", (Head(0.52, decay=0.16), Head(0.22, decay=0.30), Head(0.10, decay=0.55), Head(0.10, "rank", decay=0.30), Head(0.06, "residual", tree=Tree(16, 0.04, 220.0, 0.15, 3.5, 0.82, 0.78))), "four_ranks", rows=85_000, recent=0.65, sign=-1.0),
    Model("v09", (Head(0.88, huber=1.5), Head(0.12, "rank", 20.0), Head(0.12, "residual", tree=Tree(12, 0.04, 220.0, 0.1, 3.0, 0.82, 0.8))), demean=True, clip=0.995),
    Model("v10", (Head(0.84 * 0.85, huber=1.5), Head(0.84 * 0.15, alpha=24.0, robust=True), Head(0.16, "rank", 20.0), Head(0.10, "residual", tree=Tree(12, 0.04, 220.0, 0.12, 3.5, 0.82, 0.8))), demean=True, clip=0.995),
    Model("v11", (Head(0.76, huber=1.5), Head(0.12, "z", 14.0), Head(0.12, "rank", 20.0), Head(0.11, "residual", tree=Tree(14, 0.035, 220.0, 0.12, 3.25, 0.84, 0.8))), demean=True, clip=0.995),
    Model("v13", (Head(0.55), Head(0.20, alpha=24.0, decay=0.0), Head(0.125, tree=Tree(10, 0.05, 200.0)), Head(0.125, decay=0.0, tree=Tree(10, 0.04, 260.0, 0.1, 4.0, 0.9, 0.9, 137)))),
    Model("v14", (Head(0.65), Head(0.10, alpha=20.0, decay=0.0), Head(0.25, tree=Tree(14, 0.05, 210.0, 0.03, 1.5, 0.82, 0.82)))),
    _v15,
    Model("v17", (Head(0.73, alpha=10.0), Head(0.22, tree=Tree(13, 0.045, 220.0, 0.03, 2.0, 0.82, 0.82)), Head(0.05, "rank", 24.0)), "agreement", rows=72_000, clip=0.997),
    with_name(_v15, "v18", scale="std", heads=(Head(0.72), Head(0.24, tree=FIRM), Head(0.04, "rank", 20.0))),
    Model("v19", (Head(0.62), Head(0.10, "tail", 14.0), Head(0.24, tree=FIRM), Head(0.04, "rank", 20.0)), clip=0.995, scale="std"),
    Model("v20", (Head(0.66), Head(0.06, alpha=12.0, decay=0.08), Head(0.24, tree=FIRM), Head(0.04, "rank", 20.0)), clip=0.995, scale="std", finish="double"),
    Model("v21", (Head(0.70, alpha=10.0), Head(0.26, tree=Tree(15, 0.05, 220.0, 0.03, 1.8)), Head(0.04, "rank", 24.0)), "robust", 0.22, demean=True, clip=0.995, scale="std", finish="mad_cap", pick=Pick("stability", 30, rows=60_000)),
    Model("v22", (Head(0.72), Head(0.12, tree=Tree(12, 0.05, 220.0, 0.03, 1.8)), Head(0.12, tree=Tree(12, 0.05, 220.0, 0.03, 1.8, seed=137)), Head(0.04, "rank", 20.0)), sample="times", demean=True, clip=0.995, finish="double"),
    Model("v23", (Head(0.58), Head(0.17, tree=Tree(12, 0.05, 220.0, 0.03, 1.8)), Head(0.20, "rank", tree=Tree(12, 0.05, 220.0, 0.03, 1.8, seed=137)), Head(0.05, "rank", 20.0)), sample="times", demean=True, clip=0.995, finish="double"),
    Model("v29", (Head(0.52, alpha=14.0), Head(0.28, tree=Tree(18, 0.035, 260.0, 0.08, 2.6, 0.84, 0.76, 2901)), Head(0.20, "rank", 30.0)), "moments", 0.14, "times", 0.65, rows=90_000, clip=0.995, centre="median", quantile=0.01, finish="neutral", least=60, pick=PICK29),
    Model("v30", (Head(0.29), Head(0.085, tree=Tree(12, 0.05, 220.0, 0.03, 1.8)), Head(0.10, "rank", tree=Tree(12, 0.05, 220.0, 0.03, 1.8)), Head(0.025, "rank", 20.0), Head(0.36, "ahead", 12.0), Head(0.14, "ahead", tree=Tree(10, 0.05, 220.0, 0.03, 1.8))), sample="times", demean=True, clip=0.995),
    Model("v31", _heads31, "paths", HALF_LIFE, "times", 0.65, demean=True, clip=0.995, centre="median", finish="mad_first", least=80, extra={"clip_factor": 3.2}, pick=PICK31),
    Model("v32", (Head(0.5, alpha=9.0, huber=1.5, robust=True), Head(0.2, tree=_tree32, robust=True), Head(0.1, "rank", 24.0), Head(0.2, "rank", tree=replace(_tree32, rows=0.90, columns=0.72, seed=3229))), "trails", sample="times", recent=0.65, demean=True, clip=0.995, centre="median", finish="mad_clip", least=80, extra={"clip_factor": 3.2, "share_of": (0, 2)}, pick=PICK32),
    _v33,
    with_name(_v33, "v34a", finish="conviction"),
    Model("v35", (Head(0.60, alpha=16.0), Head(0.25, "rank", 34.0), Head(0.15, tree=Tree(9, 0.035, 320.0, 0.1, 2.8, 0.82, 0.68, 3501))), "regimes", 0.30, "times", 0.55, demean=True, clip=0.995, centre="median", quantile=0.01, least=60, pick=PICK35),
    Model("v36", (Head(0.65, alpha=22.0), Head(0.35, "rank", 42.0)), "primary", 0.38, "times", 0.50, demean=True, clip=0.995, centre="median", quantile=0.01, least=60, pick=PICK36),
    with_name(_v33, "v37", heads=(Head(0.70, alpha=12.0), Head(0.30, "rank", 28.0))),
    with_name(_v33, "v38", heads=(Head(0.68, alpha=12.0), Head(0.22, "rank", 28.0), Head(0.10, tree=_tree33))),
    with_name(_v33, "v40", pick=PICK40),
    with_name(_v33, "v41", decay=0.22),
    with_name(_v33, "v43", heads=_linear33),
    with_name(_v33, "v44", heads=(*_linear33, Head(0.62, "forward", 12.0), Head(0.23, "forward_rank", 28.0), Head(0.15, "forward", tree=_tree33)), transport=0.35),
)
MODELS = {m.name: m for m in _ALL}
