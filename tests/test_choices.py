"""Features picked per period, against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear, sampling
from tessera.plans import choices, engine, features, registry, walkforward
from tessera.plans.choices import Pick
from tessera.plans.models import MODELS
from tessera.sources import synthetic

NAMES = [f"x{i}" for i in range(9)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = []
    for period, times in ((1, 40), (2, 11), (3, 6)):
        for t in range(times):
            for a in range(8):
                v = rng.normal(size=9)
                y = float(0.4 * v[0] - 0.3 * v[1] + rng.normal())
                v[2] = v[0] + 1e-4 * v[2]  # repeats x0
                v[3] = -v[1]
                v[4] = 1.0 if period < 3 else v[4]  # doesn't vary
                x = [float(z) for z in v]
                x[5] = None if rng.random() < (0.97 if period == 1 else 0.3) else x[5]
                x[6] = None if t % 5 == 0 else x[6]
                made.append((period, t, a, y, *x))
    return spark.createDataFrame(made, "period int, t int, asset_ord int, y double, " + ", ".join(f"{n} double" for n in NAMES)).cache()


def usable(part):
    return [n for n in NAMES if part[n].notna().mean() >= 0.05 and np.nanstd(part[n].to_numpy(float)) >= 1e-8]


def ics(part, names):
    out = []
    for _, block in part.groupby("t"):
        ry = block["y"].rank(pct=True).to_numpy()
        row = []
        for n in names:
            rx = block[n].rank(pct=True).to_numpy()
            have = np.isfinite(rx)
            top = ((rx[have] - rx[have].mean()) * (ry - ry.mean())[have]).sum() if have.any() else 0.0
            below = np.sqrt(((rx[have] - rx[have].mean()) ** 2).sum() * ((ry - ry.mean()) ** 2).sum()) if have.any() else 0.0
            row.append(top / below if have.sum() >= 4 and below > 1e-10 else np.nan)
        out.append(row)
    return np.array(out)


def steady(part, names, decay=0.45):
    total = part["t"].nunique()
    if total < 8:
        return np.zeros(len(names))
    c = ics(part, names)
    w = np.exp(-(total - 1 - np.arange(total)) / max(1.0, total * decay))
    late = np.arange(total) >= max(0, total - max(8, int(total * 0.35)))

    def mean(x, weights):
        have = np.isfinite(x)
        return np.array([np.average(x[have[:, j], j], weights=weights[have[:, j]]) if have[:, j].any() else np.nan for j in range(x.shape[1])])

    every, recent = mean(c, w), mean(c[late], w[late])
    before = mean(c[~late], w[~late]) if (~late).sum() >= 3 else every
    spread = np.sqrt(mean((c - every) ** 2, w))
    have = np.isfinite(c)
    same = np.array([np.mean(np.sign(c[have[:, j], j]) == np.sign(every[j])) if have[:, j].any() else 0 for j in range(len(names))])
    score = np.abs(0.4 * every + 0.6 * recent) * (0.5 + 0.5 * same) * np.where(before * recent >= 0, 1.0, 0.35) * np.sqrt(have.mean(axis=0)) / (0.08 + np.nan_to_num(spread, nan=1.0))
    return np.nan_to_num(score)


def test_pruned_choice_is_that_of_a_loop(spark, rows):
    pick = Pick("pruned", 6, ("x7", "x4"), redundancy=0.9)
    got = {r["period"]: r["kept"] for r in choices.kept(rows, NAMES, pick).collect()}
    scores = {(r["period"], r["feature"]): r["score"] for r in choices.steady_scores(rows, NAMES, pick).collect()}
    for period, part in rows.toPandas().sort_values(["t", "asset_ord"]).groupby("period"):
        names = usable(part)
        score = steady(part, names)
        assert {f for p, f in scores if p == period} == set(names)
        np.testing.assert_allclose([scores[period, n] for n in names], score, atol=1e-9)
        x = part[names].to_numpy(float)
        x = np.where(np.isfinite(x), x, np.nanmedian(x, axis=0))
        corr = np.corrcoef(x.T)
        order = sorted(range(len(names)), key=lambda i: (-score[i], i))
        chosen = [names.index(n) for n in pick.first if n in names]
        for i in order:
            if len(chosen) < pick.most and i not in chosen and not any(abs(corr[i, j]) >= pick.redundancy for j in chosen):
                chosen.append(i)
        for i in order:
            if len(chosen) < pick.most and i not in chosen:
                chosen.append(i)
        assert got[period] == [names[i] for i in chosen]


def test_stability_choice_is_that_of_a_loop(spark, rows):
    got = {r["period"]: r["kept"] for r in choices.kept(rows, NAMES, Pick("stability", 4)).collect()}
    for period, part in rows.toPandas().sort_values(["t", "asset_ord"]).groupby("period"):
        names = usable(part)
        x = part[names].to_numpy(float)
        part = part.assign(**dict(zip(names, np.where(np.isfinite(x), x, np.nanmedian(x, axis=0)).T)))
        c = np.array([[np.corrcoef(b[n], b["y"])[0, 1] if b[n].std() > 0 else 0.0 for n in names] for _, b in part.groupby("t")])
        score = np.abs(c.mean(axis=0)) * (0.5 + 0.5 * np.mean(np.sign(c) == np.sign(c.mean(axis=0)), axis=0)) / (0.05 + c.std(axis=0))
        assert got[period] == [names[i] for i in sorted(range(len(names)), key=lambda i: (-score[i], i))[:4]]
    whole = {r["period"]: r["kept"] for r in choices.kept(rows, NAMES, Pick("stability", 9)).collect()}
    assert whole[2] == [n for n in NAMES if n != "x4"]  # few enough: all, in their order


def test_orders_and_correlations(spark, rows):
    pick = lambda *args: {r["period"]: r["kept"] for r in choices.kept(rows, NAMES, Pick(*args)).collect()}
    assert pick("priority", 4, ("x8", "x4", "x2"))[1] == ["x8", "x2", "x0", "x1"]
    assert pick("listed", 4, ("x8", "x4", "x2"))[3] == ["x8", "x4", "x2"]
    assert pick("patterns", 4, ("[67]$", "8"))[1] == ["x6", "x7", "x8", "x0"]
    got = pick("correlation", 3)
    for period, part in rows.toPandas().groupby("period"):
        size = {n: abs(part[n].astype(float).corr(part["y"])) for n in usable(part) if part[n].notna().sum() >= 20}
        assert got[period] == sorted(size, key=lambda n: -size[n])[:3]


def test_even_rows_bound_a_period(spark):
    frame = spark.range(1000).select(F.lit(0).alias("period"), (F.col("id") / 10).cast("int").alias("t"), (F.col("id") % 10).cast("int").alias("asset_ord"))
    got = sorted(10 * r["t"] + r["asset_ord"] for r in sampling.even_rows(frame, 37).collect())
    assert got == np.linspace(0, 999, 37, dtype=np.int64).tolist()
    assert sampling.even_rows(frame, 1000).count() == 1000


def test_grams_of_several_weights_are_numpys(spark, rows):
    few = ["x0", "x1", "x7"]
    got = {(r["period"], r["weight"]): np.array(r["gram"]).reshape(3, 3) for r in linear.partial_grams(rows, few, {"one": F.lit(1.0), "t": F.col("t") + 1.0}, ["period"]).collect()}
    for period, part in rows.toPandas().groupby("period"):
        x = part[few].to_numpy(float)
        np.testing.assert_allclose(got[period, "one"], x.T @ x, atol=1e-9)
        np.testing.assert_allclose(got[period, "t"], x.T @ (x * (part["t"].to_numpy() + 1.0)[:, None]), atol=1e-9)
        gram, right = got[period, "t"], np.arange(3.0)
        path = linear.ridge_path(gram, right, [0.5, 8.0])
        for alpha, row in zip((0.5, 8.0), path):
            np.testing.assert_allclose(row, np.linalg.solve(gram + alpha * np.eye(3), right), atol=1e-9)


@pytest.fixture(scope="module")
def panel(spark):
    return synthetic.dataset(spark, 2, 60, 8).cache()


@pytest.mark.parametrize(("name", "most"), [("v04", 40), ("v21", 30), ("v29", 42), ("v31", 44), ("v32", 44), ("v35", 34), ("v36", 22), ("v40", 24)])
def test_models_fit_the_features_they_pick(spark, panel, name, most):
    model = MODELS[name]
    parts = walkforward.split(panel)
    frame = features.SETS[model.features](parts)
    names = features.feature_names(frame)
    picked = {r["period"]: r["kept"] for r in engine.picked(model, frame, names).collect()}
    assert len(names) > most and {len(k) for k in picked.values()} == {most}
    if model.pick.rule in ("priority", "listed"):
        assert all(k == [n for n in model.pick.first if n in k] + [n for n in k if n not in model.pick.first] for k in picked.values())
        assert set(model.pick.first) <= set(names)
    if model.pick.rule == "patterns":
        assert all(k[0] == "core" for k in picked.values())
    used = engine.predict(model, parts).select("period", "used").distinct().collect()
    assert {r["period"]: r["used"] for r in used} == dict.fromkeys(picked, most)
    assert registry.run(panel, name).where("pred is null").count() == 0


def test_choices_reach_both_forms_of_the_fit(spark, panel, monkeypatch):
    once = walkforward.walk_forward(panel, "v36").select("period", "t", "asset", "pred").cache()
    once.count()
    monkeypatch.setattr(engine, "sizes", lambda panel: (1 << 40, 4))
    apart = walkforward.walk_forward(panel, "v36").select("period", "t", "asset", F.col("pred").alias("p"))
    assert once.join(apart, ["period", "t", "asset"]).where("abs(pred - p) < 1e-9").count() == once.count() > 0


def test_share_is_chosen_by_later_timestamps():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 3))
    t = np.repeat(np.arange(60), 20)
    raw = x @ np.array([1.0, 0.5, -0.5]) + 0.5 * rng.normal(size=1200)
    raw[rng.random(1200) < 0.05] *= 30  # outliers that ranks withstand
    rank = 2 * (pd.Series(raw).groupby(t).rank(pct=True).to_numpy() - 0.5)
    w = engine.fading(t.astype(float), np.full(1200, 60.0), 0.2)
    got = engine.choose_share(x, raw, rank, w, t, (9.0, 24.0))
    cut = 60 - max(4, int(np.ceil(60 * 0.18)))
    early, late = t < cut, t >= cut
    fit = lambda y, a: (np.average(y, weights=w[early]), np.linalg.solve((x[early] * w[early, None]).T @ x[early] + a * np.eye(3), x[early].T @ (w[early] * (y - np.average(y, weights=w[early])))))
    (ri, rc), (ki, kc) = fit(raw[early], 9.0), fit(rank[early], 24.0)
    rp, kp = ri + x[late] @ rc, (ki + x[late] @ kc) * raw[early].std() / rank[early].std()
    score = {}
    for share in (0.22, 0.30, 0.38):
        c = [np.corrcoef(((1 - share) * rp + share * kp)[t[late] == i], raw[late][t[late] == i])[0, 1] for i in range(cut, 60)]
        score[share] = np.mean(c) - 0.2 * np.std(c)
    best = max(score, key=score.get)
    assert got == (best if best == 0.30 or score[best] >= score[0.30] + 0.002 else 0.30)
    assert engine.choose_share(x[:300], raw[:300], rank[:300], w[:300], t[:300], (9.0, 24.0)) == 0.30


def test_regime_part_of_v04(spark, panel):
    from tessera.plans import signals

    out = registry.run(panel, "v04").toPandas()
    parts = walkforward.split(panel)
    plain = engine.predict(MODELS["v04"], parts).select("period", "t", "asset", "raw", "limit").toPandas()
    signal = signals.regime_signal(parts).select("period", "t", "asset", "signal").toPandas()
    y = {p: np.std(g["y"]) for p, g in parts.where("train").toPandas().groupby("period")}
    both = out[["period", "t", "asset", "pred"]].merge(plain, on=["period", "t", "asset"]).merge(signal, on=["period", "t", "asset"])
    for (period, _), part in both.groupby(["period", "t"]):
        s = part["signal"] - part["signal"].mean()
        s = s / s.std(ddof=0) if s.std(ddof=0) > 0 else 0 * s
        want = (part["raw"] - part["raw"].mean() + 0.15 * s * y[period]).clip(-part["limit"], part["limit"])
        np.testing.assert_allclose(part["pred"], want - want.mean(), atol=1e-9)
    assert len(both) == len(out)
