import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import gauge, linear, neutral, robust, sampling
from tessera.plans import engine, finish, metrics, registry, walkforward
from tessera.plans.models import MODELS
from tessera.sources import panels, synthetic


@pytest.fixture(scope="module")
def panel(spark):
    return synthetic.dataset(spark, 4, 80, 10).cache()


def test_synthetic_data_is_seeded(spark, panel):
    again = synthetic.dataset(spark, 4, 80, 10)
    assert panel.exceptAll(again).count() == 0 and panel.count() == 4 * 80 * 10
    means = panel.groupBy("period", "t").agg(F.avg("y").alias("m")).agg(F.max(F.abs("m")).alias("m")).first()["m"]
    assert means < 1e-6


@pytest.mark.parametrize("name", ["v37", "v33", "v44", "v02", "v06", "v36", "v05", "v29", "v31", "v40", "v42"])
def test_predictions_find_the_signal_and_are_centred(panel, name):
    out = registry.run(panel, name).cache()
    assert out.groupBy("period", "t").agg(F.avg("pred").alias("m")).agg(F.max(F.abs("m")).alias("m")).first()["m"] < 1e-9
    stats = metrics.statistics(out).first()
    assert stats["periods"] == 4 and stats["observations"] == 4 * 16 and stats["ic"] > {"v36": 0.1, "v29": -0.2, "v31": 0.0}.get(name, 0.3)


def test_predictions_are_causal_and_deterministic(panel):
    base = walkforward.walk_forward(panel, "v37").select("period", "t", "asset", "pred")
    changed = panel.withColumn("y", F.when(F.col("t") >= 64, 99.0).otherwise(F.col("y"))).withColumn("f1", F.when(F.col("t") >= 75, 5.0).otherwise(F.col("f1")))
    other = walkforward.walk_forward(changed, "v37").select("period", "t", "asset", F.col("pred").alias("other"))
    late = base.join(other, ["period", "t", "asset"]).where("t < 75").agg(F.max(F.abs(F.col("pred") - F.col("other"))).alias("d")).first()["d"]
    assert late == 0.0


def test_ridge_by_sums_is_numpys(spark, panel):
    rows = linear.with_recency(panel, 0.3)
    got = {r["period"]: r["coefficients"] for r in robust.ridge(rows, ["f1", "f2", "f3"], "y", "w", ["period"], 12.0).collect()}
    for period, part in rows.toPandas().groupby("period"):
        x, w = part[["f1", "f2", "f3"]].to_numpy(), part["w"].to_numpy()
        want = np.linalg.solve(x.T @ (x * w[:, None]) + 12 * np.eye(3), x.T @ (w * part["y"].to_numpy()))
        np.testing.assert_allclose(got[period], want, atol=1e-9)


def test_huber_resists_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = 2 * x + 0.1 * rng.normal(size=400)
    y[:20] += 50
    frame = spark.createDataFrame([(0, float(a), float(b), 1.0) for a, b in zip(x, y)], "period int, x double, y double, w double")
    (plain,) = robust.ridge(frame, ["x"], "y", "w", ["period"], 0.1).collect()
    (firm,) = robust.huber(frame, ["x"], "y", "w", ["period"], 0.1).collect()
    assert abs(firm["coefficients"][0] - 2) < abs(plain["coefficients"][0] - 2) and abs(firm["coefficients"][0] - 2) < 0.05


def test_trees_learn_a_step():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = np.where(x[:, 2] > 0.3, 1.0, -1.0)
    trees = engine.Trees(engine.Tree(60, 0.2, 10.0, rows=1.0, columns=1.0)).fit(x, y, np.ones(2000))
    assert np.mean((trees.predict(x) - y) ** 2) < 0.05


def test_neutral_signal_is_uncorrelated(spark, panel):
    out = neutral.neutralise(panel.select("period", "t", "asset", "y", "f1", "f2"), "y", ["f1", "f2"], "left_over", ridge=1e-9).toPandas()
    for _, part in out.groupby(["period", "t"]):
        centred = part[["f1", "f2"]] - part[["f1", "f2"]].mean()
        np.testing.assert_allclose(centred.to_numpy().T @ part["left_over"].to_numpy(), 0, atol=1e-6)


def test_rank_transport_keeps_the_order_of_the_base(spark, panel):
    frame = finish.fallback(panel.where("period = 0 and t < 20")).withColumn("horizon", F.col("f2"))
    for _, part in finish.rank_transport(frame).toPandas().groupby("t"):
        order = part.sort_values(["pred", "asset_ord"])
        assert (np.diff(order["transported"]) >= -1e-12).all()


def test_gauge_keeps_shape_and_is_seeded(spark, panel):
    frame = finish.fallback(panel)
    a, b = gauge.gauge_fix(frame).toPandas(), gauge.gauge_fix(frame).toPandas()
    keys = ["period", "t", "asset"]
    pd.testing.assert_frame_equal(a.sort_values(keys).reset_index(drop=True), b.sort_values(keys).reset_index(drop=True))
    assert len(a) == panel.count() and a.groupby(["period", "t"])["pred"].mean().abs().max() < 1e-9
    basis = gauge.rotations(3, 6, 1)
    np.testing.assert_allclose(np.einsum("tij,tkj->tik", basis, basis), np.broadcast_to(np.eye(5), (3, 5, 5)), atol=1e-12)
    angle = gauge.novelty(frame).first()
    assert 80 < angle["angle"] <= 90 and 0 <= angle["nearest"] < 12


@pytest.mark.parametrize(("n", "budget"), [(100, 40), (100, 100), (1000, 37), (41, 40)])
def test_samples_by_position(spark, n, budget):
    frame = spark.range(n).select(F.lit(0).alias("period"), F.col("id").cast("int").alias("t"), F.lit("a").alias("asset"), F.lit(0).alias("asset_ord"))
    late = int(0.6 * budget)
    old = {int(x) for x in np.linspace(0, n - late - 1, budget - late)}
    want = list(range(n)) if n <= budget else sorted(old | set(range(n - late, n)))
    for rows in (sampling.by_rows(frame, budget, 0.6, positions=True), sampling.by_times(frame, budget, 0.6, positions=True)):
        assert sorted((r["t"], r["position"], r["total"]) for r in rows.collect()) == [(t, t, n) for t in want]


def test_a_model_is_that_of_plain_numpy(spark, panel):
    """v37 fitted again with loops and a direct solution of its normal equations."""
    from tessera.plans import features

    got = walkforward.walk_forward(panel, "v37").toPandas().set_index(["period", "t", "asset"])["pred"]
    made = features.compact(walkforward.split(panel))
    names = features.feature_names(made)
    for period, frame in made.toPandas().groupby("period"):
        frame = frame.sort_values(["t", "asset_ord"]).reset_index(drop=True)
        train, valid = frame[frame["train"]], frame[~frame["train"]]
        y = (train["y"] - train.groupby("t")["y"].transform("mean")).to_numpy()
        limit = np.quantile(np.abs(y), 0.995)
        raw = np.clip(y, -limit, limit)
        rank = 2 * (pd.Series(raw).groupby(train["t"].to_numpy()).rank(pct=True).to_numpy() - 0.5)
        cells, ahead = [], []
        for name in names:
            own, other = train[name].to_numpy(float), valid[name].to_numpy(float)
            middle = np.nanmedian(own)
            own, other = np.where(np.isnan(own), middle, own), np.where(np.isnan(other), middle, other)
            low, high = np.quantile(own, 0.01), np.quantile(own, 0.99)
            own, other = np.clip(own, low, high), np.clip(other, low, high)
            centre = np.median(own)
            scale = 1.4826 * np.median(np.abs(own - centre))
            cells.append((own - centre) / scale)
            ahead.append((other - centre) / scale)
        x, z = np.column_stack(cells), np.column_stack(ahead)
        age = train["t"].max() - train["t"].to_numpy()
        w = np.exp(-age / (0.30 * (train["t"].max() + 1)))
        w /= w.mean()
        pred = 0.0
        for share, target, alpha, size in ((0.70, raw, 12.0, 1.0), (0.30, rank, 28.0, raw.std() / rank.std())):
            start = np.average(target, weights=w)
            gram = sum(w[i] * np.outer(x[i], x[i]) for i in range(len(x))) + alpha * np.eye(x.shape[1])
            beta = np.linalg.inv(gram) @ sum(w[i] * x[i] * (target[i] - start) for i in range(len(x)))
            pred = pred + share * size * (start + z @ beta)
        pred = pd.Series(np.clip(pred, -3 * limit, 3 * limit))
        pred = pred - pred.groupby(valid["t"].to_numpy()).transform("mean")
        want = pd.Series(pred.to_numpy(), index=pd.MultiIndex.from_arrays([[period] * len(valid), valid["t"], valid["asset"]]))
        np.testing.assert_allclose(got.loc[want.index].to_numpy(), want.to_numpy(), atol=1e-9)


def test_a_period_is_sampled_before_it_is_grouped(spark, panel, monkeypatch):
    from dataclasses import replace

    from tessera.plans import features

    model = replace(MODELS["v37"], rows=200)
    made = features.compact(walkforward.split(panel))
    names = features.feature_names(made)
    pick = sampling.by_times(engine.labelled(model, made, names), 200, model.recent)
    assert pick.groupBy("period").count().agg(F.max("count")).first()[0] <= 200
    whole = walkforward.walk_forward(panel, model).select("period", "t", "asset", "pred")
    monkeypatch.setattr(engine, "CHUNK", 7)  # rows to predict come in many chunks
    apart = walkforward.walk_forward(panel, model).select("period", "t", "asset", F.col("pred").alias("other"))
    assert whole.join(apart, ["period", "t", "asset"]).where("abs(pred - other) < 1e-12").count() == whole.count()


@pytest.mark.parametrize("name", ["v37", "v44", "v02", "v30", "v31"])
def test_small_periods_in_one_pass_give_the_same(spark, panel, monkeypatch, name):
    holes = panel.withColumn("y", F.when(F.col("t") % 7 == 3, None).when((F.col("t") == 20) & (F.col("asset_ord") == 1), float("inf")).otherwise(F.col("y")))
    once = walkforward.walk_forward(holes, name).select("period", "t", "asset", "raw", "pred")
    assert once.where("raw <> 0").count() > 0
    once = once.cache()
    monkeypatch.setattr(engine, "sizes", lambda panel: (1 << 40, 4))
    apart = walkforward.walk_forward(holes, name).select("period", "t", "asset", F.col("raw").alias("r"), F.col("pred").alias("p"))
    assert once.join(apart, ["period", "t", "asset"]).where("abs(raw - r) < 1e-9 and abs(pred - p) < 1e-9").count() == once.count() == 4 * 16 * 10


def test_too_few_rows_fall_back_to_zero(spark):
    small = synthetic.dataset(spark, 1, 14, 2)
    assert walkforward.walk_forward(small, "v37").where("pred <> 0").count() == 0
    assert walkforward.split(synthetic.dataset(spark, 1, 11, 2)).count() == 0


def test_missing_and_constant_features(spark, panel):
    odd = panel.withColumn("f5", F.lit(None).cast("double")).withColumn("f6", F.lit(3.0))
    assert metrics.statistics(walkforward.walk_forward(odd, "v37")).first()["ic"] > 0.3


def test_wide_frames_in_any_order(spark):
    wide = spark.createDataFrame([(1, "1.0", 2.0, None), (2, "x", 4.0, 5.0)], "time int, `A|Feature.1` string, `B|Feature.1` double, `A|Feature.2` double")
    rows = {(r["t"], r["asset"]): (r["f1"], r["f2"]) for r in panels.from_wide(wide).collect()}
    assert rows == {(0, "A"): (1.0, None), (0, "B"): (2.0, None), (1, "A"): (None, 5.0), (1, "B"): (4.0, None)}
    flat = panels.from_wide(spark.createDataFrame([(1, 2.0, 3.0)], "time int, AAPL double, MSFT double"))
    assert [(r["asset"], r["f1"]) for r in flat.orderBy("asset_ord").collect()] == [("AAPL", 2.0), ("MSFT", 3.0)]


def test_own_models_plug_in(spark, panel):
    registry.register("own", MODELS["v37"])
    assert "own" in registry.names() and registry.run(panel, "own").count() == 4 * 16 * 10


def test_later_targets_skip_missing_rows(spark):
    rows = [(0, t, "a", 0, None if t % 5 == 2 else float(t), t < 100, float(50 + 10 * (t - 100)) if t >= 100 else float(t)) for t in range(102)]
    frame = spark.createDataFrame(rows, "period int, t int, asset string, asset_ord int, y double, train boolean, x double")
    model = engine.Model("m", (engine.Head(1.0, "ahead", 1e-6, 0.0),), scale="std", quantile=0.0)
    got = [r["raw"] for r in engine.predict_features(model, frame, ["x"]).orderBy("t").collect()]
    assert 50.5 < got[0] < 52 and 60.5 < got[1] < 62  # a row further, sometimes two


def test_held_scores_prefer_the_better_candidate(spark, panel):
    from tessera.plans import search

    rows = panel.where("period = 0").select("period", "t", "asset", "asset_ord", "y", F.array("y", "f5").alias("heads"))
    both = search.spread_out(rows, {"bad": (0.0, 1.0), "good": (1.0, 0.0)})
    scores = {r["candidate"]: r["score"] for r in search.held_scores(search.with_ranks(both, {"bad": 0.0, "good": 0.5})).collect()}
    assert scores["good"] > scores["bad"]
    flat = search.held_scores(both.withColumn("raw", F.lit(1.0))).collect()
    assert all(r["score"] is None for r in flat)


@pytest.mark.parametrize("name", ["v29", "v31", "v32", "v35", "v42"])
def test_absent_features_count_as_zero(spark, name):
    smoke = synthetic.smoke_panel(spark)
    out = registry.run(smoke, name)
    assert out.count() == 24 * 3 and out.where("pred is null").count() == 0


@pytest.fixture(scope="module")
def small(spark):
    panel = synthetic.dataset(spark, 1, 30, 5).withColumn("f1", F.when(F.col("t") % 9 != 4, F.col("f1")))
    frame = panel.toPandas()
    return panel, {f: frame.pivot(index="t", columns="asset", values=f).astype(float) for f in [f"f{i}" for i in range(1, 7)]}


def plain_rank(x):
    return (x.rank(axis=1) - (x.shape[1] + 1) / 2) / (0.5 * (x.shape[1] - 1))


@pytest.mark.parametrize(("name", "count"), [("classic", 24), ("changes", 33), ("momenta", 42), ("four_ranks", 37), ("weighed_ranks", 38), ("agreement", 30), ("primary", 31), ("paths", 57), ("trails", 58), ("regimes", 38), ("moments", 52), ("broad", 75)])
def test_feature_sets_are_those_of_pandas(spark, small, name, count):
    from tessera.plans import features

    panel, f = small
    made = features.SETS[name](panel)
    names = features.feature_names(made)
    assert len(names) == len(set(names)) == count
    r = {k: plain_rank(x) for k, x in f.items()}
    mean = lambda k, n, m: f[k].rolling(n, min_periods=m).mean()
    std = lambda k, n, m: f[k].rolling(n, min_periods=m).std(ddof=0)
    robust_z = lambda k: (f[k].sub(f[k].median(axis=1), axis=0)).pipe(lambda d: d.div(1.4826 * d.abs().median(axis=1) + 1e-6, axis=0)).clip(-6, 6)
    four = np.stack([r[k].to_numpy() for k in ("f1", "f2", "f3", "f4")])
    want = {
        "f1_ewma5": f["f1"].ewm(span=5, adjust=False, min_periods=2).mean(),
        "f2_voladj": f["f2"].diff() / (std("f2", 20, 3).fillna(0) + 1e-6),
        "f2_mom20": mean("f2", 5, 2) - mean("f2", 20, 3),
        "f3_revert20": mean("f3", 20, 3) - f["f3"],
        "f1_rankchg": r["f1"].diff(),
        "f1_mom_spread": mean("f1", 5, 2) - mean("f1", 60, 5),
        "momentum_mean": sum(plain_rank(mean(k, 5, 2) - mean(k, 20, 3)) for k in ("f1", "f2", "f3")) / 3,
        "reversion_mean": sum(plain_rank(mean(k, 20, 3) - f[k]) for k in ("f1", "f2", "f3")) / 3,
        "rank_accel": sum(r[k].diff() for k in ("f1", "f2", "f3")) / 3,
        "raw_rank": sum(f[k] * r[k] for k in ("f1", "f2", "f3", "f4")) / 4,
        "f2_robust_z": robust_z("f2"),
        "f1_trend_accel": mean("f1", 5, 2) - 2 * mean("f1", 20, 3) + mean("f1", 60, 5),
        "rank_agree": (r["f1"] + r["f2"]) / 2,
        "f4_reversal8": f["f4"].ewm(span=8, adjust=False, min_periods=3).mean() - f["f4"],
        "f5_z10": (f["f5"] - mean("f5", 10, 3)) / (std("f5", 10, 3) + 1e-6),
        "f4_rank_persist": r["f4"] * r["f4"].shift(1),
        "f4_vol_ratio": std("f4", 5, 2) / (std("f4", 20, 4) + 1e-6),
        "relative": r["f4"] + r["f5"] - 2 * r["f6"],
    }
    ewm = lambda k, n, m: f[k].ewm(span=n, adjust=False, min_periods=m).mean()
    z = lambda k, n, m: (f[k] - mean(k, n, m)) / (std(k, n, m) + 1e-6)
    place = lambda k, n, m: (f[k] - f[k].rolling(n, min_periods=m).min()) / (f[k].rolling(n, min_periods=m).max() - f[k].rolling(n, min_periods=m).min() + 1e-6) - 0.5
    over_assets = lambda column: pd.DataFrame({a: column for a in f["f1"].columns})
    spread = lambda parts: plain_rank(pd.DataFrame(np.nanstd(np.stack(parts), axis=0), f["f1"].index, f["f1"].columns))
    moves, turns = {k: plain_rank(ewm(k, 4, 2) - ewm(k, 16, 4)) for k in f}, {k: plain_rank(f[k] - ewm(k, 4, 2)) for k in f}
    core = 0.55 * r["f1"] - 0.30 * r["f2"] + 0.15 * r["f3"]
    more = {
        "paths": {
            "f1_ew21": ewm("f1", 21, 5), "f1_ma60": mean("f1", 60, 8), "f1_z8": z("f1", 8, 3), "f1_z21": z("f1", 21, 5), "f1_mom3vol": f["f1"].diff(3) / (std("f1", 8, 3) + 1e-6),
            "f1_mom5vol": f["f1"].diff(5) / (std("f1", 21, 5) + 1e-6), "f1_ewspread": ewm("f1", 3, 2) - ewm("f1", 21, 5), "f1_rank_persist": r["f1"] + r["f1"].shift(1),
            "f1_rank_reversal": r["f1"].shift(1) - r["f1"], "f1_rank_lag3": r["f1"].shift(3), "f2_rank_d1": r["f2"].diff(), "f2_z10": z("f2", 10, 3), "f2_reversal": mean("f2", 5, 2) - f["f2"],
            "f3_rank_ma5": plain_rank(mean("f3", 5, 2)), "rank12_sum": r["f1"] + r["f2"], "rank13_product": r["f1"] * r["f3"], "core": core, "f1_trend3_21": mean("f1", 3, 2) - mean("f1", 21, 5),
            "f1_accel": f["f1"].diff() - f["f1"].diff().shift(1), "f1_demean": f["f1"].sub(f["f1"].median(axis=1), axis=0),
        },
        "trails": {
            "f3_lag2": f["f3"].shift(2), "f2_d5": f["f2"].diff(5), "f1_rank_persist": r["f1"] * r["f1"].shift(1), "f1_ew32": ewm("f1", 32, 5), "f1_vol21": std("f1", 21, 5),
            "f1_trend8_60": mean("f1", 8, 3) - mean("f1", 60, 8), "f1_mom5vol": f["f1"].diff(5) / (std("f1", 21, 5) + 1e-6), "f2_reversal5": mean("f2", 5, 2) - f["f2"],
            "f3_ma5rank": plain_rank(mean("f3", 5, 2)), "product12": r["f1"] * r["f2"], "core": core, "dispersion": spread([r[k].to_numpy() for k in f]),
        },
        "regimes": {
            "f1_mom3vol10": f["f1"].diff(3) / (std("f1", 10, 3) + 1e-6), "f1_mom5vol20": f["f1"].diff(5) / (std("f1", 20, 4) + 1e-6), "f1_rank_turnover": (r["f1"] - r["f1"].shift(1)).abs(),
            "f1_ewma_resid": f["f1"] - ewm("f1", 8, 3), "f1_range20": place("f1", 20, 4), "f1_vol_ratio": std("f1", 10, 3) / (std("f1", 20, 4) + 1e-6), "f3_ewma_resid": f["f3"] - ewm("f3", 8, 3),
            "f1_trend5_20": mean("f1", 5, 2) - mean("f1", 20, 4), "f2_reversal5": mean("f2", 5, 2) - f["f2"], "regime": over_assets(f["f1"].std(axis=1, ddof=0)), "rank13": r["f1"] - r["f3"],
        },
        "moments": {
            "f6_d1": plain_rank(f["f6"].diff()), "f5_rev": turns["f5"], "f4_mom": moves["f4"], "f2_vd1": plain_rank(f["f2"].diff() / (f["f2"].diff().rolling(12, min_periods=3).std(ddof=0) + 1e-6)),
            "f3_demean": f["f3"].sub(f["f3"].median(axis=1), axis=0), "proxy_rev": turns["f1"], "spread34": r["f3"] - r["f4"], "product56": r["f5"] * r["f6"], "mom12": moves["f1"] - moves["f2"],
            "revdisp": spread([turns[k].to_numpy() for k in f]), "momdisp": spread([moves[k].to_numpy() for k in f]),
        },
        "broad": {
            "f4_product": f["f4"] * r["f4"], "f6_diff1": f["f6"].diff(), "f3_diff5": f["f3"].diff(5), "f2_roll_z": (f["f2"] - mean("f2", 5, 2)) / (std("f2", 20, 3).fillna(0) + 1e-6),
            "f3_momspread": mean("f3", 5, 2) - mean("f3", 60, 5), "f1_ma20_rank": plain_rank(mean("f1", 20, 3)), "f2_rankchg": r["f2"].diff(), "mean": over_assets(f["f1"].mean(axis=1)),
            "std": over_assets(f["f1"].std(axis=1, ddof=0)), "above": over_assets(f["f1"].gt(f["f1"].median(axis=1), axis=0).mean(axis=1)), "rank12": r["f1"] - r["f2"],
        },
    }
    if name in more:
        want = more[name]
        assert set(want) <= set(names)
    if name in ("four_ranks", "weighed_ranks"):
        want["rank_dispersion"] = pd.DataFrame(four.std(axis=0), r["f1"].index, r["f1"].columns)
    got = made.toPandas()
    for n in set(want) & set(names):
        np.testing.assert_allclose(got.pivot(index="t", columns="asset", values=n).to_numpy(float), want[n].to_numpy(float), atol=1e-7, err_msg=n)
    narrow = features.SETS[name](panel.drop("f2", "f3", "f4", "f5", "f6"))
    assert narrow.count() == 150 and len(set(narrow.columns)) == len(narrow.columns)


def test_gate_is_that_of_numpy(spark, panel):
    out = registry.run(panel, "v10").toPandas().sort_values(["period", "t", "asset_ord"])
    for _, part in out.groupby(["period", "t"]):
        h = np.stack(part["heads"].to_numpy()) * [h.weight for h in MODELS["v10"].heads]
        linear, rank = h[:, 0] + h[:, 1], h[:, 2]
        gate = 0.75 + 0.25 * np.clip(np.corrcoef(linear, rank)[0, 1], 0, 1)
        want = np.clip(linear + gate * (rank + h[:, 3]), -part["limit"], part["limit"])
        np.testing.assert_allclose(part["pred"], want - want.mean(), atol=1e-9)


def test_primary_inputs():
    from tessera.plans.features import primary_inputs

    assert primary_inputs(["f1", "f2", "f3", "f4", "f5", "f6", "f7"]) == ["f4", "f5", "f6"]
    assert primary_inputs(["f1", "f2", "f3", "f4", "f5"]) == ["f4", "f5", "f3"]
    assert primary_inputs(["f1", "f2"]) == ["f1", "f2"]


def test_reports_are_whole_or_raise(spark):
    from tessera.sources import files

    frame = spark.range(10_001)
    assert files.as_json(frame).count('"id"') == 10_001
    with pytest.raises(ValueError, match="write_json"):
        files.as_json(frame, most=10_000)


def test_runs_of_each_period(spark):
    frame = spark.createDataFrame([(p, t, v) for p in (1, 2) for t, v in enumerate([1, 1, 0, 1, 0, 0, 1, 1, 1])] + [(3, 4, 1)], "period int, t int, v int")
    got = {tuple(r) for r in metrics.runs(frame, "v = 1").collect()}
    assert got == {(p, *x) for p in (1, 2) for x in ((0, 1, 2), (3, 3, 1), (6, 8, 3))} | {(3, 4, 4, 1)}
