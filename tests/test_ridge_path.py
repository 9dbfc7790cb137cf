"""The search for penalty and decay, against plain NumPy over the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans import ridge_path as R
from tessera.plans import registry, walkforward
from tessera.sources import synthetic

NAMES = ["f1", "f2", "f3"]


@pytest.fixture(scope="module")
def frame(spark):
    panel = synthetic.dataset(spark, 3, 70, 9)
    panel = panel.withColumn("y", F.when((F.col("t") % 11 != 4) & ((F.col("t") + F.col("asset_ord")) % 13 != 0), F.col("y"))).withColumn("f2", F.when(F.col("asset_ord") != 2, F.col("f2")))
    return walkforward.split(panel).cache()


def sharpe(pred, y):
    """Frames of timestamps by assets; rows without any target are left out before."""
    p, y = pred.fillna(0.0), y.fillna(0.0)
    p = p.sub(p.mean(axis=1), axis=0)
    got = (p.shift(1) * y).sum(axis=1).iloc[1:]
    return -1.0 if len(got) < 5 or got.std() == 0 else got.mean() / got.std()


def correlations(pred, y):
    out = []
    for t in y.index:
        have = y.loc[t].notna() & pred.loc[t].notna()
        a, b = pred.loc[t][have], y.loc[t][have]
        if have.sum() >= 3 and a.std(ddof=0) >= 1e-12 and b.std(ddof=0) >= 1e-12:
            out.append((t, np.corrcoef(a, b)[0, 1]))
    return out


def plain(pred, y):
    c = [v for _, v in correlations(pred, y)]
    ic, spread = (np.mean(c), np.std(c)) if c else (-1.0, 0.0)
    flat = 0.5 if pred.fillna(0.0).std(axis=1, ddof=0).median() < 1e-8 else 0.0
    return sharpe(pred, y) + 0.25 * ic - 0.15 * spread - flat


def stable(pred, y):
    n = len(y)
    rs = ri = -1.0
    last = y.index[int(n * 0.70) :]
    if n >= 3 and y.loc[last].notna().sum().sum() >= 10:
        rs = sharpe(pred.loc[last], y.loc[last])
        c = [v for _, v in correlations(pred.loc[last], y.loc[last])]
        ri = np.mean(c) if c else -1.0
    c = [v for _, v in correlations(pred, y)]
    blocks = []
    for i in range(4):
        at = y.index[i * n // 4 : (i + 1) * n // 4]
        if n >= 4 and y.loc[at].notna().sum().sum() >= 10:
            own = [v for _, v in correlations(pred.loc[at], y.loc[at])]
            blocks.append(np.mean(own) if own else -1.0)
    size = pred.fillna(0.0).std(axis=1, ddof=0).median()
    score = 0.30 * plain(pred, y) + 0.25 * rs + 0.20 * ri + 0.10 * np.mean(np.array(c) > 0) + 0.05 * np.log(size + 1e-8) - 0.15 * (np.std(blocks) if len(blocks) > 1 else 0.0) - (0.5 if size < 1e-8 else 0.0)
    return score, ri, rs


def scaled(early, late):
    out = [early.copy(), late.copy()]
    for n in NAMES:
        x, z = early[n].to_numpy(float), late[n].to_numpy(float)
        middle = np.nanmedian(x)
        x, z = np.where(np.isnan(x), middle, x), np.where(np.isnan(z), middle, z)
        low, high = np.quantile(x, 0.005), np.quantile(x, 0.995)
        x, z = np.clip(x, low, high), np.clip(z, low, high)
        centre = x.mean()
        size = 1.4826 * np.median(np.abs(x - centre))
        out[0][n], out[1][n] = (x - centre) / size, (z - centre) / size
    return out


def search(part):
    part = part.sort_values(["t", "asset_ord"])
    train = part[part["train"]]
    n = train["t"].max() + 1
    cut = max(1, min(n - 1, int(n * 0.80)))
    early, late = scaled(train[(train["t"] < cut) & train["y"].notna()], train[train["t"] >= cut])
    known = late.groupby("t")["y"].transform("count") > 0
    late = late[known]
    y = late.pivot(index="t", columns="asset", values="y")
    x, target = early[NAMES].to_numpy(), early["y"].to_numpy()
    start = target.mean()

    def pred(alpha, w):
        beta = np.linalg.solve((x * w[:, None]).T @ x + alpha * np.eye(3), x.T @ (w * (target - start)))
        made = late.assign(p=start + late[NAMES].to_numpy() @ beta)
        return made.pivot(index="t", columns="asset", values="p").where(y.notna())

    tried = {a: plain(pred(a, np.ones(len(x))), y) for a in R.ALPHAS}
    alpha = max(tried, key=tried.get)
    found = {}
    for decay in R.DECAYS:
        w = np.exp(-(len(x) - 1 - np.arange(len(x))) / max(1.0, len(x) * decay))
        found[decay] = stable(pred(alpha, w / w.mean()), y)
    best_ic, best_sharpe = max(f[1] for f in found.values()), max(f[2] for f in found.values())
    score = {d: s - 0.10 * (ic < best_ic - 0.05) - 0.10 * (sh < best_sharpe - 0.05) for d, (s, ic, sh) in found.items()}
    decay = max(score, key=score.get)
    return alpha, decay, score[decay], tried, found


def test_search_is_that_of_numpy(spark, frame):
    got = {r["period"]: r for r in R.search(frame, NAMES).collect()}
    for period, part in frame.toPandas().groupby("period"):
        alpha, decay, score, _, _ = search(part)
        assert (got[period]["alpha"], got[period]["decay"]) == (alpha, decay)
        np.testing.assert_allclose(got[period]["score"], score, atol=1e-9)


def test_scores_are_those_of_numpy(spark, frame):
    """Every candidate's two scores, not the best one's alone."""
    early, late = R.sides(frame, NAMES)
    from tessera.operators import sampling

    tried = R.path(sampling.even_rows(early, R.ROWS, positions=True), NAMES, R.ALPHAS, [None, *R.DECAYS])
    got = {(r["period"], r["candidate"]): r for r in R.scores(R.by_timestamp(R.predicted(late, NAMES, tried))).collect()}
    assert len(got) == 3 * 25
    for period, part in frame.toPandas().groupby("period"):
        alpha, _, _, tried, found = search(part)
        np.testing.assert_allclose([got[period, f"{a:g}"]["plain"] for a in R.ALPHAS], list(tried.values()), atol=1e-9)
        for decay, (score, ic, sh) in found.items():
            row = got[period, f"{alpha:g}/{decay:g}"]
            np.testing.assert_allclose([row["stable"], row["recent_ic"], row["recent_sharpe"]], [score, ic, sh], atol=1e-9)


def test_flat_predictions_and_short_periods(spark):
    rows = [(1, "a", t, x, float(t * x % 7), 0.0) for t in range(3) for x in (1, 2)] + [(2, "a", t, x, float(t * x % 7) if t else None, float(x)) for t in range(2) for x in (1, 2)]
    frame = spark.createDataFrame(rows, "period int, candidate string, t int, asset int, y double, pred double")
    got = {r["period"]: r for r in R.scores(R.by_timestamp(frame)).collect()}
    assert got[1]["plain"] == -1.0 - 0.25 - 0.5  # too few returns, no correlation, flat
    assert got[2]["recent_ic"] == got[2]["recent_sharpe"] == -1.0
    assert R.scores(R.by_timestamp(frame.limit(0))).count() == 0


def test_v01_uses_what_was_chosen(spark):
    panel = synthetic.dataset(spark, 2, 60, 6)
    out = registry.run(panel, "v01").toPandas()
    assert len(out) == 2 * 12 * 6 and not out.duplicated(["period", "t", "asset"]).any()
    assert out.groupby(["period", "t"])["pred"].mean().abs().max() < 1e-9 and (out["pred"] != 0).any()
    corr = [np.corrcoef(g["pred"], g["y"])[0, 1] for _, g in out.groupby(["period", "t"])]
    assert np.mean(corr) > 0.3


def test_delta_steps_are_those_of_numpy():
    from tessera.plans import engine

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = x @ np.array([1.0, -2.0]) + rng.normal(size=300)
    y[:10] += 20
    rows = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "t": np.arange(300), "asset_ord": 0, "position": np.arange(300), "total": 300, "y_next": np.nan, "y_ahead": np.nan, "y_slow": np.nan})
    model = engine.Model("m", (engine.Head(1.0, alpha=4.0, delta=1.0),), decay=0.3, scale="std", quantile=0.0, extra={"plain_start": True})
    fitted = engine.fit_sample(model, ["a", "b"], rows)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = engine.fading(np.arange(300.0), np.full(300, 300.0), 0.3)
    solve = lambda w, a: np.linalg.solve((z * w[:, None]).T @ z + a * np.eye(2), z.T @ (w * (y - y.mean())))
    beta = solve(w, 4.0)
    for _ in range(2):
        far = np.abs(y - y.mean() - z @ beta)
        beta = solve(w * np.where(far > 1, 1 / far, 1.0), 8.0)
    np.testing.assert_allclose(fitted.heads[0][-1], beta, atol=1e-9)
