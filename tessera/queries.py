"""Queries over the panels, each with SQL for the same rows.

``P`` in the SQL is the trade panel with its target: period, t, asset, asset_ord, f1..f6, y.
Doubles are rounded to six digits at the very end, in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import windows as W
from tessera.operators import gauge, joins, linear, neutral, preprocess, robust, sampling, selection
from tessera.plans import features as sets
from tessera.plans import choices, finish, metrics, models, ridge_path, signals
from tessera.plans.lineage import cut
from tessera.plans.walkforward import split, walk_forward
from tessera.sources import panels, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TRADE = """
cell AS (
  SELECT CAST(extract(year from date_trunc('week', l.l_shipdate)) AS INT) AS period, date_trunc('week', l.l_shipdate) AS time, n.n_name AS asset,
         CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS f1,
         CAST(sum(CAST(round(l.l_quantity) AS BIGINT)) AS DOUBLE) / count(*) AS f2,
         CAST(sum(CAST(round(l.l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS f3,
         CAST(sum(CAST(round(l.l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS f4,
         CAST(count(*) AS DOUBLE) AS f5,
         CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS BIGINT))) AS DOUBLE) / 10000 AS f6
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2, 3),
ts AS (SELECT period, time, CAST(dense_rank() OVER (PARTITION BY period ORDER BY time) - 1 AS INT) AS t FROM (SELECT DISTINCT period, time FROM cell) d),
grid AS (
  SELECT g.period, g.time, g.t, CAST(a.n_name AS VARCHAR) AS asset, CAST(a.n_nationkey AS INT) AS asset_ord, c.f1, c.f2, c.f3, c.f4, c.f5, c.f6
  FROM ts g CROSS JOIN nation a LEFT JOIN cell c ON c.period = g.period AND c.time = g.time AND c.asset = a.n_name),
moved AS (SELECT *, f1 - lag(f1) OVER (PARTITION BY period, asset ORDER BY t) AS y0 FROM grid),
p AS (SELECT * EXCLUDE (y0), y0 - avg(y0) OVER (PARTITION BY period, t) AS y FROM moved)"""
EVENTS = """
cell AS (
  SELECT date_trunc('hour', ts) AS time, event_type AS asset, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS f1, CAST(count(*) AS DOUBLE) AS f2,
         CAST(max(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS f3, CAST(count(DISTINCT user_id) AS DOUBLE) AS f4 FROM events GROUP BY 1, 2),
tt AS (SELECT time, CAST(extract(day from time) AS INT) AS d FROM (SELECT DISTINCT time FROM cell) q),
ts AS (SELECT CAST(floor((d - 1) / 7) AS INT) AS period, time, CAST(dense_rank() OVER (PARTITION BY CAST(floor((d - 1) / 7) AS INT) ORDER BY time) - 1 AS INT) AS t FROM tt),
assets AS (SELECT asset, CAST(row_number() OVER (ORDER BY asset) - 1 AS INT) AS asset_ord FROM (SELECT DISTINCT event_type AS asset FROM events) q),
p AS (SELECT g.period, g.time, g.t, a.asset, a.asset_ord, c.f1, c.f2, c.f3, c.f4 FROM ts g CROSS JOIN assets a LEFT JOIN cell c ON c.time = g.time AND c.asset = a.asset)"""

KEYS = ["period", "t", "asset"]
WA, WT = "(PARTITION BY period, asset ORDER BY t)", "(PARTITION BY period, t)"


def roll_sql(function: str, x: str, rows: int, least: int) -> str:
    w = f"(PARTITION BY period, asset ORDER BY t ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN {function}({x}) OVER {w} END"


def rank_sql(x: str, over: str = "period, t") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {over} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {over}, {x}) - 1) / 2.0::DOUBLE END"


def centred_sql(x: str) -> str:
    return f"(({rank_sql(x)}) - (count(*) OVER {WT} + 1) / 2.0::DOUBLE) / (0.5::DOUBLE * greatest(count(*) OVER {WT} - 1, 1))"


def percent_sql(x: str, over: str = "period, t") -> str:
    return f"({rank_sql(x, over)}) / count({x}) OVER (PARTITION BY {over})"


def six(x: Column | str) -> Column:
    return F.round(W.column(x), 6) + F.lit(0.0)


#: Cents over counts and shares of ranks are often halves in the seventh digit, where a sum's order decides; nine digits have none.
RATIOS = {"sharpe", "ic", "ic_std", "concentration", "compression", "compression_loss", "ic_dispersion_corr", "pred_scale"}


def digits(name: str) -> int:
    return 9 if name in RATIOS else 6


def fine(name: str) -> Column:
    return F.round(F.col(name), digits(name)) + F.lit(0.0)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.with_target(panels.trade_panel(spark, sf_dir))


def register(name: str, query: Query, sql: str | None = None, base: str = TRADE) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = f"WITH {base}\n{sql}"


def columns(name: str, spark_columns: Callable[[], dict[str, Column]], sql_columns: dict[str, str], steps: Callable[[DataFrame], DataFrame] | None = None, sql_steps: str = "", source: str = "p") -> None:
    """A query of the keys and rounded columns. ``steps`` and ``sql_steps`` add columns before."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = trade(spark, sf_dir)
        frame = steps(frame) if steps else frame
        made = spark_columns()
        return frame.select(*KEYS, *(c.alias(n) for n, c in made.items())).select(*KEYS, *(six(n).alias(n) for n in made))

    picked = ", ".join(f"{c} AS {n}" for n, c in sql_columns.items())
    rounded = ", ".join(f"round({n}, 6) + 0 AS {n}" for n in sql_columns)
    register(name, query, f"{sql_steps}, picked AS (SELECT period, t, asset, {picked} FROM {source}) SELECT period, t, asset, {rounded} FROM picked")


# -- sources and reshapes --------------------------------------------------------

register("panel_trade", lambda s, d: panels.trade_panel(s, d).select("period", "t", "asset", "asset_ord", *(six(f"f{i}").alias(f"f{i}") for i in range(1, 7))), "SELECT period, t, asset, asset_ord, " + ", ".join(f"round(f{i}, 6) + 0 AS f{i}" for i in range(1, 7)) + " FROM p")
register("panel_events", lambda s, d: panels.event_panel(s, d).select("period", "t", "asset", "asset_ord", *(six(f"f{i}").alias(f"f{i}") for i in range(1, 5))), "SELECT period, t, asset, asset_ord, " + ", ".join(f"round(f{i}, 6) + 0 AS f{i}" for i in range(1, 5)) + " FROM p", EVENTS)
register("numeric_coercion", lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(W.clean(F.col("o_orderstatus"))).alias("numbers"), F.count(W.clean(F.col("o_totalprice").cast("string"))).alias("prices")), ", q AS (SELECT o_orderstatus AS status, count(TRY_CAST(o_orderstatus AS DOUBLE)) AS numbers, count(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE)) AS prices FROM orders GROUP BY 1) SELECT * FROM q")
register("melt", lambda s, d: panels.melt(trade(s, d).select(*KEYS, "f1", "f2", "f3"), ["f1", "f2", "f3"]).select(*KEYS, "feature", six("value").alias("value")), "SELECT period, t, asset, feature, round(value, 6) + 0 AS value FROM (" + " UNION ALL ".join(f"SELECT period, t, asset, 'f{i}' AS feature, f{i} AS value FROM p" for i in (1, 2, 3)) + ") q")


#: The dimension of the trade panel: its nations by number.
NATIONS = [f"NATION_{i}" for i in range(25)]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panels.to_wide(trade(spark, sf_dir), "f1", NATIONS)
    return out.select("period", "t", *(six(n).alias(n.lower()) for n in NATIONS))


register("pivot_wide", wide, "SELECT period, t, " + ", ".join(f"round(coalesce(max(CASE WHEN asset = '{n}' THEN f1 END), 0), 6) + 0 AS {n.lower()}" for n in NATIONS) + " FROM p GROUP BY period, t")
register("ordered_distinct", lambda s, d: trade(s, d).groupBy("asset").agg(F.min("asset_ord").alias("first_seen")), "SELECT asset, min(asset_ord) AS first_seen FROM p GROUP BY asset")
register("target_normaliser", lambda s, d: trade(s, d).select(*KEYS, six("y").alias("y")), "SELECT period, t, asset, round(y, 6) + 0 AS y FROM p")
register("labelled_rows", lambda s, d: trade(s, d).where("y is not null").groupBy("period").agg(F.count(F.lit(1)).alias("n")), "SELECT period, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY period")
register("forward_label_survivors", lambda s, d: trade(s, d).where("y is not null").select(*KEYS, (0.72 * W.lead("y", 1) + 0.28 * W.lead("y", 2)).alias("slow"), W.lead("y").alias("ahead")).select(*KEYS, six("ahead").alias("ahead"), six("slow").alias("slow")), f", s AS (SELECT period, t, asset, lead(y) OVER {WA} AS ahead, 0.72::DOUBLE * lead(y) OVER {WA} + 0.28::DOUBLE * lead(y, 2) OVER {WA} AS slow FROM p WHERE y IS NOT NULL) SELECT period, t, asset, round(ahead, 6) + 0 AS ahead, round(slow, 6) + 0 AS slow FROM s")
register("forward_label_positional", lambda s, d: trade(s, d).withColumn("ahead", W.lead("y")).withColumn("last", F.max("t").over(Window.partitionBy("period"))).where("t < last and ahead is not null").select(*KEYS, six("ahead").alias("ahead")), f", s AS (SELECT period, t, asset, lead(y) OVER {WA} AS ahead, max(t) OVER (PARTITION BY period) AS last FROM p) SELECT period, t, asset, round(ahead, 6) + 0 AS ahead FROM s WHERE t < last AND ahead IS NOT NULL")
register("history_tail", lambda s, d: sampling.tail(trade(s, d), 8).select(*KEYS, six("f1").alias("f1")), ", s AS (SELECT *, max(t) OVER (PARTITION BY period) AS last FROM p) SELECT period, t, asset, round(f1, 6) + 0 AS f1 FROM s WHERE t > last - 8")
register("period_subset", lambda s, d: trade(s, d).where(F.col("period").isin(1995, 1996)).groupBy("period").agg(F.count("f1").alias("n")), "SELECT period, count(f1) AS n FROM p WHERE period IN (1995, 1996) GROUP BY period")
register("shape_safe", lambda s, d: trade(s, d).select(*KEYS, (F.coalesce(F.col("f1"), F.lit(0.0)) - F.avg(F.coalesce(F.col("f1"), F.lit(0.0))).over(X.by_time())).alias("v")).select(*KEYS, six("v").alias("v")), f", s AS (SELECT period, t, asset, coalesce(f1, 0) - avg(coalesce(f1, 0)) OVER {WT} AS v FROM p) SELECT period, t, asset, round(v, 6) + 0 AS v FROM s")

# -- joins -----------------------------------------------------------------------

register("join_align", lambda s, d: joins.align(trade(s, d).where("f1 is not null").select(*KEYS, "f1"), trade(s, d).where("y is not null").select(*KEYS, "y")).select(*KEYS, six("f1").alias("f1"), six("y").alias("y")), "SELECT period, t, asset, round(f1, 6) + 0 AS f1, round(y, 6) + 0 AS y FROM p WHERE f1 IS NOT NULL AND y IS NOT NULL")
register("join_reindex", lambda s, d: joins.reindex(trade(s, d).where("f1 > 4000000").select(*KEYS, "f1"), trade(s, d).select(*KEYS)).select(*KEYS, six("f1").alias("f1")), "SELECT period, t, asset, round(CASE WHEN f1 > 4000000 THEN f1 END, 6) + 0 AS f1 FROM p")
register("join_members", lambda s, d: joins.members(trade(s, d), trade(s, d).groupBy("period", "t").agg(F.count("f1").alias("n")).where("n = 25").select("period", "t"), ["period", "t"]).groupBy("period").agg(F.count(F.lit(1)).alias("n")), ", full_rows AS (SELECT period, t FROM p GROUP BY 1, 2 HAVING count(f1) = 25) SELECT period, count(*) AS n FROM p SEMI JOIN full_rows USING (period, t) GROUP BY period")
register("join_group_mean", lambda s, d: trade(s, d).select(*KEYS, X.mean("f1").alias("v")).select(*KEYS, six("v").alias("v")), f", s AS (SELECT period, t, asset, avg(f1) OVER {WT} AS v FROM p) SELECT period, t, asset, round(v, 6) + 0 AS v FROM s")
register("join_suffixes", lambda s, d: joins.merge(trade(s, d).groupBy("period").agg(F.avg("f2").alias("v")), trade(s, d).groupBy("period").agg(F.avg("f3").alias("v")), ["period"]).select("period", six("v_a").alias("v_a"), six("v_b").alias("v_b")), "SELECT period, round(avg(f2), 6) + 0 AS v_a, round(avg(f3), 6) + 0 AS v_b FROM p GROUP BY period")

# -- series windows ---------------------------------------------------------------

columns("w_lag", lambda: {f"lag{k}": W.lag("f1", k) for k in (1, 2, 3, 5)}, {f"lag{k}": f"lag(f1, {k}) OVER {WA}" for k in (1, 2, 3, 5)})
columns("w_diff", lambda: {f"diff{k}": W.diff("f1", k) for k in (1, 3, 5)}, {f"diff{k}": f"f1 - lag(f1, {k}) OVER {WA}" for k in (1, 3, 5)})
FRAMES = ((3, 2), (5, 2), (8, 3), (10, 3), (20, 4), (60, 5))
columns("w_roll_mean", lambda: {f"ma{n}": W.roll_mean("f1", n, m) for n, m in FRAMES}, {f"ma{n}": roll_sql("avg", "f1", n, m) for n, m in FRAMES})
columns("w_roll_std", lambda: {f"sd{n}": W.roll_std("f2", n, m) for n, m in FRAMES}, {f"sd{n}": roll_sql("stddev_pop", "f2", n, m) for n, m in FRAMES})
columns("w_roll_minmax", lambda: {"low": W.roll_min("f1", 10, 3), "high": W.roll_max("f1", 20, 4)}, {"low": roll_sql("min", "f1", 10, 3), "high": roll_sql("max", "f1", 20, 4)})


def ewma_sql(x: str, span: int, least: int, name: str) -> str:
    q, alpha = 1 - 2 / (span + 1), 2 / (span + 1)
    before = "(PARTITION BY period, asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    old = f"pow({q!r}::DOUBLE, t - t0)"
    return f"""
, {name}_a AS (SELECT *, last_value(CASE WHEN {x} IS NOT NULL THEN t END IGNORE NULLS) OVER {before} AS t0 FROM p),
{name}_b AS (SELECT *, CASE WHEN {x} IS NOT NULL AND t0 IS NOT NULL THEN ln({old} / ({old} + {alpha!r})) ELSE 0 END AS lg,
       CASE WHEN {x} IS NOT NULL AND t0 IS NOT NULL THEN {alpha!r} / ({old} + {alpha!r}) * {x} ELSE coalesce({x}, 0) END AS ad FROM {name}_a),
{name}_c AS (SELECT *, sum(lg) OVER (PARTITION BY period, asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM {name}_b),
{name} AS (SELECT *, CASE WHEN count({x}) OVER (PARTITION BY period, asset ORDER BY t ROWS UNBOUNDED PRECEDING) >= {least} THEN exp(s) * sum(exp(-s) * ad) OVER (PARTITION BY period, asset ORDER BY t ROWS UNBOUNDED PRECEDING) END AS ew FROM {name}_c)"""


columns("w_ewma", lambda: {"ew": F.col("ew")}, {"ew": "ew"}, lambda f: W.with_ewma(f, {"ew": ("f1", 5, 2)}), ewma_sql("f1", 5, 2, "e5"), "e5")
columns("w_ewma_slow", lambda: {"ew": F.col("ew")}, {"ew": "ew"}, lambda f: W.with_ewma(f, {"ew": ("f2", 21, 5)}), ewma_sql("f2", 21, 5, "e21"), "e21")
MA5, MA20, MA60, SD20 = roll_sql("avg", "f1", 5, 2), roll_sql("avg", "f1", 20, 4), roll_sql("avg", "f1", 60, 5), roll_sql("stddev_pop", "f1", 20, 4)


# columns need a session, so they are made when a query runs
def ma5() -> Column:
    return W.roll_mean("f1", 5, 2)


def ma20() -> Column:
    return W.roll_mean("f1", 20, 4)


def ma60() -> Column:
    return W.roll_mean("f1", 60, 5)


def sd20() -> Column:
    return W.roll_std("f1", 20, 4)


columns("w_roll_z", lambda: {"z": W.zscore("f1", ma5(), sd20())}, {"z": f"(f1 - ({MA5})) / (({SD20}) + 1e-6)"})
columns("w_mom_spread", lambda: {"short": ma5() - ma20(), "long": ma5() - ma60()}, {"short": f"({MA5}) - ({MA20})", "long": f"({MA5}) - ({MA60})"})
columns("w_vol_adjusted", lambda: {"v": W.diff("f1") / (sd20() + W.EPS), "m3": W.diff("f1", 3) / (sd20() + W.EPS), "m5": W.diff("f1", 5) / (sd20() + W.EPS)}, {"v": f"(f1 - lag(f1) OVER {WA}) / (({SD20}) + 1e-6)", "m3": f"(f1 - lag(f1, 3) OVER {WA}) / (({SD20}) + 1e-6)", "m5": f"(f1 - lag(f1, 5) OVER {WA}) / (({SD20}) + 1e-6)"})
columns("w_acceleration", lambda: {"v": W.acceleration("f1"), "trend": ma5() - 2 * ma20() + ma60()}, {"v": f"f1 - 2 * lag(f1) OVER {WA} + lag(f1, 2) OVER {WA}", "trend": f"({MA5}) - 2 * ({MA20}) + ({MA60})"})
columns("w_reversal", lambda: {"r5": ma5() - F.col("f1"), "r20": ma20() - F.col("f1")}, {"r5": f"({MA5}) - f1", "r20": f"({MA20}) - f1"})
columns("w_range_position", lambda: {"r10": W.range_position("f1", 10, 3), "r20": W.range_position("f1", 20, 4)}, {f"r{n}": f"(f1 - ({roll_sql('min', 'f1', n, m)})) / (({roll_sql('max', 'f1', n, m)}) - ({roll_sql('min', 'f1', n, m)}) + 1e-6) - 0.5" for n, m in ((10, 3), (20, 4))})
columns("w_vol_ratio", lambda: {"v": W.roll_std("f1", 10, 3) / (sd20() + W.EPS)}, {"v": f"({roll_sql('stddev_pop', 'f1', 10, 3)}) / (({SD20}) + 1e-6)"})
columns("w_rank_history", lambda: {"lag1": W.lag("r"), "change": W.diff("r"), "persistence": F.col("r") * W.lag("r"), "turnover": F.abs(W.diff("r"))}, {"lag1": f"lag(r) OVER {WA}", "change": f"r - lag(r) OVER {WA}", "persistence": f"r * lag(r) OVER {WA}", "turnover": f"abs(r - lag(r) OVER {WA})"}, lambda f: f.withColumn("r", X.centred_rank("f1")), f", r AS (SELECT *, {centred_sql('f1')} AS r FROM p)", "r")


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split(trade(spark, sf_dir))
    whole = sampling.bridge(parts.where("train"), parts.where("not train"), 64)
    return whole.withColumn("v", ma20()).where("is_new").select(*KEYS, six("v").alias("v"))


SPLIT = ", sizes AS (SELECT period, max(t) + 1 AS n FROM p GROUP BY period), sp AS (SELECT p.*, t < n - greatest(2, least(800, ceil(n * 0.2::DOUBLE))) AS train FROM p JOIN sizes USING (period) WHERE n - greatest(2, least(800, ceil(n * 0.2::DOUBLE))) >= 10)"
register("w_history_bridge", bridge, f"{SPLIT}, s AS (SELECT *, {MA20} AS v FROM sp) SELECT period, t, asset, round(v, 6) + 0 AS v FROM s WHERE NOT train")


def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = trade(spark, sf_dir).groupBy("period", "t").agg(F.stddev_pop("f1").alias("d"))
    w = Window.partitionBy("period").orderBy("t").rowsBetween(-19, 0)
    base = F.when(F.count("d").over(w) >= 3, F.avg("d").over(w))
    return spread.select("period", "t", (F.col("d") / (F.abs(base) + W.EPS)).alias("v")).select("period", "t", six("v").alias("v"))


register("w_regime_baseline", regime, ", d AS (SELECT period, t, stddev_pop(f1) AS d FROM p GROUP BY 1, 2), s AS (SELECT period, t, d / (abs(CASE WHEN count(d) OVER w >= 3 THEN avg(d) OVER w END) + 1e-6) AS v FROM d WINDOW w AS (PARTITION BY period ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT period, t, round(v, 6) + 0 AS v FROM s")

# -- cross-sections -----------------------------------------------------------------

columns("x_centred_rank", lambda: {f"r{i}": X.centred_rank(f"f{i}") for i in (1, 2, 3)}, {f"r{i}": centred_sql(f"f{i}") for i in (1, 2, 3)})
columns("x_percent_rank", lambda: {f"r{i}": X.percent_rank(f"f{i}") for i in (1, 2, 5)}, {f"r{i}": percent_sql(f"f{i}") for i in (1, 2, 5)})
columns("x_ordinal_rank", lambda: {"r": X.ordinal_rank("f5")}, {"r": f"2.0::DOUBLE * (row_number() OVER (PARTITION BY period, t ORDER BY f5 NULLS FIRST, asset_ord) - 1) / greatest(count(*) OVER {WT} - 1, 1) - 1.0"})
columns("x_demean", lambda: {"v": X.demean("f1")}, {"v": f"f1 - avg(f1) OVER {WT}"})
columns("x_median_demean", lambda: {"v": X.median_demean("f1")}, {"v": f"f1 - median(f1) OVER {WT}"})


def robust_steps(frame: DataFrame) -> DataFrame:
    return frame.withColumn("dev", X.median_demean("f2")).withColumn("mad", X.median(F.abs(F.col("dev"))))


columns("x_robust_z", lambda: {"z": X.over_deviation("dev", "mad", 6.0)}, {"z": "CASE WHEN dev IS NOT NULL AND mad <> 0 THEN least(greatest(dev / (1.4826 * mad + 1e-6), -6), 6) END"}, robust_steps, f", m1 AS (SELECT *, f2 - median(f2) OVER {WT} AS dev FROM p), m2 AS (SELECT *, median(abs(dev)) OVER {WT} AS mad FROM m1)", "m2")
columns("x_universe", lambda: {"mean": X.mean("f1"), "std": X.dispersion("f1"), "above": X.above_median("f1")}, {"mean": f"avg(f1) OVER {WT}", "std": f"stddev_pop(f1) OVER {WT}", "above": f"avg(CASE WHEN f1 > med THEN 1.0::DOUBLE ELSE 0 END) OVER {WT}"}, lambda f: f.withColumn("__median", X.median("f1")), f", m AS (SELECT *, median(f1) OVER {WT} AS med FROM p)", "m")
columns("x_dispersion", lambda: {"v": X.dispersion("f6")}, {"v": f"stddev_pop(f6) OVER {WT}"})
RANKED = ", rk AS (SELECT *, " + ", ".join(f"{centred_sql(f'f{i}')} AS r{i}" for i in (1, 2, 3)) + " FROM p)"
with_ranks = lambda f: f.select("*", *(X.centred_rank(f"f{i}").alias(f"r{i}") for i in (1, 2, 3)))
r1, r2, r3 = (lambda: F.col("r1")), (lambda: F.col("r2")), (lambda: F.col("r3"))
columns("x_rank_mix", lambda: {"spread": r1() - r2(), "total": r1() + r2(), "product": r1() * r2(), "agree": 0.5 * (r1() + r2()), "core": 0.55 * r1() - 0.30 * r2() + 0.15 * r3(), "curve": r1() + r2() - 2 * r3()}, {"spread": "r1 - r2", "total": "r1 + r2", "product": "r1 * r2", "agree": "0.5::DOUBLE * (r1 + r2)", "core": "0.55::DOUBLE * r1 - 0.30::DOUBLE * r2 + 0.15::DOUBLE * r3", "curve": "r1 + r2 - 2 * r3"}, with_ranks, RANKED, "rk")
columns("x_rank_mean", lambda: {"mean": X.row_mean([r1(), r2(), r3()]), "spread": X.row_spread([r1(), r2(), r3()])}, {"mean": "(r1 + r2 + r3) / 3", "spread": "CASE WHEN r1 + r2 + r3 IS NOT NULL THEN sqrt(greatest((r1 * r1 + r2 * r2 + r3 * r3) / 3 - ((r1 + r2 + r3) / 3) * ((r1 + r2 + r3) / 3), 0)) END"}, with_ranks, RANKED, "rk")
columns("x_consensus", lambda: {"mean": X.present_mean([r1(), r2(), r3()]), "spread": X.present_spread([r1(), r2(), r3()]), "width": X.present_range([r1(), r2(), r3()])}, {"mean": "list_avg([r1, r2, r3])", "spread": "list_stddev_pop([r1, r2, r3])", "width": "greatest(r1, r2, r3) - least(r1, r2, r3)"}, with_ranks, RANKED, "rk")
columns("x_interaction", lambda: {"v": F.col("f1") * r1(), "mean": (F.col("f1") * r1() + F.col("f2") * r2()) / 2}, {"v": "f1 * r1", "mean": "(f1 * r1 + f2 * r2) / 2"}, with_ranks, RANKED, "rk")
columns("x_momentum_mean", lambda: {"momentum": (F.col("m1") + F.col("m2")) / 2, "reversion": (F.col("v1") + F.col("v2")) / 2}, {"momentum": "(m1 + m2) / 2", "reversion": "(v1 + v2) / 2"}, lambda f: f.select("*", *(W.diff(f"f{i}", 5).alias(f"m{i}") for i in (1, 2)), *((W.roll_mean(f"f{i}", 20, 3) - F.col(f"f{i}")).alias(f"v{i}") for i in (1, 2))), ", mm AS (SELECT *, " + ", ".join(f"f{i} - lag(f{i}, 5) OVER {WA} AS m{i}, ({roll_sql('avg', f'f{i}', 20, 3)}) - f{i} AS v{i}" for i in (1, 2)) + " FROM p)", "mm")
columns("x_ranked_momentum", lambda: {"d1": X.centred_rank("a"), "vol": X.centred_rank("b")}, {"d1": centred_sql("a"), "vol": centred_sql("b")}, lambda f: f.withColumn("a", W.diff("f1")).withColumn("b", F.col("a") / (W.roll_std("f1", 12, 3) + W.EPS)), f", a1 AS (SELECT *, f1 - lag(f1) OVER {WA} AS a FROM p), a2 AS (SELECT *, a / (({roll_sql('stddev_pop', 'f1', 12, 3)}) + 1e-6) AS b FROM a1)", "a2")


def corr_sql(a: str, b: str) -> str:
    n, sa, sb = f"count({a} * {b})", f"sum(CASE WHEN {b} IS NOT NULL THEN {a} END)", f"sum(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    va = f"greatest(sum(CASE WHEN {b} IS NOT NULL THEN {a} * {a} END) - {sa} * {sa} / nullif({n}, 0), 0)"
    vb = f"greatest(sum(CASE WHEN {a} IS NOT NULL THEN {b} * {b} END) - {sb} * {sb} / nullif({n}, 0), 0)"
    return f"CASE WHEN sqrt({va} * {vb}) > 1e-12 THEN (sum({a} * {b}) - {sa} * {sb} / {n}) / sqrt({va} * {vb}) ELSE 0 END"


register("x_row_correlation", lambda s, d: trade(s, d).groupBy("period", "t").agg(*X.correlation_sums("f2", "f3")).select("period", "t", six(X.correlation()).alias("c")), f"SELECT period, t, round({corr_sql('f2', 'f3')}, 6) + 0 AS c FROM p GROUP BY period, t")
columns("x_rank_target", lambda: {"v": 2 * (X.percent_rank("y") - 0.5)}, {"v": f"2 * ({percent_sql('y')} - 0.5::DOUBLE)"})
columns("x_z_target", lambda: {"v": X.clip(F.col("y") / F.coalesce(F.when(F.stddev_samp("y").over(X.by_time()) >= 1e-6, F.stddev_samp("y").over(X.by_time())), F.lit(1.0)), -2.5, 2.5)}, {"v": f"CASE WHEN y IS NOT NULL THEN least(greatest(y / coalesce(CASE WHEN stddev_samp(y) OVER {WT} >= 1e-6 THEN stddev_samp(y) OVER {WT} END, 1), -2.5), 2.5) END"})
columns("x_agreement_gate", lambda: {"gate": 0.75 + 0.25 * X.clip(X.window_correlation("f2", "r2"), 0, 1)}, {"gate": f"0.75 + 0.25 * least(greatest(CASE WHEN sqrt(va * vb) > 1e-12 THEN (ab - ma * mb) / sqrt(va * vb) ELSE 0 END, 0), 1)"}, with_ranks, RANKED + f", g AS (SELECT *, avg(f2) OVER {WT} AS ma, avg(r2) OVER {WT} AS mb, avg(f2 * r2) OVER {WT} AS ab, greatest(avg(f2 * f2) OVER {WT} - (avg(f2) OVER {WT}) ^ 2, 0) AS va, greatest(avg(r2 * r2) OVER {WT} - (avg(r2) OVER {WT}) ^ 2, 0) AS vb FROM rk)", "g")


def orthogonal(frame: DataFrame) -> DataFrame:
    frame = frame.withColumn("base", F.coalesce(X.demean("f3"), F.lit(0.0)))
    return neutral.orthogonalise(frame, "f2", "base", "v").withColumn("v", F.round("v", 9))


# means of whole numbers over counts are halves in the seventh digit now and then: nine digits first, and a sixth that falls on no half
columns("x_orthogonal", lambda: {"v": F.col("v") + 1e-7 / 3}, {"v": f"round(a2 - avg(a2) OVER {WT}, 9) + 1e-7 / 3"}, orthogonal, f", o1 AS (SELECT *, coalesce(f2 - avg(f2) OVER {WT}, 0) AS a, coalesce(f3 - avg(f3) OVER {WT}, 0) AS b FROM p), o2 AS (SELECT *, a - CASE WHEN sum(b * b) OVER {WT} > 1e-10 THEN sum(a * b) OVER {WT} / sum(b * b) OVER {WT} ELSE 0 END * b AS a2 FROM o1)", "o2")
register("x_proxy_correlation", lambda s, d: trade(s, d).agg(*X.correlation_sums("y", "f2", "_2"), *X.correlation_sums("y", "f3", "_3")).select(six(F.greatest(F.abs(X.correlation("_2")), F.abs(X.correlation("_3")))).alias("most")), f"SELECT round(greatest(abs({corr_sql('y', 'f2')}), abs({corr_sql('y', 'f3')})), 6) + 0 AS most FROM p")

PRED = f", raw AS (SELECT period, t, asset, asset_ord, y, coalesce({centred_sql('f1')}, 0) AS raw FROM p), pr AS (SELECT *, raw - avg(raw) OVER {WT} AS pred FROM raw)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction without a model: the rank of the first feature."""
    return finish.fallback(trade(spark, sf_dir))


register("m_fallback", lambda s, d: predicted(s, d).select(*KEYS, six("pred").alias("pred")), f"{PRED} SELECT period, t, asset, round(pred, 6) + 0 AS pred FROM pr")
register("x_conviction", lambda s, d: finish.conviction_finish(predicted(s, d)).select(*KEYS, six("pred").alias("pred")), f"{PRED}, c1 AS (SELECT *, 2 * {percent_sql('pred')} - 1 AS sc, stddev_pop(pred) OVER {WT} AS sd FROM pr), c2 AS (SELECT *, 0.8::DOUBLE * sign(sc) * pow(abs(sc), 1.25) * CASE WHEN abs(sc) < 0.25 THEN 0.35 ELSE 1 END + 0.2::DOUBLE * CASE WHEN sd > 1e-8 THEN tanh(pred / sd) ELSE 0 END AS v FROM c1), c3 AS (SELECT *, v - avg(v) OVER {WT} AS v2 FROM c2) SELECT period, t, asset, round(v2, 6) + 0 AS pred FROM c3")
register("x_double", lambda s, d: finish.double_finish(trade(s, d).withColumn("raw", F.col("y") / 1e6).withColumn("limit", F.lit(0.4))).select(*KEYS, (F.round("pred", 11) + F.lit(0.0)).alias("pred")), f", a AS (SELECT *, least(greatest(coalesce(y / 1e6, 0), -0.4::DOUBLE), 0.4::DOUBLE) AS v FROM p), b AS (SELECT *, v - avg(v) OVER {WT} AS q FROM a) SELECT period, t, asset, round(q, 11) + 0 AS pred FROM b")
register("x_clip", lambda s, d: finish.clip_finish(trade(s, d).withColumn("raw", F.col("y") / 1e6).withColumn("limit", F.lit(0.7))).select(*KEYS, (F.round("pred", 11) + F.lit(0.0)).alias("pred")), f", a AS (SELECT *, least(greatest(coalesce(y / 1e6, 0), -0.7::DOUBLE), 0.7::DOUBLE) AS v FROM p) SELECT period, t, asset, round(v - avg(v) OVER {WT}, 11) + 0 AS pred FROM a")
register("x_mad_first", lambda s, d: finish.mad_first_finish(trade(s, d).withColumn("raw", F.col("y") / 1e6).withColumn("limit", F.lit(0.9))).select(*KEYS, (F.round("pred", 11) + F.lit(0.0)).alias("pred")), f", a AS (SELECT *, coalesce(y / 1e6, 0) AS v FROM p), b AS (SELECT *, median(v) OVER {WT} AS md, stddev_pop(v) OVER {WT} AS sd FROM a), c AS (SELECT *, 1.4826::DOUBLE * median(abs(v - md)) OVER {WT} AS mad FROM b), d AS (SELECT *, 3.5::DOUBLE * CASE WHEN mad > 1e-7 THEN mad WHEN sd > 1e-7 THEN sd ELSE 1 END AS cap FROM c), e AS (SELECT *, least(greatest(v, md - cap), md + cap) AS w FROM d), f AS (SELECT *, w - avg(w) OVER {WT} AS q FROM e) SELECT period, t, asset, round(least(greatest(q, -0.9::DOUBLE), 0.9::DOUBLE), 11) + 0 AS pred FROM f")
register("x_mad_cap", lambda s, d: finish.mad_cap_finish(trade(s, d).withColumn("raw", F.col("y") / 1e6).withColumn("limit", F.lit(10.0))).select(*KEYS, (F.round("pred", 11) + F.lit(0.0)).alias("pred")), f", a AS (SELECT *, least(greatest(coalesce(y / 1e6, 0), -10), 10) AS v FROM p), b AS (SELECT *, median(v) OVER {WT} AS md FROM a), c AS (SELECT *, nullif(4 * 1.4826::DOUBLE * median(abs(v - md)) OVER {WT}, 0) AS cap FROM b), d AS (SELECT *, CASE WHEN cap IS NULL THEN v ELSE least(greatest(v, md - cap), md + cap) END AS w FROM c), e AS (SELECT *, w - avg(w) OVER {WT} AS q FROM d) SELECT period, t, asset, round(q, 11) + 0 AS pred FROM e")
register("x_rank_blend", lambda s, d: predicted(s, d).select(*KEYS, (0.75 * F.col("pred") + 0.25 * (X.percent_rank("pred") - 0.5)).alias("v")).select(*KEYS, six("v").alias("v")), f"{PRED}, s AS (SELECT *, 0.75::DOUBLE * pred + 0.25::DOUBLE * ({percent_sql('pred')} - 0.5::DOUBLE) AS v FROM pr) SELECT period, t, asset, round(v, 6) + 0 AS v FROM s")
register("x_rank_transport", lambda s, d: finish.rank_transport(predicted(s, d).withColumn("horizon", F.coalesce(F.col("y") / 1e6, F.lit(0.0)))).select(*KEYS, six("transported").alias("v")), f"{PRED}, h AS (SELECT *, coalesce(y / 1e6, 0) AS hz FROM pr), k AS (SELECT *, sign(hz) * pow(abs(hz) / greatest(stddev_pop(hz) OVER {WT}, 1e-8), 0.6) * greatest(stddev_pop(hz) OVER {WT}, 1e-8) AS sh, row_number() OVER (PARTITION BY period, t ORDER BY pred, asset_ord) AS kb FROM h), l AS (SELECT *, row_number() OVER (PARTITION BY period, t ORDER BY sh) AS kh FROM k), m AS (SELECT a.period, a.t, a.asset, least(greatest(b.sh, -10), 10) AS v FROM l a JOIN l b ON a.period = b.period AND a.t = b.t AND a.kb = b.kh), n AS (SELECT *, v - avg(v) OVER {WT} AS w FROM m) SELECT period, t, asset, round(w, 6) + 0 AS v FROM n")

# -- aggregations and metrics --------------------------------------------------------

register("a_quantiles", lambda s, d: trade(s, d).agg(six(F.median("f1")).alias("mid"), six(F.percentile("f1", 0.005)).alias("low"), six(F.percentile("f1", 0.995)).alias("high"), six(F.percentile(F.abs("y"), 0.995)).alias("clip_at")), "SELECT round(median(f1), 6) + 0 AS mid, round(quantile_cont(f1, 0.005), 6) + 0 AS low, round(quantile_cont(f1, 0.995), 6) + 0 AS high, round(quantile_cont(abs(y), 0.995), 6) + 0 AS clip_at FROM p")
register("a_mad_scale", lambda s, d: linear.robust_scales(trade(s, d), ["f1", "f2", "f3"]).select("feature", six("centre").alias("centre"), six("scale").alias("scale")), ", u AS (" + " UNION ALL ".join(f"SELECT 'f{i}' AS feature, f{i} AS v FROM p" for i in (1, 2, 3)) + "), c AS (SELECT feature, median(v) AS centre, stddev_pop(v) AS sd FROM u GROUP BY 1), k AS (SELECT c.feature, centre, sd, 1.4826::DOUBLE * median(abs(v - centre)) AS mad FROM u JOIN c USING (feature) GROUP BY ALL) SELECT feature, round(centre, 6) + 0 AS centre, round(CASE WHEN mad >= 1e-8 THEN mad WHEN sd >= 1e-8 THEN sd ELSE 1 END, 6) + 0 AS scale FROM k")
register("a_weighted_mean", lambda s, d: linear.with_recency(trade(s, d).where("y is not null"), 0.2).groupBy("period").agg(six(F.sum(F.col("w") * F.col("f2")) / F.sum(F.when(F.col("f2").isNotNull(), F.col("w")))).alias("m")), ", s AS (SELECT *, max(t) OVER (PARTITION BY period) - t AS age, max(t) OVER (PARTITION BY period) + 1 AS n FROM p WHERE y IS NOT NULL), w AS (SELECT *, exp(-age / greatest(1.0::DOUBLE, n * 0.2::DOUBLE)) AS w FROM s) SELECT period, round(sum(w * f2) / sum(CASE WHEN f2 IS NOT NULL THEN w END), 6) + 0 AS m FROM w GROUP BY period")


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trade(spark, sf_dir).where("y is not null").select("period", "t", *((F.coalesce(F.col(f"f{i}"), F.lit(0.0)) / k).alias(f"x{i}") for i, k in ((1, 1e6), (2, 10.0), (3, 10.0))), (F.col("y") / 1e6).alias("y"))
    sums = linear.gram(linear.with_recency(rows, 0.3), ["x1", "x2", "x3"], "y", "w", ["period"])
    return sums.select("period", *(six(F.col("gram")[i]).alias(f"g{i}") for i in range(6)), *(six(F.col("rhs")[i]).alias(f"r{i}") for i in range(3)))


register("a_gram", gram, ", s AS (SELECT period, coalesce(f1, 0) / 1e6 AS x1, coalesce(f2, 0) / 10 AS x2, coalesce(f3, 0) / 10 AS x3, y / 1e6 AS y, exp(-(max(t) OVER (PARTITION BY period) - t) / greatest(1.0::DOUBLE, (max(t) OVER (PARTITION BY period) + 1) * 0.3::DOUBLE)) AS w FROM p WHERE y IS NOT NULL) SELECT period, " + ", ".join(f"round(sum(w * x{a} * x{b}), 6) + 0 AS g{k}" for k, (a, b) in enumerate(((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)))) + ", " + ", ".join(f"round(sum(w * x{a} * y), 6) + 0 AS r{a - 1}" for a in (1, 2, 3)) + " FROM s GROUP BY period")
ROWS = f"{PRED}, mr AS (SELECT *, lead(y) OVER {WA} AS ahead, max(t) OVER (PARTITION BY period) AS last, {percent_sql('pred')} AS rp, {percent_sql('y')} AS ry, tanh(pred / greatest(stddev_pop(pred) OVER {WT}, 1e-6)) AS sq FROM pr), rw AS (SELECT period, t, CASE WHEN t < any_value(last) THEN CASE WHEN sum(abs(pred)) > 1e-12 THEN coalesce(sum(pred * ahead), 0) / sum(abs(pred)) ELSE 0 END END AS ret, {corr_sql('rp', 'ry')} AS ic, {corr_sql('pred', 'sq')} AS compression, stddev_pop(y) AS dispersion, stddev_pop(pred) AS pred_scale, sum(pred * pred) / greatest(sum(abs(pred)) ^ 2, 1e-15) AS concentration FROM mr GROUP BY period, t)"
register("a_rows", lambda s, d: metrics.rows(predicted(s, d)).select("period", "t", *(fine(c).alias(c) for c in ("ret", "ic", "compression", "dispersion", "pred_scale", "concentration"))), f"{ROWS} SELECT period, t, " + ", ".join(f"round({c}, {digits(c)}) + 0 AS {c}" for c in ("ret", "ic", "compression", "dispersion", "pred_scale", "concentration")) + " FROM rw")
SHARPE = "CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) ELSE 0 END"
register("a_statistics", lambda s, d: metrics.statistics(predicted(s, d)).select("periods", "observations", *(fine(c).alias(c) for c in ("sharpe", "ic", "ic_std", "concentration", "compression_loss", "ic_dispersion_corr"))), f"{ROWS} SELECT count(DISTINCT period) AS periods, count(*) AS observations, round({SHARPE}, 9) + 0 AS sharpe, round(avg(ic), 9) + 0 AS ic, round(coalesce(stddev_samp(ic), 0), 9) + 0 AS ic_std, round(avg(concentration), 9) + 0 AS concentration, round(avg(compression) - 1, 9) + 0 AS compression_loss, round({corr_sql('ic', 'dispersion')}, 9) + 0 AS ic_dispersion_corr FROM rw")
PERIOD = ("return_mean", "return_std", "sharpe", "ic", "ic_std", "dispersion", "concentration", "pred_scale")
PERIODS = f"{ROWS}, pm AS (SELECT period, coalesce(avg(ret), 0) AS return_mean, coalesce(stddev_samp(ret), 0) AS return_std, {SHARPE} AS sharpe, avg(ic) AS ic, coalesce(stddev_samp(ic), 0) AS ic_std, avg(dispersion) AS dispersion, avg(concentration) AS concentration, avg(pred_scale) AS pred_scale, count(*) AS rows FROM rw GROUP BY period)"
register("a_period_metrics", lambda s, d: metrics.period_metrics(predicted(s, d)).select("period", "rows", *(fine(c).alias(c) for c in PERIOD)), f"{PERIODS} SELECT period, rows, " + ", ".join(f"round({c}, {digits(c)}) + 0 AS {c}" for c in PERIOD) + " FROM pm")
register("a_folds", lambda s, d: metrics.folds(predicted(s, d), 2).select("fold", "period_start", "period_end", *(fine(c).alias(c) for c in ("sharpe", "ic", "concentration"))), f"{ROWS}, fo AS (SELECT period, CAST(floor((dense_rank() OVER (ORDER BY period) - 1) / 2) AS INT) AS fold FROM (SELECT DISTINCT period FROM rw) q) SELECT fold, min(period) AS period_start, max(period) AS period_end, round({SHARPE}, 9) + 0 AS sharpe, round(avg(ic), 9) + 0 AS ic, round(avg(concentration), 9) + 0 AS concentration FROM rw JOIN fo USING (period) GROUP BY fold")
register("a_feature_ic", lambda s, d: metrics.feature_ic(trade(s, d)).select("period", "feature", six("raw_ic").alias("raw_ic"), six("linear_corr").alias("linear_corr")), ", u AS (" + " UNION ALL ".join(f"SELECT period, t, asset, y, 'f{i}' AS feature, f{i} AS value FROM p" for i in (1, 2, 3)) + f"), r AS (SELECT *, {percent_sql('value', 'period, t, feature')} AS a, {percent_sql('y', 'period, t, feature')} AS b FROM u), c AS (SELECT period, t, feature, {corr_sql('a', 'b')} AS r, {corr_sql('value', 'y')} AS l FROM r GROUP BY 1, 2, 3) SELECT period, feature, round(avg(r), 6) + 0 AS raw_ic, round(avg(l), 6) + 0 AS linear_corr FROM c GROUP BY 1, 2")
register("a_correlations", lambda s, d: selection.correlations(trade(s, d), "y", ["f1", "f2", "f3", "f4"]).select("feature", six("corr").alias("corr")), " UNION ALL ".join(f"SELECT 'f{i}' AS feature, round({corr_sql(f'f{i}', 'y')}, 6) + 0 AS corr FROM p" for i in (1, 2, 3, 4)))
register("a_clip_fraction", lambda s, d: trade(s, d).groupBy("period").agg(six(F.avg((F.abs(F.col("y")) >= 1e6).cast("double"))).alias("share")), "SELECT period, round(avg(CASE WHEN abs(y) >= 1e6 THEN 1.0::DOUBLE WHEN y IS NOT NULL THEN 0 END), 6) + 0 AS share FROM p GROUP BY period")
register("a_coverage", lambda s, d: selection.coverage(trade(s, d), ["f1", "f2", "f3"]).select("feature", six("share").alias("share"), six("std").alias("std"), "usable"), " UNION ALL ".join(f"SELECT 'f{i}' AS feature, round(count(f{i}) / count(*)::DOUBLE, 6) + 0 AS share, round(stddev_pop(f{i}), 6) + 0 AS std, count(f{i}) / count(*)::DOUBLE >= 0.05 AND stddev_pop(f{i}) >= 1e-8 AS usable FROM p" for i in (1, 2, 3)))
register("a_group_sizes", lambda s, d: trade(s, d).where("y is not null").groupBy("period", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("period").agg(six(F.median("n")).alias("typical"), F.count(F.lit(1)).alias("times")), ", s AS (SELECT period, t, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY 1, 2) SELECT period, round(median(n), 6) + 0 AS typical, count(*) AS times FROM s GROUP BY period")
register("a_lag_sharpe", lambda s, d: predicted(s, d).withColumn("held", W.lag("pred")).groupBy("period", "t").agg(F.sum(F.col("held") * F.col("y")).alias("ret")).where("ret is not null").groupBy("period").agg(six(F.when((F.count("ret") >= 5) & (F.stddev_samp("ret") > 0), F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).otherwise(-1.0)).alias("v")), f"{PRED}, h AS (SELECT *, lag(pred) OVER {WA} AS held FROM pr), r AS (SELECT period, t, sum(held * y) AS ret FROM h GROUP BY 1, 2 HAVING sum(held * y) IS NOT NULL) SELECT period, round(CASE WHEN count(ret) >= 5 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE -1 END, 6) + 0 AS v FROM r GROUP BY period")
# a correlation of 0 comes out as a rounding error of either sign
register("a_sub_blocks", lambda s, d: metrics.rows(predicted(s, d)).withColumn("block", F.floor(4 * F.col("t") / (F.max("t").over(Window.partitionBy("period")) + 1)).cast("int")).groupBy("period", "block").agg(six(F.avg("ic")).alias("ic"), six(F.avg((F.col("ic") > 1e-9).cast("double"))).alias("positive")), f"{ROWS}, b AS (SELECT *, CAST(floor(4 * t / (max(t) OVER (PARTITION BY period) + 1)) AS INT) AS block FROM rw) SELECT period, block, round(avg(ic), 6) + 0 AS ic, round(avg(CASE WHEN ic > 1e-9 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0 AS positive FROM b GROUP BY 1, 2")


def two_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = trade(spark, sf_dir)
    return finish.fallback(panel), finish.fallback(panel.withColumn("f1", F.col("f2")))


def ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_models(spark, sf_dir)
    keep = ["sharpe", "ic"]
    out = metrics.compare(metrics.period_metrics(a).select("period", *keep), metrics.period_metrics(b).select("period", *keep))
    return out.select("period", *(six(c).alias(c) for c in out.columns if c != "period"))


def _period_sql(name: str, x: str) -> str:
    """Period metrics of the rank of a feature, as CTEs that end in ``name``."""
    return (
        f"{name}0 AS (SELECT period, t, asset, asset_ord, y, coalesce({centred_sql(x)}, 0) AS raw FROM p), {name}1 AS (SELECT *, raw - avg(raw) OVER {WT} AS pred FROM {name}0), "
        f"{name}2 AS (SELECT *, lead(y) OVER {WA} AS ahead, max(t) OVER (PARTITION BY period) AS last, {percent_sql('pred')} AS rp, {percent_sql('y')} AS ry FROM {name}1), "
        f"{name}3 AS (SELECT period, t, CASE WHEN t < any_value(last) THEN CASE WHEN sum(abs(pred)) > 1e-12 THEN coalesce(sum(pred * ahead), 0) / sum(abs(pred)) ELSE 0 END END AS ret, {corr_sql('rp', 'ry')} AS ic FROM {name}2 GROUP BY period, t), "
        f"{name} AS (SELECT period, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) ELSE 0 END AS sharpe, avg(ic) AS ic FROM {name}3 GROUP BY period)"
    )


register("a_compare_models", ab, f", {_period_sql('ma', 'f1')}, {_period_sql('mb', 'f2')} SELECT period, round(ma.sharpe, 6) + 0 AS sharpe_a, round(ma.ic, 6) + 0 AS ic_a, round(mb.sharpe, 6) + 0 AS sharpe_b, round(mb.ic, 6) + 0 AS ic_b, round(mb.sharpe - ma.sharpe, 6) + 0 AS sharpe_delta, round(mb.ic - ma.ic, 6) + 0 AS ic_delta FROM ma JOIN mb USING (period)")


def prediction_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.prediction_correlation(*two_models(spark, sf_dir))
    return out.select(*(six(c).alias(c) for c in out.columns))


register("a_prediction_correlation", prediction_corr, f", a AS (SELECT period, t, asset, coalesce({centred_sql('f1')}, 0) AS a0, coalesce({centred_sql('f2')}, 0) AS b0 FROM p), b AS (SELECT *, a0 - avg(a0) OVER {WT} AS a1, b0 - avg(b0) OVER {WT} AS b1 FROM a), c AS (SELECT period, t, {corr_sql('a1', 'b1')} AS c FROM b GROUP BY 1, 2) SELECT round(avg(c), 6) + 0 AS mean, round(min(c), 6) + 0 AS least, round(quantile_cont(c, 0.1), 6) + 0 AS p10 FROM c")

# -- sorting, sampling, splitting -----------------------------------------------------

register("l_top_periods", lambda s, d: metrics.period_metrics(predicted(s, d)).orderBy(F.desc("sharpe"), "period").limit(3).select("period", six("sharpe").alias("sharpe")), f"{PERIODS} SELECT period, round(sharpe, 6) + 0 AS sharpe FROM pm ORDER BY pm.sharpe DESC, period LIMIT 3")
register("l_bottom_periods", lambda s, d: metrics.period_metrics(predicted(s, d)).orderBy("sharpe", "period").limit(3).select("period", six("sharpe").alias("sharpe")), f"{PERIODS} SELECT period, round(sharpe, 6) + 0 AS sharpe FROM pm ORDER BY pm.sharpe, period LIMIT 3")
register("l_sample_rows", lambda s, d: sampling.by_rows(trade(s, d).where("y is not null"), 400, 0.6).select(*KEYS), ", n AS (SELECT period, t, asset, row_number() OVER (PARTITION BY period ORDER BY t, asset_ord) - 1 AS pos, count(*) OVER (PARTITION BY period) AS n FROM p WHERE y IS NOT NULL), c AS (SELECT *, 400 - 240 AS older, n - 240 AS start FROM n) SELECT period, t, asset FROM c WHERE n <= 400 OR pos >= start OR pos IN (SELECT CAST(trunc(i * (c.start - 1) / (c.older - 1.0::DOUBLE)) AS BIGINT) FROM range(160) r(i))")
register("l_sample_times", lambda s, d: sampling.by_times(trade(s, d).where("y is not null"), 500, 0.55).select("period", "t").distinct(), ", n AS (SELECT period, t, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY 1, 2), g AS (SELECT period, greatest(1, CAST(floor(median(n)) AS INT)) AS typical, count(*) AS total FROM n GROUP BY 1), b AS (SELECT *, greatest(1, 500 // typical) AS budget FROM g), o AS (SELECT n.period, n.t, row_number() OVER (PARTITION BY n.period ORDER BY n.t) - 1 AS pos, total, budget, greatest(1, CAST(floor(budget * 0.55::DOUBLE) AS INT)) AS recent FROM n JOIN b USING (period)) SELECT period, t FROM o WHERE total <= budget OR pos >= total - recent OR pos IN (SELECT CAST(trunc(i * (total - recent - 1) / (budget - recent - 1.0::DOUBLE)) AS BIGINT) FROM range(0, budget - recent) r(i))")
register("l_split", lambda s, d: split(trade(s, d)).groupBy("period").agg(F.countDistinct(F.when(F.col("train"), F.col("t"))).alias("train"), F.countDistinct(F.when(~F.col("train"), F.col("t"))).alias("valid")), f"{SPLIT} SELECT period, count(DISTINCT CASE WHEN train THEN t END) AS train, count(DISTINCT CASE WHEN NOT train THEN t END) AS valid FROM sp GROUP BY period")
register("l_three_way_split", lambda s, d: sampling.blocks(trade(s, d), (0.62, 0.82)).groupBy("period", "block").agg(F.min("t").alias("first"), F.max("t").alias("last")), ", n AS (SELECT *, max(t) OVER (PARTITION BY period) + 1 AS n FROM p) SELECT period, CASE WHEN t < floor(n * 0.62::DOUBLE) THEN 0 WHEN t < floor(n * 0.82::DOUBLE) THEN 1 ELSE 2 END AS block, min(t) AS first, max(t) AS last FROM n GROUP BY 1, 2")
register("l_runs", lambda s, d: metrics.runs(metrics.rows(predicted(s, d)), "ret < 0"), f"{ROWS}, neg AS (SELECT period, t, t - row_number() OVER (PARTITION BY period ORDER BY t) AS island FROM rw WHERE ret < 0) SELECT period, min(t) AS first, max(t) AS last, count(*) AS length FROM neg GROUP BY period, island")
BEST = ", u AS (" + " UNION ALL ".join(f"SELECT period, t, asset, y, 'f{i}' AS feature, f{i} AS value FROM p" for i in (1, 2, 3)) + f"), r AS (SELECT *, {percent_sql('value', 'period, t, feature')} AS a, {percent_sql('y', 'period, t, feature')} AS b FROM u), c AS (SELECT period, t, feature, {corr_sql('a', 'b')} AS r FROM r GROUP BY 1, 2, 3), m AS (SELECT period, feature, round(avg(r), 6) AS ic FROM c GROUP BY 1, 2)"
register("l_best_feature", lambda s, d: metrics.feature_ic(trade(s, d)).groupBy("period").agg(F.max_by("feature", F.struct(six("raw_ic"), "feature")).alias("best")), f"{BEST} SELECT period, arg_max(feature, (ic, feature)) AS best FROM m GROUP BY period")
# two selections that overlap and together cover the panel: a union keeps both copies, a sorted one each row once
register("set_union", lambda s, d: trade(s, d).where("f1 is not null").select(*KEYS).unionByName(trade(s, d).where("y is not null or f1 is null").select(*KEYS)).groupBy("period", "asset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("distinct_n")), ", u AS (SELECT period, t, asset FROM p WHERE f1 IS NOT NULL UNION ALL SELECT period, t, asset FROM p WHERE y IS NOT NULL OR f1 IS NULL) SELECT period, asset, count(*) AS n, count(DISTINCT t) AS distinct_n FROM u GROUP BY 1, 2")
register("set_intersect", lambda s, d: trade(s, d).where("f1 is not null").select(*KEYS).intersect(trade(s, d).where("y is not null").select(*KEYS)).groupBy("period", "asset").agg(F.count(F.lit(1)).alias("n")), ", u AS (SELECT period, t, asset FROM p WHERE f1 IS NOT NULL INTERSECT SELECT period, t, asset FROM p WHERE y IS NOT NULL) SELECT period, asset, count(*) AS n FROM u GROUP BY 1, 2")
register("set_difference", lambda s, d: trade(s, d).where("f1 is not null").select(*KEYS).subtract(trade(s, d).where("y is not null").select(*KEYS)), "SELECT period, t, asset FROM p WHERE f1 IS NOT NULL EXCEPT SELECT period, t, asset FROM p WHERE y IS NOT NULL")
register("set_distinct", lambda s, d: trade(s, d).select("period", "asset").distinct(), "SELECT DISTINCT period, asset FROM p")

# -- feature sets and models ------------------------------------------------------------

RANK_ALL = ", ".join(f"{centred_sql(f'f{i}')} AS f{i}_rank" for i in range(1, 7))
COMPACT = ewma_sql("f1", 5, 2, "e5") + f""", fs AS (SELECT *, ew AS f1_ewma5, {MA5} AS f1_ma5, {MA20} AS f1_ma20, {SD20} AS f1_sd20, {RANK_ALL}, """ + ", ".join(f"lag(f{i}) OVER {WA} AS f{i}_lag1, f{i} - lag(f{i}) OVER {WA} AS f{i}_diff1" for i in (1, 2, 3)) + f""", lag(f1, 3) OVER {WA} AS f1_lag3, f1 - lag(f1, 3) OVER {WA} AS f1_diff3, f1 - median(f1) OVER {WT} AS f1_demean FROM e5),
fz AS (SELECT *, (f1 - f1_ma5) / (f1_sd20 + 1e-6) AS f1_roll_z, f1_ma5 - f1_ma20 AS f1_mom_spread, f1_rank - f2_rank AS rank12, f1_rank - f3_rank AS rank13 FROM fs)"""
COMPACT_NAMES = [f"f{i}" for i in range(1, 7)] + [f"f{i}_rank" for i in range(1, 7)] + [f"f{i}_{k}" for i in (1, 2, 3) for k in ("lag1", "diff1")] + [f"f1_{k}" for k in ("lag3", "diff3", "ma5", "ma20", "sd20", "ewma5", "roll_z", "mom_spread", "demean")] + ["rank12", "rank13"]
register("features_compact", lambda s, d: sets.compact(panels.trade_panel(s, d)).select(*KEYS, *(six(n).alias(n) for n in COMPACT_NAMES)), f"{COMPACT} SELECT period, t, asset, " + ", ".join(f"round({n}, 6) + 0 AS {n}" for n in COMPACT_NAMES) + " FROM fz")

CLASSIC = ewma_sql("f1", 5, 2, "k5") + f""", ks AS (SELECT *, ew AS f1_ewma5, {MA5} AS f1_ma5, {roll_sql('avg', 'f1', 20, 3)} AS f1_ma20, {MA60} AS f1_ma60, coalesce({roll_sql('stddev_pop', 'f1', 20, 3)}, 0) AS f1_sd20, """ + ", ".join(f"f{i} - lag(f{i}) OVER {WA} AS f{i}_diff1" for i in (1, 2, 3)) + f""", f1 - median(f1) OVER {WT} AS f1_demean FROM k5),
kz AS (SELECT *, """ + ", ".join(f"{centred_sql(c)} AS {c}_rank" for c in ("f1", "f2", "f3", "f1_ma5", "f1_ma20", "f1_ma60")) + """, (f1 - f1_ma5) / (f1_sd20 + 1e-6) AS f1_roll_z, f1_ma5 - f1_ma60 AS f1_mom_spread FROM ks)"""
CLASSIC_NAMES = [f"f{i}_diff1" for i in (1, 2, 3)] + ["f1_ma5", "f1_ma20", "f1_ma60", "f1_sd20", "f1_ewma5", "f1_roll_z", "f1_mom_spread", "f1_demean"] + [f"{c}_rank" for c in ("f1", "f2", "f3", "f1_ma5", "f1_ma20", "f1_ma60")]
register("features_classic", lambda s, d: sets.classic(panels.trade_panel(s, d)).select(*KEYS, *(six(n).alias(n) for n in CLASSIC_NAMES), six("rank_spread").alias("rank_spread")), f"{CLASSIC} SELECT period, t, asset, " + ", ".join(f"round({n}, 6) + 0 AS {n}" for n in CLASSIC_NAMES) + ", round(f1_rank - f2_rank, 6) + 0 AS rank_spread FROM kz")
LATE = ", ls AS (SELECT *, " + ", ".join(f"f{i} - lag(f{i}) OVER {WA} AS f{i}_diff1, f{i} - lag(f{i}, 3) OVER {WA} AS f{i}_diff3, {roll_sql('avg', f'f{i}', 5, 2)} AS f{i}_ma5, {roll_sql('stddev_pop', f'f{i}', 5, 2)} AS f{i}_sd5, {roll_sql('stddev_pop', f'f{i}', 20, 4)} AS f{i}_sd20, {centred_sql(f'f{i}')} AS f{i}_rank, f{i} - median(f{i}) OVER {WT} AS f{i}_demean" for i in (4, 5, 6)) + " FROM p)"
LATE_NAMES = {f"f{i}_{k}": x.format(i=i) for i in (4, 5, 6) for k, x in {"diff1": "f{i}_diff1", "diff3": "f{i}_diff3", "ma5": "f{i}_ma5", "sd5": "f{i}_sd5", "sd20": "f{i}_sd20", "rank": "f{i}_rank", "demean": "f{i}_demean", "reversal5": "f{i}_ma5 - f{i}", "vol_ratio": "f{i}_sd5 / (f{i}_sd20 + 1e-6)"}.items()} | {"late_spread": "f4_rank - f6_rank"}
register("features_late", lambda s, d: sets.late(panels.trade_panel(s, d)).select(*KEYS, *(six(n).alias(n) for n in LATE_NAMES)), f"{LATE} SELECT period, t, asset, " + ", ".join(f"round({x}, 6) + 0 AS {n}" for n, x in LATE_NAMES.items()) + " FROM ls")

# -- models: SQL can't solve for coefficients. Tests compare v37 and the regressions with plain NumPy; for the
# others they ask for centred predictions that find the signal, which is less ----------


def registry_names() -> list[str]:
    from tessera.plans import registry

    return registry.names()


def predictions(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.plans import registry

        # models read the panel in many jobs; lineitem is read for the first alone
        panel = panels.with_target(panels.trade_panel(spark, sf_dir, hold=cut))
        panel = cut(panel.withColumn("y", F.col("y") / 1e6))  # of the size that models clip at
        return registry.run(panel, name).select(*KEYS, six("pred").alias("pred"))

    return query


for _name in registry_names():
    register(f"model_{_name}", predictions(_name))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.apply(trade(spark, sf_dir), preprocess.fit(trade(spark, sf_dir), ["f1", "f2", "f3"], ["period"]), ["f1", "f2", "f3"], ["period"])


register("m_scaler_fit", lambda s, d: preprocess.fit(trade(s, d), ["f1", "f2"], ["period"]).select("period", "feature", *(six(c).alias(c) for c in ("impute", "low", "high", "centre", "scale"))), ", u AS (SELECT period, 'f1' AS feature, f1 AS v FROM p UNION ALL SELECT period, 'f2', f2 FROM p), i AS (SELECT period, feature, median(v) AS impute FROM u GROUP BY 1, 2), c AS (SELECT period, feature, impute, quantile_cont(coalesce(v, impute), 0.01) AS low, quantile_cont(coalesce(v, impute), 0.99) AS high FROM u JOIN i USING (period, feature) GROUP BY ALL), k AS (SELECT c.*, least(greatest(coalesce(v, impute), low), high) AS x FROM u JOIN c USING (period, feature)), m AS (SELECT period, feature, impute, low, high, median(x) AS centre, stddev_pop(x) AS sd FROM k GROUP BY ALL), z AS (SELECT m.*, 1.4826::DOUBLE * median(abs(x - centre)) AS mad FROM k JOIN m USING (period, feature) GROUP BY ALL) SELECT period, feature, round(impute, 6) + 0 AS impute, round(low, 6) + 0 AS low, round(high, 6) + 0 AS high, round(centre, 6) + 0 AS centre, round(CASE WHEN mad >= 1e-8 THEN mad WHEN sd >= 1e-8 THEN sd ELSE 1 END, 6) + 0 AS scale FROM z")
register("m_ridge", lambda s, d: robust.ridge(linear.with_recency(scaled(s, d).where("y is not null"), 0.3), ["f1", "f2", "f3"], "y", "w", ["period"], 12.0).select("period", *(six(F.col("coefficients")[i]).alias(f"c{i + 1}") for i in range(3))))
register("m_huber", lambda s, d: robust.huber(linear.with_recency(scaled(s, d).where("y is not null"), 0.3), ["f1", "f2", "f3"], "y", "w", ["period"], 16.0).select("period", *(six(F.col("coefficients")[i]).alias(f"c{i + 1}") for i in range(3))))
register("m_weights", lambda s, d: linear.with_recency(trade(s, d), 0.3).groupBy("period", "t").agg(F.max("w").alias("w")).withColumn("fast", F.col("w") / F.avg("w").over(Window.partitionBy("period"))).select("period", "t", six("w").alias("w"), six("fast").alias("scaled")), ", s AS (SELECT period, t, exp(-(max(t) OVER (PARTITION BY period) - t) / greatest(1.0::DOUBLE, (max(t) OVER (PARTITION BY period) + 1) * 0.3::DOUBLE)) AS w FROM (SELECT DISTINCT period, t FROM p) q) SELECT period, t, round(w, 6) + 0 AS w, round(w / avg(w) OVER (PARTITION BY period), 6) + 0 AS scaled FROM s")
register("x_neutralise", lambda s, d: neutral.neutralise(trade(s, d).select(*KEYS, (F.col("y") / 1e6).alias("v"), X.centred_rank("f2").alias("a"), X.centred_rank("f3").alias("b")), "v", ["a", "b"], "left_over").select(*KEYS, six("left_over").alias("v")), RANKED + f", n1 AS (SELECT period, t, asset, coalesce(y / 1e6, 0) - avg(coalesce(y / 1e6, 0)) OVER {WT} AS v, coalesce(r2, 0) - avg(coalesce(r2, 0)) OVER {WT} AS a, coalesce(r3, 0) - avg(coalesce(r3, 0)) OVER {WT} AS b FROM rk), n2 AS (SELECT *, sum(a * a) OVER {WT} + 0.35 AS aa, sum(b * b) OVER {WT} + 0.35 AS bb, sum(a * b) OVER {WT} AS ab, sum(a * v) OVER {WT} AS av, sum(b * v) OVER {WT} AS bv FROM n1) SELECT period, t, asset, round(v - (av * bb - bv * ab) / (aa * bb - ab * ab) * a - (bv * aa - av * ab) / (aa * bb - ab * ab) * b, 6) + 0 AS v FROM n2")
register("m_gauge_fix", lambda s, d: gauge.gauge_fix(predicted(s, d)).select(*KEYS, six("pred").alias("pred")))
register("a_novelty", lambda s, d: gauge.novelty(predicted(s, d)).select(six("angle").alias("angle"), "nearest"))
register("a_components", lambda s, d: metrics.components(walk_forward(trade(s, d), "v37"), ("ridge", "rank")).select("component", *(six(c).alias(c) for c in ("sharpe", "ic", "concentration"))))
register("l_stability", lambda s, d: selection.stability(trade(s, d), "y", ["f1", "f2", "f3"]).select("feature", six("score").alias("score")), ", u AS (" + " UNION ALL ".join(f"SELECT period, t, y, 'f{i}' AS feature, f{i} AS v FROM p" for i in (1, 2, 3)) + f"), c AS (SELECT period, t, feature, {corr_sql('v', 'y')} AS c FROM u GROUP BY 1, 2, 3), s AS (SELECT feature, avg(c) AS m, coalesce(stddev_pop(c), 0) AS sd, avg(CASE WHEN sign(c) = 1 THEN 1.0::DOUBLE ELSE 0 END) AS up FROM c GROUP BY 1) SELECT feature, round(abs(m) * (0.5::DOUBLE + 0.5::DOUBLE * greatest(up, 1 - up)) / (0.05::DOUBLE + sd), 6) + 0 AS score FROM s")
register("source_synthetic", lambda s, d: synthetic.dataset(s, 4, 40, 8).select(*KEYS, *(six(c).alias(c) for c in ("f1", "f2", "f3", "f4", "f5", "f6", "y"))))
register("source_smoke", lambda s, d: synthetic.smoke_panel(s).select(*KEYS, six("f1").alias("f1"), six("y").alias("y")))


def wide_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide frame with a column per feature and asset, back in long form. Its times are those of all periods."""
    long = trade(spark, sf_dir)
    cells = [F.max(F.when(F.col("asset") == a, F.col(f))).alias(f"{f}|{a}") for f in ("f1", "f2") for a in NATIONS]
    back = panels.from_wide(long.groupBy((100 * F.col("period") + F.col("t")).alias("time")).agg(*cells))
    return back.select("time", "t", "asset", six("f1").alias("f1"), six("f2").alias("f2"))


register("source_wide", wide_source, ", n AS (SELECT * EXCLUDE (time), 100 * period + t AS time FROM p) SELECT time, CAST(dense_rank() OVER (ORDER BY time) - 1 AS INT) AS t, asset, round(f1, 6) + 0 AS f1, round(f2, 6) + 0 AS f2 FROM n")


def regime_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.regime_signal(trade(spark, sf_dir)).select(*KEYS, six("signal").alias("signal"))


REGIME = (
    ", mv AS (SELECT *, " + ", ".join(f"({roll_sql('avg', f'f{i}', 5, 2)}) - ({roll_sql('avg', f'f{i}', 20, 3)}) AS m{i}, ({roll_sql('avg', f'f{i}', 20, 3)}) - f{i} AS v{i}" for i in (1, 2, 3)) + " FROM p), "
    "mr AS (SELECT *, (" + " + ".join(f"({centred_sql(f'm{i}')})" for i in (1, 2, 3)) + ") / 3 AS momentum, (" + " + ".join(f"({centred_sql(f'v{i}')})" for i in (1, 2, 3)) + ") / 3 AS reversion FROM mv), "
    "ds AS (SELECT period, t, (" + " + ".join(f"stddev_pop(f{i})" for i in (1, 2, 3)) + ") / 3 AS d FROM p GROUP BY 1, 2), "
    "gt AS (SELECT period, t, coalesce(least(greatest((d / (abs(CASE WHEN count(d) OVER w >= 3 THEN avg(d) OVER w END) + 1e-6) - 0.85::DOUBLE) / 0.50::DOUBLE, 0), 1), 0.5) AS gate FROM ds WINDOW w AS (PARTITION BY period ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
)
register("x_regime_signal", regime_signal, f"{REGIME} SELECT period, t, asset, round(coalesce(momentum * gate + reversion * (1 - gate), 0), 6) + 0 AS signal FROM mr JOIN gt USING (period, t)")
register("x_adaptive_share", lambda s, d: signals.adaptive_share(walk_forward(trade(s, d).withColumn("y", F.col("y") / 1e6), "v32")).select(*KEYS, six("pred").alias("pred")))


# -- choices of a period before its fit ---------------------------------------------


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows of the trade panel with compact features, and their targets in millions."""
    frame = sets.compact(split(trade(spark, sf_dir).withColumn("y", F.col("y") / 1e6)))
    return frame.where("train and y is not null").select("period", "t", "asset_ord", "y", *sets.feature_names(frame))


def kept_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = known(spark, sf_dir)
    kept = choices.kept(rows, [c for c in rows.columns if c not in ("period", "t", "asset_ord", "y")], models.PICK40)
    return kept.select("period", F.posexplode("kept").alias("place", "feature"))


register("l_select_stable", kept_features)
register("l_select_correlation", lambda s, d: choices.kept(known(s, d).select("period", "t", "asset_ord", "y", "f1", "f2", "f3", "f4"), ["f1", "f2", "f3", "f4"], choices.Pick("correlation", 3)).select("period", F.posexplode("kept").alias("place", "feature")))
register("m_ridge_path", lambda s, d: ridge_path.search(split(trade(s, d).withColumn("y", F.col("y") / 1e6)), ["f1", "f2", "f3"]).select("period", "alpha", "decay", six("score").alias("score")))
#: Evenly placed rows of a period, at most 200.
register("l_even_rows", lambda s, d: sampling.even_rows(trade(s, d).where("y is not null"), 200).select(*KEYS), ", r AS (SELECT period, t, asset, row_number() OVER (PARTITION BY period ORDER BY t, asset_ord) - 1 AS pos, count(*) OVER (PARTITION BY period) AS n FROM p WHERE y IS NOT NULL) SELECT period, t, asset FROM r WHERE n <= 200 OR pos IN (SELECT i * (n - 1) // 199 FROM range(200) g(i))")
register("numeric_projection", lambda s, d: panels.numeric(s.read.parquet(f"{d}/orders.parquet")).select("o_orderkey", "o_custkey", six("o_totalprice").alias("o_totalprice")), ", o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) SELECT o_orderkey, o_custkey, round(o_totalprice, 6) + 0 AS o_totalprice FROM o")
register("a_head_correlations", lambda s, d: metrics.head_correlations(trade(s, d).select("period", F.array(*(X.centred_rank(f) for f in ("f1", "f2", "f3"))).alias("heads")), 3, ("period",)).select("period", "a", "b", six("corr").alias("corr")), ", h AS (SELECT period, " + ", ".join(f"{centred_sql(f'f{i}')} AS r{i}" for i in (1, 2, 3)) + " FROM p) " + " UNION ALL ".join(f"SELECT period, {i} AS a, {j} AS b, round({corr_sql(f'r{i + 1}', f'r{j + 1}')}, 6) + 0 AS corr FROM h GROUP BY period" for i, j in ((0, 1), (0, 2), (1, 2))))
#: A cap at 3.5 robust deviations before the clip at 1, then the mean taken off.
register("x_mad_clip", lambda s, d: finish.mad_clip_finish(trade(s, d).select(*KEYS, "asset_ord", (F.col("y") / 1e6).alias("raw"), F.lit(1.0).alias("limit"))).select(*KEYS, six("pred").alias("pred")), f", r AS (SELECT period, t, asset, coalesce(y / 1e6, 0) AS v FROM p), m AS (SELECT *, median(v) OVER {WT} AS md, stddev_pop(v) OVER {WT} AS sd FROM r), k AS (SELECT *, 1.4826::DOUBLE * median(abs(v - md)) OVER {WT} AS mad FROM m), c AS (SELECT *, 3.5::DOUBLE * CASE WHEN mad > 1e-7 THEN mad WHEN sd > 1e-7 THEN sd ELSE 1 END AS w FROM k), b AS (SELECT period, t, asset, least(greatest(least(greatest(v, md - w), md + w), -1), 1) AS v FROM c) SELECT period, t, asset, round(v - avg(v) OVER {WT}, 6) + 0 AS pred FROM b")


# -- target layouts -------------------------------------------------------------------


def target_from_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade panel's target through a frame with a column for each level and asset, and back."""
    panel = trade(spark, sf_dir)
    cells = [F.max(F.when(F.col("asset") == a, F.col("f2"))).alias(f"Feature.1|{a}") for a in NATIONS]
    back = panels.attach_target(panel, panel.groupBy("time").agg(*cells))
    return back.select(*KEYS, six("y").alias("y"))


DEMEANED = f"SELECT period, t, asset, round(f2 - avg(f2) OVER {WT}, 6) + 0 AS y FROM p"
register("target_from_wide", target_from_wide, DEMEANED)
register("target_from_long", lambda s, d: panels.attach_target(trade(s, d), trade(s, d).select("time", "asset", "f2")).select(*KEYS, six("y").alias("y")), DEMEANED)
