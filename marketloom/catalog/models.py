"""Modelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as V
from ..fixtures import add_view
from ..operators import models as MO
from ..operators import rolling as R
from ..operators import xsection as XS
from ..session import staged
from .registry import query, r, rounded
from .xsection import ic_sql

KEYS = ["trade_date", "symbol"]
XS_ = ["a", "b"]

add_view("mp", ("panel_supplier",), """
    SELECT trade_date, symbol, a, b, y FROM (SELECT trade_date, symbol, close / lag(close) OVER w - 1 AS a, ln(turnover) AS b, close AS c, lead(close) OVER w / close - 1 AS y FROM panel_supplier WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
    WHERE a IS NOT NULL AND y IS NOT NULL""")


def model_panel(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy("trade_date")
    p = V.panel_supplier(spark, d).select(*KEYS, R.pct_change("close").alias("a"), F.log("turnover").alias("b"), (F.lead("close").over(w) / F.col("close") - 1.0).alias("y"))
    return staged(p.where("a is not null and y is not null"))


def ridge_sql(src: str, keys: str, alpha: float, minimum: int) -> str:
    """Closed-form two-feature ridge on centred sums."""
    return f"""SELECT *, my - ba * ma - bb * mb AS intercept FROM (SELECT *, (cay * cbb - cby * cab) / (caa * cbb - cab * cab) AS ba, (cby * caa - cay * cab) / (caa * cbb - cab * cab) AS bb FROM (
      SELECT {keys}, count(*) AS rows, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) * count(*) + {alpha} AS caa, covar_pop(a, b) * count(*) AS cab, covar_pop(b, b) * count(*) + {alpha} AS cbb, covar_pop(a, y) * count(*) AS cay,
             covar_pop(b, y) * count(*) AS cby FROM {src} GROUP BY {keys} HAVING count(*) >= {minimum}))"""


@query("feature_label_panel", """
    WITH f AS (SELECT *, close / lag(close, 5) OVER w - 1 AS ret_5, close / lag(close, 20) OVER w - 1 AS ret_20, vol / avg(vol) OVER (w ROWS 19 PRECEDING) AS vr, row_number() OVER w AS i, lead(close, 5) OVER w / close - 1 AS label FROM ship_daily WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
    SELECT trade_date, symbol, round(ret_5, 6) AS ret_5, round(ret_20, 6) AS ret_20, round(CASE WHEN i >= 20 THEN vr END, 6) AS vol_ratio, round(label, 6) AS label FROM f""", "ship_daily")
def feature_label_panel(spark, d):
    s = V.ship_daily(spark, d).select(*KEYS, "close", "vol")
    s = R.rolling(s, "vol", 20, 20, {"_ma": F.avg}).withColumns({"ret_5": R.pct_change("close", 5), "ret_20": R.pct_change("close", 20), "vol_ratio": F.col("vol") / F.col("_ma"),
                                                                 "label": F.lead("close", 5).over(_ordered()) / F.col("close") - 1.0})
    return rounded(s.select(*KEYS, "ret_5", "ret_20", "vol_ratio", "label"), "ret_5", "ret_20", "vol_ratio", "label")


def _ordered():
    from pyspark.sql import Window
    return Window.partitionBy("symbol").orderBy("trade_date")


@query("rolling_windows", """
    WITH b AS (SELECT CAST(date_trunc('month', min(l_shipdate)) AS DATE) AS a, CAST(date_trunc('month', max(l_shipdate)) AS DATE) AS z FROM lineitem), w AS (SELECT unnest(generate_series(CAST(a + INTERVAL 24 MONTH AS TIMESTAMP), CAST(z - INTERVAL 5 MONTH AS TIMESTAMP), INTERVAL 6 MONTH)) AS v FROM b)
    SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS "window", CAST(v - INTERVAL 24 MONTH AS DATE) AS train_start, CAST(v - INTERVAL 1 DAY AS DATE) AS train_end, CAST(v AS DATE) AS test_start, CAST(v + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS test_end FROM w""")
def rolling_windows(spark, d):
    return MO.month_windows(V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")), 24, 6, 6)


@query("ridge_rank_model", f"SELECT rows, round(ba, 6) AS b_a, round(bb, 6) AS b_b, round(intercept, 6) AS intercept FROM ({ridge_sql('(SELECT *, 1 AS k FROM mp)', 'k', 2.0, 50)})", "mp")
def ridge_rank_model(spark, d):
    p = model_panel(spark, d)
    span = p.agg(F.lit(0).alias("window"), F.min("trade_date").alias("train_start"), F.max("trade_date").alias("train_end"))
    fit = MO.fit_windows(MO.date_moments(p, "y", XS_), span, XS_, 2.0, 50)
    return rounded(fit.drop("window"), "b_a", "b_b", "intercept")


FOLDS = """c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM mp)), f AS (SELECT i // 6 AS w, i AS lo, i + 35 AS hi, i + 37 AS ts, i + 42 AS te FROM c WHERE mod(i, 6) = 0 AND i + 42 <= n AND i + 37 < n),
    fit AS (__FIT__), test AS (SELECT w, mp.trade_date, symbol, intercept + ba * a + bb * b AS pred, y FROM mp JOIN c USING (trade_date) JOIN f ON i BETWEEN ts AND te JOIN fit USING (w))""".replace("__FIT__", ridge_sql("(SELECT w, a, b, y FROM mp JOIN c USING (trade_date) JOIN f ON i BETWEEN lo AND hi)", "w", 1.0, 50))


@query("walk_forward", f"""
    WITH {FOLDS}, ic AS ({ic_sql('w, trade_date', 'pred', 'test', 5, 'y')}), t AS (SELECT w, trade_date, avg(y) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY w, trade_date ORDER BY pred DESC, symbol) AS k FROM test) WHERE k <= 3 GROUP BY 1, 2 HAVING count(*) = 3),
    b AS (SELECT w, trade_date, avg(y) AS bench FROM test GROUP BY 1, 2)
    SELECT CAST(w AS INTEGER) AS "window", trade_date, round(rank_ic, 6) AS rank_ic, round(ret, 6) AS top_ret, round(bench, 6) AS bench_ret FROM ic JOIN t USING (w, trade_date) JOIN b USING (w, trade_date)""", "mp")
def walk_forward(spark, d):
    p = model_panel(spark, d)
    fold = staged(MO.folds(p, 36, 1, 6, 6))
    ic, top = MO.walk_forward(p, fold, "y", XS_, 1.0, 3)
    bench = MO.in_window(p, fold).groupBy("window", "trade_date").agg(F.avg("y").alias("bench_ret"))
    out = ic.select("window", "trade_date", "rank_ic").join(top.select("window", "trade_date", F.col("ret").alias("top_ret")), ["window", "trade_date"]).join(bench, ["window", "trade_date"])
    return rounded(out, "rank_ic", "top_ret", "bench_ret")


def window_sql(src: str, months: int, minimum: int = 200) -> str:
    """CTEs of month windows, fits and test predictions over a transformed panel."""
    return f"""b AS (SELECT min(trade_date) AS a, max(trade_date) AS z FROM mp), w AS (SELECT CAST(v AS DATE) AS v, row_number() OVER (ORDER BY v) - 1 AS w FROM (SELECT unnest(generate_series(CAST(a + INTERVAL 24 MONTH AS TIMESTAMP), CAST(z - INTERVAL {months - 1} MONTH AS TIMESTAMP), INTERVAL 6 MONTH)) AS v FROM b)),
      p AS ({src}), fit AS ({ridge_sql("(SELECT w, a, b, y FROM p JOIN w ON trade_date >= v - INTERVAL 24 MONTH AND trade_date < v)", 'w', 1.0, minimum)}),
      test AS (SELECT w, p.trade_date, symbol, intercept + ba * a + bb * b AS pred, y FROM p JOIN w ON trade_date >= v AND trade_date < v + INTERVAL {months} MONTH JOIN fit USING (w)), ic AS ({ic_sql('w, trade_date', 'pred', 'test', 2, 'y')})"""


STD_SQL = {
    "none": "SELECT * FROM mp",
    "zscore": "SELECT trade_date, symbol, (a - avg(a) OVER d) / nullif(stddev_samp(a) OVER d, 0) AS a, (b - avg(b) OVER d) / nullif(stddev_samp(b) OVER d, 0) AS b, y FROM mp WINDOW d AS (PARTITION BY trade_date)",
    "robust": """SELECT trade_date, symbol, coalesce(ca / nullif(quantile_cont(abs(ca), 0.5) OVER d, 0), 0) AS a, coalesce(cb / nullif(quantile_cont(abs(cb), 0.5) OVER d, 0), 0) AS b, y FROM
        (SELECT *, a - quantile_cont(a, 0.5) OVER (PARTITION BY trade_date) AS ca, b - quantile_cont(b, 0.5) OVER (PARTITION BY trade_date) AS cb FROM mp) WINDOW d AS (PARTITION BY trade_date)""",
    "rank": """SELECT trade_date, symbol, (rank() OVER (PARTITION BY trade_date ORDER BY a) + (count(*) OVER (PARTITION BY trade_date, a) - 1) / 2.0::DOUBLE) / count(*) OVER d AS a,
        (rank() OVER (PARTITION BY trade_date ORDER BY b) + (count(*) OVER (PARTITION BY trade_date, b) - 1) / 2.0::DOUBLE) / count(*) OVER d AS b, y FROM mp WINDOW d AS (PARTITION BY trade_date)""",
}


OOS_SQL = " UNION ALL ".join(f"SELECT * FROM (WITH {window_sql(STD_SQL[m], 6)} SELECT '{m}' AS method, CAST(w AS INTEGER) AS \"window\", avg(rank_ic) AS ic, count(*) AS dates FROM ic WHERE rank_ic IS NOT NULL GROUP BY w)" for m in STD_SQL)


def oos_ic(spark, d):
    p = model_panel(spark, d)
    w = staged(MO.month_windows(p, 24, 6, 6))
    out = None
    for m in STD_SQL:
        ic = MO.window_ic(MO.standardized(p, XS_, m), w, "y", XS_, 1.0, 200).withColumn("method", F.lit(m))
        out = ic if out is None else out.unionByName(ic)
    return out


@query("window_oos_ic", f"SELECT method, \"window\", round(ic, 6) AS ic, dates FROM ({OOS_SQL})", "mp")
def window_oos_ic(spark, d):
    return rounded(oos_ic(spark, d), "ic")


@query("window_oos_ic_summary", f"""SELECT method, count(*) AS windows, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg((ic > 0)::INT), 6) AS hit_rate FROM ({OOS_SQL}) GROUP BY 1""", "mp")
def window_oos_ic_summary(spark, d):
    out = oos_ic(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("windows"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))
    return rounded(out, "ic_mean", "ic_std", "hit_rate")


@query("validation_length", " UNION ALL ".join(f"SELECT * FROM (WITH {window_sql(STD_SQL['none'], n)} SELECT {n} AS months, CAST(w AS INTEGER) AS \"window\", round(avg(rank_ic), 6) AS ic, count(*) AS dates FROM ic WHERE rank_ic IS NOT NULL GROUP BY w)" for n in (3, 6, 12)), "mp")
def validation_length(spark, d):
    p = model_panel(spark, d)
    out = None
    for n in (3, 6, 12):
        ic = MO.window_ic(p, MO.month_windows(p, 24, n, 6), "y", XS_, 1.0, 200).withColumn("months", F.lit(n))
        out = ic if out is None else out.unionByName(ic)
    return rounded(out, "ic")


RIDGE_IC = f"""fit AS ({ridge_sql("(SELECT a, b, y, 1 AS k FROM mp WHERE trade_date < DATE '1999-01-01')", 'k', 1.0, 50)}),
    test AS (SELECT trade_date, symbol, intercept + ba * a + bb * b AS pred, y FROM mp, fit WHERE trade_date >= DATE '1999-01-01'), ic AS ({ic_sql('trade_date', 'pred', 'test', 5, 'y')})"""


@query("gbt_regression", f"""
    WITH {RIDGE_IC} SELECT count(*) FILTER (trade_date < DATE '1999-01-01') AS train_rows, count(*) FILTER (trade_date >= DATE '1999-01-01') AS scored_rows, count(DISTINCT trade_date) FILTER (trade_date >= DATE '1999-01-01') AS scored_dates,
           count(DISTINCT trade_date) FILTER (trade_date < DATE '1999-01-01')::DOUBLE AS total_weight, round((SELECT avg(rank_ic) FROM ic), 6) AS ridge_ic, true AS near_ridge_or_better FROM mp WHERE y IS NOT NULL""", "mp")
def gbt_regression(spark, d):
    """Rows and weights of the fit, and its mean rank IC against that of a ridge on the same split."""
    p = staged(model_panel(spark, d).where("y is not null"))
    train, test = p.where("trade_date < date'1999-01-01'"), p.where("trade_date >= date'1999-01-01'")
    scored, _ = MO.gbt_scores(train, test, "y", XS_, trees=10)
    scored = staged(scored.select(*KEYS, "pred", "y"))
    span = train.agg(F.lit(0).alias("window"), F.min("trade_date").alias("train_start"), F.max("trade_date").alias("train_end"))
    fit = MO.fit_windows(MO.date_moments(p, "y", XS_), span, XS_, 1.0, 50)
    ridge = MO.predict(test.withColumn("window", F.lit(0)), fit, XS_, ["window"])
    mean = lambda s: XS.daily_ic(s, "pred", "y", min_obs=5).agg(F.avg("rank_ic")).scalar()
    weight = MO.date_equal_weights(train).agg(F.count_distinct("trade_date").cast("double")).scalar()
    out = scored.where("pred is not null").agg(F.count(F.lit(1)).alias("scored_rows"), F.count_distinct("trade_date").alias("scored_dates"))
    out = out.withColumns({"train_rows": train.agg(F.count(F.lit(1))).scalar(), "total_weight": weight, "ridge_ic": mean(ridge), "_gbt": mean(scored)})
    return rounded(out.withColumn("near_ridge_or_better", F.col("_gbt") >= F.col("ridge_ic") - 0.1).drop("_gbt"), "ridge_ic")
