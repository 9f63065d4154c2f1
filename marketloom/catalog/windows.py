"""Rolling, event and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as V
from ..fixtures import add_view
from ..functions.stats import drawdown
from ..operators import calendar as C
from ..operators import clean as CL
from ..operators import events as EV
from ..operators import portfolio as P
from ..operators import rolling as R
from ..operators import series as S
from ..operators import technical as T
from ..session import staged
from .registry import query, r, rounded
from .xsection import q_value

KEYS = ["trade_date", "symbol"]


def ship(spark, d, *cols):
    return V.ship_daily(spark, d).select(*KEYS, *cols)


@query("pct_change_n", """
    SELECT trade_date, symbol, round(close / lag(close) OVER w - 1, 6) AS ret_1, round(close / lag(close, 5) OVER w - 1, 6) AS ret_5,
           round(last_value(c IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) / last_value(c IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 6) AS padded
    FROM (SELECT *, CASE WHEN vol > 10 THEN close END AS c FROM ship_daily) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)""", "ship_daily")
def pct_change_n(spark, d):
    s = ship(spark, d, "close", "vol").withColumn("c", F.when(F.col("vol") > 10, F.col("close")))
    return s.select(*KEYS, r(R.pct_change("close")).alias("ret_1"), r(R.pct_change("close", 5)).alias("ret_5"), r(R.pct_change("c", pad=True)).alias("padded"))


@query("rolling_mean_std", """
    SELECT trade_date, symbol, round(CASE WHEN count(vol) OVER a >= 3 THEN avg(vol) OVER a END, 6) AS ma5, round(CASE WHEN count(vol) OVER b >= 10 THEN avg(vol) OVER b END, 6) AS ma20,
           round(CASE WHEN count(vol) OVER b >= 10 THEN stddev_pop(vol) OVER b END, 6) AS std20 FROM ship_daily
    WINDOW a AS (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING), b AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING)""", "ship_daily")
def rolling_mean_std(spark, d):
    s = R.rolling(ship(spark, d, "vol"), "vol", 5, 3, {"ma5": F.avg})
    s = R.rolling(s, "vol", 20, 10, {"ma20": F.avg, "std20": F.stddev_pop})
    return rounded(s.drop("vol"), "ma5", "ma20", "std20")


@query("rolling_technical_features", """
    WITH f AS (SELECT *, close / lag(close, 5) OVER w - 1 AS ret_5, close / lag(close, 20) OVER w - 1 AS ret_20, close / lag(close, 60) OVER w - 1 AS ret_60 FROM ship_daily WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
    SELECT trade_date, symbol, round(ret_5, 6) AS ret_5, round(ret_20, 6) AS ret_20, round(ret_60, 6) AS ret_60, round(CASE WHEN count(ret_5) OVER b >= 20 THEN stddev_samp(ret_5) OVER b END, 6) AS std_20,
           round(CASE WHEN count(ret_5) OVER c >= 60 THEN stddev_samp(ret_5) OVER c END, 6) AS std_60, round(CASE WHEN count(vol) OVER b >= 20 THEN vol / avg(vol) OVER b END, 6) AS vol_ratio_20, round(ln(1 + amount), 6) AS log_amount
    FROM f WINDOW b AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), c AS (PARTITION BY symbol ORDER BY trade_date ROWS 59 PRECEDING)""", "ship_daily")
def rolling_technical_features(spark, d):
    s = ship(spark, d, "close", "vol", "amount").withColumns({f"ret_{n}": R.pct_change("close", n) for n in (5, 20, 60)})
    s = R.rolling(s, "ret_5", 20, 20, {"std_20": F.stddev_samp})
    s = R.rolling(s, "ret_5", 60, 60, {"std_60": F.stddev_samp})
    s = R.rolling(s, "vol", 20, 20, {"_ma": F.avg})
    out = s.withColumns({"vol_ratio_20": F.col("vol") / F.col("_ma"), "log_amount": F.log1p("amount")})
    cols = ["ret_5", "ret_20", "ret_60", "std_20", "std_60", "vol_ratio_20", "log_amount"]
    return rounded(out.select(*KEYS, *cols), *cols)


@query("rolling_lagged_volatility", """
    WITH f AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM ship_daily WHERE amount > 0 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
    SELECT trade_date, symbol, round(CASE WHEN count(ret) OVER b >= 10 THEN stddev_samp(ret) OVER b END, 6) AS volatility FROM f
    WINDOW b AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)""", "ship_daily")
def rolling_lagged_volatility(spark, d):
    s = ship(spark, d, "close", "amount").where("amount > 0").withColumn("ret", R.pct_change("close"))
    return rounded(R.rolling(s, "ret", 21, 10, {"volatility": F.stddev_samp}, shift=1).select(*KEYS, "volatility"), "volatility")


@query("rolling_median_amount", """
    SELECT trade_date, symbol, round(CASE WHEN count(amount) OVER a >= 10 THEN quantile_cont(amount, 0.5) OVER a END, 4) AS med20,
           round(CASE WHEN count(amount) OVER b >= 30 THEN quantile_cont(amount, 0.5) OVER b END, 4) AS med60 FROM ship_daily
    WINDOW a AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""", "ship_daily")
def rolling_median_amount(spark, d):
    s = R.rolling(ship(spark, d, "amount"), "amount", 20, 10, {"med20": R.median})
    s = R.rolling(s, "amount", 60, 30, {"med60": R.median}, shift=1)
    return rounded(s.drop("amount"), "med20", "med60", digits=4)


@query("turnover_lookback", """
    WITH c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM ship_daily)),
    e AS (SELECT max(trade_date) AS t FROM ship_daily GROUP BY date_trunc('month', trade_date)),
    l AS (SELECT s.trade_date, symbol, vol, avg(vol) OVER a AS m20, quantile_cont(vol, 0.5) OVER a AS d20, count(vol) OVER a AS n20, avg(vol) OVER b AS m60, quantile_cont(vol, 0.5) OVER b AS d60, count(vol) OVER b AS n60
          FROM ship_daily s JOIN c ON c.trade_date = s.trade_date WINDOW a AS (PARTITION BY symbol ORDER BY i RANGE BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY i RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT trade_date, symbol, vol AS turnover_1d, round(CASE WHEN n20 >= 5 THEN m20 END, 6) AS turnover_mean_20d, CASE WHEN n20 >= 5 THEN d20 END AS turnover_median_20d, n20 AS turnover_observations_20d,
           round(CASE WHEN n60 >= 15 THEN m60 END, 6) AS turnover_mean_60d, CASE WHEN n60 >= 15 THEN d60 END AS turnover_median_60d, n60 AS turnover_observations_60d FROM l WHERE trade_date IN (SELECT t FROM e)""", "ship_daily")
def turnover_lookback(spark, d):
    s = staged(ship(spark, d, "vol"))
    out = R.market_lookback(s, C.sessions(s), C.month_ends(s), "vol", coverage=0.25)
    return rounded(out, "turnover_mean_20d", "turnover_mean_60d")


@query("rolling_sum_extremes", """
    SELECT trade_date, symbol, CASE WHEN count(vol) OVER a >= 35 THEN sum(vol) OVER a END AS turnover_sum, round(CASE WHEN count(high) OVER b >= 126 THEN max(high) OVER b END, 6) AS range_high,
           round(CASE WHEN count(low) OVER b >= 126 THEN min(low) OVER b END, 6) AS range_low FROM ship_daily
    WINDOW a AS (PARTITION BY symbol ORDER BY trade_date ROWS 34 PRECEDING), b AS (PARTITION BY symbol ORDER BY trade_date ROWS 125 PRECEDING)""", "ship_daily")
def rolling_sum_extremes(spark, d):
    s = EV.add_windows(ship(spark, d, "vol", "high", "low"), turnover="vol")
    return rounded(s.select(*KEYS, "turnover_sum", "range_high", "range_low"), "range_high", "range_low")


add_view("macd", ("ship_daily",), """
    WITH RECURSIVE p AS (SELECT trade_date, symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS i FROM ship_daily),
    r AS (SELECT symbol, i, trade_date, close, close AS f, close AS s, CAST(NULL AS DOUBLE) AS e FROM p WHERE i = 1
      UNION ALL SELECT p.symbol, p.i, p.trade_date, p.close, f * (11 / 13.0::DOUBLE) + p.close * (2 / 13.0::DOUBLE), s * (25 / 27.0::DOUBLE) + p.close * (2 / 27.0::DOUBLE),
        CASE WHEN p.i = 26 THEN (f * (11 / 13.0::DOUBLE) + p.close * (2 / 13.0::DOUBLE)) - (s * (25 / 27.0::DOUBLE) + p.close * (2 / 27.0::DOUBLE))
             WHEN p.i > 26 THEN e * 0.8::DOUBLE + 0.2::DOUBLE * ((f * (11 / 13.0::DOUBLE) + p.close * (2 / 13.0::DOUBLE)) - (s * (25 / 27.0::DOUBLE) + p.close * (2 / 27.0::DOUBLE))) END
      FROM r JOIN p ON p.symbol = r.symbol AND p.i = r.i + 1),
    m AS (SELECT symbol, i, trade_date, close, CASE WHEN i >= 26 THEN f - s END AS dif, CASE WHEN i >= 34 THEN e END AS dea FROM r)
    SELECT *, 2 * (dif - dea) AS bar, coalesce(dif > dea AND lag(dif) OVER w <= lag(dea) OVER w, false) AS golden, coalesce(dif < dea AND lag(dif) OVER w >= lag(dea) OVER w, false) AS dead FROM m WINDOW w AS (PARTITION BY symbol ORDER BY i)""")


def macd(spark, d):
    return EV.macd(ship(spark, d, "close"))


@query("ewm_macd", "SELECT trade_date, symbol, round(dif, 6) AS dif, round(dea, 6) AS dea, round(bar, 6) AS bar, golden, dead FROM macd", "macd")
def ewm_macd(spark, d):
    return rounded(macd(spark, d).drop("close"), "dif", "dea", "bar")


@query("double_event_pairs", """
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS i FROM ship_daily),
    f AS (SELECT symbol, trade_date, lag(trade_date) OVER w AS first_date, i - lag(i) OVER w AS gap FROM e WHERE vol > 50 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
    SELECT symbol, first_date, trade_date, CAST(gap AS INTEGER) AS gap FROM f WHERE gap <= 20""", "ship_daily")
def double_event_pairs(spark, d):
    return EV.event_pairs(ship(spark, d, "vol").withColumn("event", F.col("vol") > 50), "event")


@query("nonoverlap_exits", """
    WITH e AS (SELECT symbol, trade_date, i, i - lag(i) OVER (PARTITION BY symbol ORDER BY i) AS gap FROM macd WHERE dead),
    x AS (SELECT *, lead(trade_date) OVER w AS n1, lead(close) OVER w AS p1, lead(trade_date, 21) OVER w AS h_date, lead(close, 21) OVER w AS h_price, min(CASE WHEN golden THEN i END) OVER (w ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS gi FROM macd WINDOW w AS (PARTITION BY symbol ORDER BY i)),
    c AS (SELECT e.symbol, e.trade_date AS signal_date, n1 AS entry_date, p1 AS entry_price, h_date, h_price, g.trade_date AS g_date, g.close AS g_price FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i LEFT JOIN macd g ON g.symbol = e.symbol AND g.i = x.gi WHERE gap <= 20 AND n1 IS NOT NULL),
    a AS (SELECT *, row_number() OVER (PARTITION BY exit_policy, symbol ORDER BY signal_date) AS k FROM (SELECT 'hold_20' AS exit_policy, symbol, signal_date, entry_date, entry_price, h_date AS exit_date, h_price AS exit_price FROM c UNION ALL SELECT 'golden_cross', symbol, signal_date, entry_date, entry_price, g_date, g_price FROM c)),
    z AS (WITH RECURSIVE q AS (SELECT a.*, exit_date IS NOT NULL AS kept, coalesce(exit_date, DATE '9999-12-31') AS bound FROM a WHERE k = 1
      UNION ALL SELECT a.*, a.entry_date > bound AND a.exit_date IS NOT NULL, CASE WHEN a.entry_date > bound THEN coalesce(a.exit_date, DATE '9999-12-31') ELSE bound END FROM q JOIN a ON a.exit_policy = q.exit_policy AND a.symbol = q.symbol AND a.k = q.k + 1) SELECT * FROM q)
    SELECT symbol, signal_date, entry_date, round(entry_price, 8) AS entry_price, exit_date, round(exit_price, 8) AS exit_price, round(exit_price / entry_price - 1, 6) AS gross_return, exit_policy FROM z WHERE kept""", "macd")
def nonoverlap_exits(spark, d):
    m = staged(macd(spark, d))
    pairs = EV.event_pairs(m, "dead").select("symbol", F.col("trade_date").alias("signal_date"))
    nxt = m.withColumn("entry_date", F.lead("trade_date").over(EV.by_symbol())).withColumn("entry_price", F.lead("close").over(EV.by_symbol()))
    sig = pairs.join(nxt.select(F.col("trade_date").alias("signal_date"), "symbol", "entry_date", "entry_price"), ["signal_date", "symbol"]).where("entry_date is not null")
    sig = staged(sig)
    both = (EV.candidate_exits(sig, m, hold=20).withColumn("exit_policy", F.lit("hold_20"))
            .unionByName(EV.candidate_exits(sig, m).withColumn("exit_policy", F.lit("golden_cross"))))
    return rounded(rounded(EV.nonoverlapping(both, ["exit_policy"]), "gross_return"), "entry_price", "exit_price", digits=8)


add_view("year_trades", ("ship_daily",), """
    SELECT symbol, CASE year(trade_date) % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS exit_policy, min(trade_date) AS entry_date, arg_min(close, trade_date) AS entry_price,
           max(trade_date) AS exit_date, arg_max(close, trade_date) AS exit_price, count(*) - 1 AS hold_days, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS net_return
    FROM ship_daily GROUP BY symbol, year(trade_date) HAVING count(*) > 1""")
add_view("curve", ("year_trades", "ship_daily"), """
    WITH m AS (SELECT exit_policy, trade_date, mark / coalesce(lag(mark) OVER (PARTITION BY exit_policy, symbol, entry_date ORDER BY trade_date), entry_price) - 1 AS ret
               FROM (SELECT t.*, trade_date, CASE WHEN trade_date = exit_date THEN exit_price ELSE close END AS mark FROM year_trades t JOIN ship_daily b ON b.symbol = t.symbol AND b.trade_date BETWEEN entry_date AND exit_date)),
    g AS (SELECT exit_policy, trade_date FROM (SELECT DISTINCT exit_policy FROM year_trades), (SELECT DISTINCT trade_date FROM ship_daily)),
    f AS (SELECT exit_policy, d, sum(n) AS n FROM (SELECT exit_policy, entry_date AS d, 1 AS n FROM year_trades UNION ALL SELECT exit_policy, exit_date, -1 FROM year_trades) GROUP BY 1, 2)
    SELECT g.exit_policy, g.trade_date, CAST(coalesce(sum(n) OVER (PARTITION BY g.exit_policy ORDER BY g.trade_date), 0) AS BIGINT) AS n_positions, coalesce(a, 0.0) AS portfolio_return
    FROM g LEFT JOIN (SELECT exit_policy, trade_date, avg(ret) AS a FROM m GROUP BY 1, 2) m ON m.exit_policy = g.exit_policy AND m.trade_date = g.trade_date
    LEFT JOIN f ON f.exit_policy = g.exit_policy AND f.d = g.trade_date""")


def year_trades(bars):
    t = bars.groupBy("symbol", F.year("trade_date").alias("y")).agg(
        F.min("trade_date").alias("entry_date"), F.min_by("close", "trade_date").alias("entry_price"), F.max("trade_date").alias("exit_date"),
        F.max_by("close", "trade_date").alias("exit_price"), (F.count(F.lit(1)) - 1).alias("hold_days")).where("hold_days > 0")
    return t.withColumns({"exit_policy": F.when(F.col("y") % 2 == 0, "even").otherwise("odd"), "net_return": F.col("exit_price") / F.col("entry_price") - 1.0}).drop("y")


@query("position_mark_curve", "SELECT exit_policy, trade_date, n_positions, round(portfolio_return, 6) AS portfolio_return FROM curve", "curve")
def position_mark_curve(spark, d):
    b = staged(ship(spark, d, "close"))
    return rounded(EV.position_curve(year_trades(b), b, ["even", "odd"]), "portfolio_return")


@query("trade_metrics", """
    SELECT exit_policy, count(*) AS n_trades, round(avg((net_return > 0)::INT), 6) AS win_rate, round(avg(net_return), 6) AS avg_return, round(median(net_return), 6) AS median_return,
           round(avg(hold_days), 6) AS avg_hold_days, median(hold_days) AS median_hold_days FROM year_trades GROUP BY 1""", "year_trades")
def trade_metrics(spark, d):
    return rounded(EV.trade_metrics(staged(year_trades(ship(spark, d, "close"))), ["exit_policy"]), "win_rate", "avg_return", "median_return", "avg_hold_days")


@query("equal_weight_benchmark", """
    SELECT trade_date, round(avg(r), 6) AS benchmark_return FROM (SELECT trade_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM daily WHERE NOT is_suspended AND trade_date >= DATE '2024-01-05') GROUP BY 1""", "daily")
def equal_weight_benchmark(spark, d):
    return rounded(P.equal_weight_benchmark(V.daily(spark, d), "2024-01-05"), "benchmark_return")


@query("portfolio_curve_metrics", """
    WITH b AS (SELECT trade_date, avg(r) AS br FROM (SELECT trade_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM ship_daily) GROUP BY 1),
    c AS (SELECT *, portfolio_return / 2000 AS pr, coalesce(br, 0) / 1000 AS bm FROM curve LEFT JOIN b USING (trade_date)),
    n AS (SELECT *, nav / max(nav) OVER (PARTITION BY exit_policy ORDER BY trade_date) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + pr)) OVER (PARTITION BY exit_policy ORDER BY trade_date)) AS nav FROM c))
    SELECT exit_policy, count(*) AS days, round(avg(n_positions), 6) AS n_positions_avg, round(exp(sum(ln(1 + pr)) * 252.0::DOUBLE / count(*)) - 1, 6) AS ann_return, round(stddev_pop(pr) * sqrt(252.0::DOUBLE), 6) AS ann_vol,
           round(avg(pr) / stddev_pop(pr) * sqrt(252.0::DOUBLE), 6) AS sharpe, round(min(dd), 6) AS max_drawdown, round(avg((pr > 0)::INT), 6) AS win_rate_days, round(product(1 + bm) - 1, 6) AS benchmark_total_return FROM n GROUP BY 1""", "curve ship_daily")
def portfolio_curve_metrics(spark, d):
    b = staged(ship(spark, d, "close"))
    curve = EV.position_curve(year_trades(b), b, ["even", "odd"]).withColumn("portfolio_return", F.col("portfolio_return") / 2000)
    bench = P.equal_weight_benchmark(b.withColumn("is_suspended", F.lit(False)), "1900-01-01").withColumn("benchmark_return", F.coalesce("benchmark_return", F.lit(0.0)) / 1000)
    m = P.curve_metrics(curve.join(bench, "trade_date", "left"), ["exit_policy"])
    cols = ["n_positions_avg", "ann_return", "ann_vol", "sharpe", "max_drawdown", "win_rate_days", "benchmark_total_return"]
    return rounded(m.select("exit_policy", "days", *cols), *cols)


@query("market_proxy", "SELECT trade_date, round(avg(pct_chg) / 100, 8) AS ret FROM daily WHERE pct_chg IS NOT NULL GROUP BY 1", "daily")
def market_proxy(spark, d):
    return rounded(S.market_proxy(V.daily(spark, d)), "ret", digits=8)


MARKET = "(SELECT trade_date, avg(pct_chg) / 100 AS ret FROM daily WHERE pct_chg IS NOT NULL GROUP BY 1)"


@query("weekday_effect", f"""SELECT dayname(trade_date) AS weekday, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std, count(*) AS days, round(avg((ret > 0)::INT), 6) AS win_rate FROM {MARKET} GROUP BY 1""", "daily")
def weekday_effect(spark, d):
    return rounded(S.weekday_effect(S.market_proxy(V.daily(spark, d))), "mean", "std", "win_rate")


@query("streak_next_return", f"""
    WITH m AS (SELECT *, lead(ret) OVER w AS nx, coalesce(ret > 0.002 AND lag(ret) OVER w > 0.002 AND lag(ret, 2) OVER w > 0.002, false) AS hot FROM {MARKET} WINDOW w AS (ORDER BY trade_date))
    SELECT count(*) FILTER (hot) AS events, round(avg(nx) FILTER (hot), 6) AS mean_after, round(avg((nx > 0)::INT) FILTER (hot), 6) AS win_after, round(avg(nx), 6) AS mean_all, round(avg((nx > 0)::INT), 6) AS win_all FROM m WHERE nx IS NOT NULL""", "daily")
def streak_next_return(spark, d):
    return rounded(S.streak_next(S.market_proxy(V.daily(spark, d)), 3, 0.002), "mean_after", "win_after", "mean_all", "win_all")


NAV_SQL = "(SELECT *, nav / max(nav) OVER (PARTITION BY series ORDER BY trade_date) - 1 AS dd FROM (SELECT *, product(1 + ret) OVER (PARTITION BY series ORDER BY trade_date) AS nav FROM series))"


@query("nav_drawdown", f"SELECT series, trade_date, round(nav, 8) AS nav, round(dd, 8) AS drawdown FROM {NAV_SQL}", "series")
def nav_drawdown(spark, d):
    out = drawdown(V.series(spark, d), ["series"], "trade_date", "ret")
    return rounded(out.select("series", "trade_date", "nav", "drawdown"), "nav", "drawdown", digits=8)


@query("longest_underwater", f"""
    WITH u AS (SELECT series, trade_date, dd < 0 AS under, row_number() OVER (PARTITION BY series ORDER BY trade_date) - row_number() OVER (PARTITION BY series, dd < 0 ORDER BY trade_date) AS g FROM {NAV_SQL}),
    l AS (SELECT series, g, count(*) AS n FROM u WHERE under GROUP BY 1, 2) SELECT s.series, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT series FROM series) s LEFT JOIN l ON l.series = s.series GROUP BY 1""", "series")
def longest_underwater(spark, d):
    return S.longest_underwater(V.series(spark, d))


@query("trailing_returns", """
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY trade_date DESC) AS k FROM series)
    SELECT series, round(product(1 + ret) FILTER (k <= 5) - 1, 8) AS last_5, round(product(1 + ret) FILTER (k <= 21) - 1, 8) AS last_21, CAST(NULL AS DOUBLE) AS last_126, round(product(1 + ret) - 1, 8) AS ytd FROM k GROUP BY 1""", "series")
def trailing_returns(spark, d):
    return rounded(S.trailing(V.series(spark, d), (5, 21, 126)), "last_5", "last_21", "last_126", "ytd", digits=8)


def monthly(spark, d):
    """Monthly series per region: change of total shipped value."""
    from pyspark.sql import Window
    p = V.panel_supplier(spark, d).join(V.industry_supplier(spark, d), "symbol")
    m = p.groupBy(F.col("industry").alias("series"), "trade_date").agg(F.sum("amount").alias("a"))
    w = Window.partitionBy("series").orderBy("trade_date")
    return m.withColumn("ret", (F.col("a") / F.lag("a").over(w) - 1.0) / 5.0).where("ret is not null").select("series", "trade_date", "ret")


add_view("monthly", ("panel_supplier", "industry_supplier"), """
    SELECT series, trade_date, ret FROM (SELECT series, trade_date, (a / lag(a) OVER (PARTITION BY series ORDER BY trade_date) - 1) / 5 AS ret
    FROM (SELECT industry AS series, trade_date, sum(amount) AS a FROM panel_supplier JOIN industry_supplier USING (symbol) GROUP BY 1, 2)) WHERE ret IS NOT NULL""")


@query("rolling_odds", " UNION ALL ".join(f"""
    SELECT series, {n} AS "window", count(*) AS samples, count(*) FILTER (r < 0) AS negative, round(count(*) FILTER (r < 0) / count(*), 6) AS negative_share,
           round((count(*) - count(*) FILTER (r < 0)) / nullif(count(*) FILTER (r < 0), 0), 6) AS odds FROM (SELECT series, product(1 + ret) OVER w - 1 AS r, count(*) OVER w AS c FROM monthly
    WINDOW w AS (PARTITION BY series ORDER BY trade_date ROWS {n - 1} PRECEDING)) WHERE c >= {n} GROUP BY 1""" for n in (6, 12, 24, 36, 60)), "monthly")
def rolling_odds(spark, d):
    return rounded(S.rolling_odds(staged(monthly(spark, d)), (6, 12, 24, 36, 60)), "negative_share", "odds")


@query("failure_segments", """
    WITH r AS (SELECT series, trade_date, count(*) OVER w >= 12 AND product(1 + ret) OVER w - 1 < 0 AS neg FROM monthly WINDOW w AS (PARTITION BY series ORDER BY trade_date ROWS 11 PRECEDING)),
    g AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY trade_date) - row_number() OVER (PARTITION BY series, neg ORDER BY trade_date) AS g FROM r)
    SELECT series, min(trade_date) AS start, max(trade_date) AS "end", count(*) AS length FROM g WHERE neg GROUP BY series, g""", "monthly")
def failure_segments(spark, d):
    return S.failure_segments(monthly(spark, d), 12)


@query("period_returns", """
    SELECT series, 'year' AS unit, CAST(date_trunc('year', trade_date) AS DATE) AS period, round(product(1 + ret) - 1, 6) AS period_return FROM monthly GROUP BY 1, 3
    UNION ALL SELECT series, 'quarter', CAST(date_trunc('quarter', trade_date) AS DATE), round(product(1 + ret) - 1, 6) FROM monthly GROUP BY 1, 3""", "monthly")
def period_returns(spark, d):
    m = staged(monthly(spark, d))
    out = S.period_returns(m, "year").withColumn("unit", F.lit("year")).unionByName(S.period_returns(m, "quarter").withColumn("unit", F.lit("quarter")))
    return rounded(out, "period_return")


HIST = ["c_lag1", "c_lag2", "c_ma3", "c_ma5", "c_ma10", "c_chg1", "c_chg3", "c_chg5", "c_vol5", "c_vol10", "c_zscore", "c_rank_pct"]


@query("score_history_features", """
    WITH p AS (SELECT trade_date, symbol, amount / 1000 AS s FROM panel_supplier WHERE trade_date >= make_date(1995 + CAST(symbol % 3 AS INTEGER), 1, 1)),
    h AS (SELECT *, row_number() OVER w AS k, avg(s) OVER (PARTITION BY trade_date) AS m, stddev_pop(s) OVER (PARTITION BY trade_date) AS sd, count(*) OVER (PARTITION BY trade_date) AS n, sum(s) OVER (PARTITION BY trade_date) AS sm,
          rank() OVER (PARTITION BY trade_date ORDER BY s) AS rk, lag(s) OVER w AS l1, lag(s, 2) OVER w AS l2, lag(s, 3) OVER w AS l3, lag(s, 5) OVER w AS l5, avg(s) OVER (w ROWS 2 PRECEDING) AS m3, avg(s) OVER (w ROWS 4 PRECEDING) AS m5,
          avg(s) OVER (w ROWS 9 PRECEDING) AS m10, stddev_pop(s) OVER (w ROWS 4 PRECEDING) AS v5, stddev_pop(s) OVER (w ROWS 9 PRECEDING) AS v10 FROM p WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
    SELECT trade_date, symbol, round(coalesce(l1, 0), 6) AS c_lag1, round(coalesce(l2, 0), 6) AS c_lag2, round(CASE WHEN k >= 3 THEN m3 ELSE s END, 6) AS c_ma3, round(CASE WHEN k >= 5 THEN m5 ELSE s END, 6) AS c_ma5,
           round(CASE WHEN k >= 10 THEN m10 ELSE s END, 6) AS c_ma10, round(s - coalesce(l1, 0), 6) AS c_chg1, round(coalesce(s - l3, 0), 6) AS c_chg3, round(coalesce(s - l5, 0), 6) AS c_chg5, round(CASE WHEN k >= 5 THEN v5 ELSE 0 END, 6) AS c_vol5,
           round(CASE WHEN k >= 10 THEN v10 ELSE 0 END, 6) AS c_vol10, round(CASE WHEN sd > 0 THEN (s - m) / sd ELSE 0 END, 6) AS c_zscore, round((rk - 1) / n, 6) AS c_rank_pct, n AS c_count, n AS c_breadth, round(sm, 2) AS c_sum FROM h""", "panel_supplier")
def score_history_features(spark, d):
    p = V.panel_supplier(spark, d).select(*KEYS, (F.col("amount") / 1000).alias("s"))
    first = p.select("symbol").distinct().withColumn("first_date", F.make_date((1995 + F.col("symbol") % 3).cast("int"), F.lit(1), F.lit(1)))
    out = T.score_history(staged(p), "s", first).select(*KEYS, *HIST, "c_count", "c_breadth", "c_sum")
    return rounded(rounded(out, *HIST), "c_sum", digits=2)


IND = ["roc_12", "roc_18", "roc_20", "cumret_120", "vol_120", "skew_60", "kurt_60", "atr_ratio", "vol_ratio", "aroon_up", "aroon_down", "dispersion_5", "high_low", "close_open"]


@query("technical_indicators", """
    WITH a AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS pc FROM ship_daily WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
    b AS (SELECT *, close / pc - 1 AS ret, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM a),
    c AS (SELECT trade_date, symbol, i, coalesce(close / lag(close, 12) OVER w - 1, 0) AS roc_12, coalesce(close / lag(close, 18) OVER w - 1, 0) AS roc_18, coalesce(close / lag(close, 20) OVER w - 1, 0) AS roc_20,
          CASE WHEN count(ret) OVER x >= 120 THEN product(1 + ret) OVER x - 1 ELSE 0 END AS cumret_120, CASE WHEN count(ret) OVER x >= 120 THEN stddev_samp(ret) OVER x * sqrt(252.0::DOUBLE) ELSE 0 END AS vol_120,
          CASE WHEN count(ret) OVER y >= 60 THEN skewness(ret) OVER y ELSE 0 END AS skew_60, CASE WHEN count(ret) OVER y >= 60 THEN kurtosis(ret) OVER y ELSE 0 END AS kurt_60,
          avg(tr) OVER z / close AS atr_ratio, avg(vol) OVER q / avg(vol) OVER z AS vol_ratio, (25.0 - (i - arg_max(i, {'v': high, 'i': -i}) OVER u)) / 25.0::DOUBLE * 100 AS aroon_up,
          (25.0 - (i - arg_min(i, {'v': low, 'i': i}) OVER u)) / 25.0::DOUBLE * 100 AS aroon_down, stddev_samp(close) OVER q / avg(close) OVER q AS dispersion_5, CASE WHEN low > 0 THEN high / low ELSE 1 END AS high_low, CASE WHEN high + low > 0 THEN close / ((high + low) / 2) ELSE 1 END AS close_open FROM b
          WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), x AS (w ROWS 119 PRECEDING), y AS (w ROWS 59 PRECEDING), z AS (w ROWS 19 PRECEDING), q AS (w ROWS 4 PRECEDING), u AS (w ROWS 24 PRECEDING))
    SELECT trade_date, symbol, """ + ", ".join(f"round({c}, {4 if c in ('skew_60', 'kurt_60', 'cumret_120') else 6}) AS {c}" for c in IND) + " FROM c WHERE i >= 60", "ship_daily")
def technical_indicators(spark, d):
    out = T.indicators(ship(spark, d, "close", "high", "low", "vol").withColumn("open", (F.col("high") + F.col("low")) / 2))
    few = ["skew_60", "kurt_60", "cumret_120"]
    return rounded(rounded(out, *[c for c in IND if c not in few]), *few, digits=4)


@query("risk_budget_weights", """
    WITH p AS (SELECT trade_date, max(ret) FILTER (series = 'view') AS small, max(ret) FILTER (series = 'click') AS lowturn FROM series GROUP BY 1),
    v AS (SELECT trade_date, CASE WHEN count(*) OVER w >= 10 THEN stddev_samp(small) OVER w ELSE 1 END AS a, CASE WHEN count(*) OVER w >= 10 THEN stddev_samp(lowturn) OVER w ELSE 1 END AS b FROM p WINDOW w AS (ORDER BY trade_date ROWS 19 PRECEDING))
    SELECT trade_date, round(least((1 / a) / (1 / a + 1 / b), 0.5), 6)::DOUBLE AS small, round(1 - least((1 / a) / (1 / a + 1 / b), 0.5), 6)::DOUBLE AS lowturn FROM v""", "series")
def risk_budget_weights(spark, d):
    w = V.series(spark, d).groupBy("trade_date").pivot("series", ["view", "click"]).agg(F.max("ret")).toDF("trade_date", "small", "lowturn")
    return rounded(S.inverse_vol_allocation(w, "small", "lowturn", 20, 10, 0.5), "small", "lowturn")


@query("first_fill_date", """
    WITH o AS (SELECT trade_date AS execution_date, symbol, CASE WHEN pred > 0.9 THEN 'buy' ELSE 'sell' END AS side FROM daily WHERE pred > 0.9 OR pred < 0.1),
    c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS s FROM (SELECT DISTINCT trade_date FROM daily)),
    f AS (SELECT o.*, min(b.trade_date) AS fill_date FROM o LEFT JOIN daily b ON b.symbol = o.symbol AND b.trade_date >= execution_date AND b.n > 1 AND CASE side WHEN 'buy' THEN NOT b.is_limit_up ELSE NOT b.is_limit_down END GROUP BY 1, 2, 3)
    SELECT execution_date, symbol, side, fill_date, y.s - x.s AS blocked_days FROM f JOIN c x ON x.trade_date = execution_date LEFT JOIN c y ON y.trade_date = fill_date""", "daily")
def first_fill_date(spark, d):
    b = staged(V.daily(spark, d))
    side = F.when(F.col("pred") > 0.9, "buy").otherwise("sell")
    o = b.where("pred > 0.9 or pred < 0.1").select(F.col("trade_date").alias("execution_date"), "symbol", side.alias("side"))
    return EV.first_fill(o, CL.price_limit_flags(b.withColumn("amount", F.when(F.col("n") > 1, F.col("amount")))))


@query("formation_targets", """
    WITH c AS (SELECT trade_date AS t, lead(trade_date) OVER (ORDER BY trade_date) AS execution_date FROM (SELECT DISTINCT trade_date FROM factors)),
    s AS (SELECT trade_date, symbol, CASE bucket WHEN 4 THEN 'long' ELSE 'short' END AS side FROM q_value WHERE valid AND (bucket = 4 OR (bucket = 0 AND symbol % 5 <> 0)))
    SELECT trade_date, execution_date, symbol, side, round(1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date, side), 8) AS weight FROM s JOIN c ON t = trade_date WHERE execution_date IS NOT NULL""", "q_value")
def formation_targets(spark, d):
    q = staged(q_value(spark, d))
    cal = V.panel_part(spark, d).select("trade_date").distinct()
    out = P.formation_targets(q, cal, short_allowed=q.where("symbol % 5 <> 0").select(*KEYS))
    return rounded(out, "weight", digits=8)


@query("active_exposure_dates", """
    WITH f AS (SELECT max(trade_date) AS f, lead(max(trade_date)) OVER (ORDER BY max(trade_date)) AS n FROM ship_daily GROUP BY date_trunc('month', trade_date)), d AS (SELECT DISTINCT trade_date FROM ship_daily)
    SELECT f AS formation_date, trade_date FROM f JOIN d ON trade_date > f AND trade_date <= n WHERE month(f) % 4 <> 0""", "ship_daily")
def active_exposure_dates(spark, d):
    days = V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()
    f = C.month_ends(days).select(F.col("trade_date").alias("formation_date"), (F.month("trade_date") % 4 != 0).alias("valid"))
    return P.active_dates(f, days)


@query("cost_adjusted_spread", """
    WITH t AS (SELECT trade_date, symbol, next_ret, CASE bucket WHEN 4 THEN 'long' ELSE 'short' END AS side FROM q_value WHERE valid AND bucket IN (0, 4)),
    w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date, side) AS w FROM t), c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM q_value)),
    x AS (SELECT i, side, symbol, w FROM w JOIN c USING (trade_date)), n AS (SELECT coalesce(a.i, b.i + 1) AS i, coalesce(a.side, b.side) AS side, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS traded
      FROM x a FULL JOIN x b ON b.side = a.side AND b.symbol = a.symbol AND b.i = a.i - 1 GROUP BY 1, 2),
    l AS (SELECT trade_date, side, sum(next_ret) AS s, count(*) - count(next_ret) AS miss, count(*) AS k FROM t GROUP BY 1, 2), j AS (SELECT c.trade_date, n.side, s, miss, k, traded FROM n JOIN c USING (i) LEFT JOIN l ON l.trade_date = c.trade_date AND l.side = n.side),
    g AS (SELECT trade_date, cost_bps, terminal, sum(CASE side WHEN 'long' THEN 1 ELSE -1 END * coalesce((coalesce(s, 0) + miss * terminal) / k, 0)) AS gross, sum(traded) AS traded FROM j, (VALUES (10.0::DOUBLE), (30.0::DOUBLE)) b(cost_bps), (VALUES (0.0::DOUBLE), (-0.5::DOUBLE)) r(terminal) GROUP BY 1, 2, 3)
    SELECT trade_date, cost_bps, terminal, round(gross, 6) AS gross, round(traded, 6) AS traded, round(gross - traded * cost_bps / 10000, 6) AS net FROM g""", "q_value")
def cost_adjusted_spread(spark, d):
    q = staged(q_value(spark, d))
    side = F.when(F.col("bucket") == 4, "long").when(F.col("bucket") == 0, "short")
    legs = q.where("valid").select(*KEYS, "next_ret", side.alias("side")).where("side is not null")
    return rounded(P.cost_adjusted_spread(legs, [10, 30], [0.0, -0.5], q), "gross", "traded", "net")


@query("momentum_signal", """
    WITH p AS (SELECT trade_date, max(nav) FILTER (series = 'view') AS a, max(nav) FILTER (series = 'click') AS b FROM (SELECT series, trade_date, product(1 + ret) OVER (PARTITION BY series ORDER BY trade_date) AS nav FROM series) GROUP BY 1),
    m AS (SELECT trade_date, a / lag(a, 5) OVER w - 1 AS ma, b / lag(b, 5) OVER w - 1 AS mb FROM p WINDOW w AS (ORDER BY trade_date))
    SELECT trade_date, round(ma, 8) AS first_momentum, round(mb, 8) AS second_momentum, CASE WHEN mb > ma THEN 'b' ELSE 'a' END AS stronger FROM m WHERE ma IS NOT NULL AND mb IS NOT NULL""", "series")
def momentum_signal(spark, d):
    from ..functions.stats import nav
    from ..plans.rotation import momentum
    w = nav(V.series(spark, d), ["series"], "trade_date", "ret").groupBy("trade_date").pivot("series", ["view", "click"]).agg(F.max("nav")).toDF("trade_date", "a", "b")
    return rounded(momentum(w, "a", "b", 5), "first_momentum", "second_momentum", digits=8)


@query("rebalance_calendar", """
    WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS t FROM lineitem), e AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t DESC) AS k FROM d) WHERE k > 2)
    SELECT 'weekly' AS frequency, t AS trade_date FROM (SELECT max(t) AS t FROM e GROUP BY date_trunc('week', t) UNION SELECT min(t) FROM e) UNION ALL
    SELECT 'monthly', t FROM (SELECT max(t) AS t FROM e GROUP BY date_trunc('month', t) UNION SELECT min(t) FROM e) UNION ALL SELECT 'daily', t FROM e UNION ALL SELECT 'initial', min(t) FROM e""")
def rebalance_calendar(spark, d):
    days = staged(V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct())
    parts = [C.rebalance_dates(days, f).select(F.lit(f).alias("frequency"), "trade_date") for f in ("weekly", "monthly", "daily", "initial")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).withColumn("trade_date", F.col("trade_date").cast("date"))


@query("holding_periods", """
    WITH d AS (SELECT t, lead(t) OVER (ORDER BY t) AS n, max(t) OVER () AS last FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS t FROM lineitem)),
    s AS (SELECT max(t) AS s FROM d GROUP BY date_trunc('month', t)), j AS (SELECT s AS signal_date, n AS entry_date, last, lead(n) OVER (ORDER BY s) AS nx FROM s JOIN d ON t = s)
    SELECT signal_date, entry_date, coalesce(nx, last) AS exit_date FROM j WHERE coalesce(nx, last) > entry_date""")
def holding_periods(spark, d):
    days = V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()
    return C.holding_periods(C.month_ends(days), days)


@query("pct_common_panel", """
    WITH p AS (SELECT symbol % 50 AS panel, trade_date, symbol, round(open * adj_factor, 6) AS adj_open, round(close * adj_factor, 6) AS adj_close FROM daily)
    SELECT * FROM p WHERE (panel, trade_date) IN (SELECT (panel, trade_date) FROM (SELECT panel, trade_date, count(*) AS n FROM p GROUP BY 1, 2)
      JOIN (SELECT panel, count(DISTINCT symbol) AS n FROM p GROUP BY 1) USING (panel, n))""", "daily")
def pct_common_panel(spark, d):
    from ..plans.rotation import common_panel
    p = V.daily(spark, d).select((F.col("symbol") % 50).alias("panel"), *KEYS, "open", "close", "adj_factor")
    return rounded(common_panel(staged(p), ["panel"]), "adj_open", "adj_close")
