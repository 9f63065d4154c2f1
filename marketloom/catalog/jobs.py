"""Rotation, style-factor and style-replica jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as V
from ..fixtures import add_view
from ..functions.stats import nav
from ..operators import calendar as C
from ..plans import books as B
from ..plans import replica as RP
from ..plans import rotation as RO
from ..plans import style as ST
from ..session import staged
from . import books as _views  # noqa: F401  (reb and win)
from .registry import query, r, rounded

KEYS = ["trade_date", "symbol"]

# --- rotation ------------------------------------------------------------------------------

add_view("rp", ("series",), "SELECT trade_date, series AS symbol, 10 * product(1 + ret) OVER (PARTITION BY series ORDER BY trade_date) AS price FROM series WHERE series IN ('view', 'click', 'error')")


def mom_sql(n: int) -> str:
    return f"""SELECT trade_date, CASE WHEN b / lag(b, {n}) OVER w > a / lag(a, {n}) OVER w THEN 'click' ELSE 'view' END AS stronger, a / lag(a, {n}) OVER w AS ma FROM
        (SELECT trade_date, max(price) FILTER (symbol = 'view') AS a, max(price) FILTER (symbol = 'click') AS b FROM rp GROUP BY 1) WINDOW w AS (ORDER BY trade_date)"""


def rot_sql(mom: str) -> str:
    """Signals, targets, periods and results as CTEs from a momentum query (variant, trade_date, stronger)."""
    return f"""m AS ({mom}), cal AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nx, max(trade_date) OVER () AS last, row_number() OVER (ORDER BY trade_date DESC) AS k FROM (SELECT DISTINCT trade_date FROM rp)),
      e AS (SELECT m.* FROM m JOIN cal USING (trade_date) WHERE k > 2), s0 AS (SELECT variant, max(trade_date) AS trade_date FROM e GROUP BY variant, date_trunc('week', trade_date) UNION SELECT variant, min(trade_date) FROM e GROUP BY 1),
      s AS (SELECT e.* FROM e JOIN s0 USING (variant, trade_date)), p0 AS (SELECT variant, trade_date, nx AS entry_date, coalesce(lead(nx) OVER (PARTITION BY variant ORDER BY trade_date), last) AS exit_date FROM s JOIN cal USING (trade_date)), p AS (SELECT * FROM p0 WHERE entry_date < exit_date),
      t AS (SELECT variant, trade_date, 'error' AS symbol, 0.4::DOUBLE AS weight, stronger FROM s UNION ALL SELECT variant, trade_date, stronger, 0.6::DOUBLE, stronger FROM s),
      g AS (SELECT t.variant, t.trade_date, entry_date, exit_date, sum(weight * (x.price / n.price - 1)) AS gross_return FROM t JOIN p USING (variant, trade_date) JOIN rp n ON n.trade_date = entry_date AND n.symbol = t.symbol JOIN rp x ON x.trade_date = exit_date AND x.symbol = t.symbol GROUP BY ALL),
      i AS (SELECT variant, trade_date, dense_rank() OVER (PARTITION BY variant ORDER BY trade_date) AS i FROM p), h AS (SELECT t.*, i FROM t JOIN i USING (variant, trade_date)),
      u AS (SELECT coalesce(a.variant, b.variant) AS variant, coalesce(a.i, b.i + 1) AS i, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover FROM h a FULL JOIN h b ON a.variant = b.variant AND a.symbol = b.symbol AND b.i = a.i - 1 GROUP BY 1, 2),
      res AS (SELECT g.*, turnover, turnover * 25 / 10000 AS fee_cost, gross_return - turnover * 25 / 10000 AS net_return FROM g JOIN i USING (variant, trade_date) JOIN u USING (variant, i)),
      v AS (SELECT r.variant, r.trade_date AS rebalance_date, d.trade_date, gross_return, net_return, sum(weight * d.price / n.price) AS v FROM res r JOIN t ON t.variant = r.variant AND t.trade_date = r.trade_date JOIN rp n ON n.trade_date = entry_date AND n.symbol = t.symbol
        JOIN rp d ON d.symbol = t.symbol AND d.trade_date > entry_date AND d.trade_date <= exit_date GROUP BY ALL),
      day AS (SELECT variant, rebalance_date, trade_date, gd AS gross_daily, CASE WHEN k = 1 THEN (1 + gd) * (1 + net_return) / (1 + gross_return) - 1 ELSE gd END AS net_daily FROM
        (SELECT *, v / coalesce(lag(v) OVER w, 1) - 1 AS gd, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY variant, rebalance_date ORDER BY trade_date)))"""


ONE = f"SELECT 'cs' AS variant, trade_date, stronger FROM ({mom_sql(5)}) WHERE ma IS NOT NULL"
BY = ["variant"]


def prices(spark, d):
    s = V.series(spark, d).where("series in ('view', 'click', 'error')")
    return nav(s, ["series"], "trade_date", "ret").select("trade_date", F.col("series").alias("symbol"), (10.0 * F.col("nav")).alias("price"))


def momentum(p, n: int):
    w = p.groupBy("trade_date").pivot("symbol", ["view", "click"]).agg(F.max("price"))
    return RO.momentum(w, "view", "click", n).select("trade_date", "stronger")


def weekly(p, m):
    """Signal rows on the weekly schedule; the last two sessions of the calendar are out."""
    cal = C.rebalance_dates(p, "daily")
    e = m.join(cal, "trade_date", "left_semi")
    week = e.groupBy(*BY, F.date_trunc("week", "trade_date").alias("_w")).agg(F.max("trade_date").alias("trade_date")).select(*BY, "trade_date")
    first = e.groupBy(*BY).agg(F.min("trade_date").alias("trade_date"))
    return e.join(week.union(first).distinct(), [*BY, "trade_date"])


def rotation(spark, d, lookbacks=((5, "cs"),), start=None):
    p = staged(prices(spark, d))
    m = None
    for n, name in lookbacks:
        x = momentum(p, n).withColumn("variant", F.lit(name))
        m = x if m is None else m.unionByName(x)
    if len(lookbacks) > 1:  # common start: the latest first date
        m = staged(m)
        first = m.groupBy(*BY).agg(F.min("trade_date").alias("f")).agg(F.max("f")).scalar()
        m = m.where(F.col("trade_date") >= first)
    s = staged(weekly(p, m))
    t = RO.targets(s, "core_satellite", "error", ("view", "click"), 0.4, BY)
    res = RO.period_backtest(t, RO.signal_periods(s, p, BY), p, 25.0, BY)
    return p, t, res


@query("rotation_targets", f"""WITH {rot_sql(ONE)} SELECT 'core_satellite' AS kind, trade_date, symbol, round(weight, 6) AS weight, stronger AS selected_leg FROM t
    UNION ALL SELECT 'balanced', trade_date, x.symbol, x.w, 'balanced' FROM s, (VALUES ('error', 0.4::DOUBLE), ('view', 0.3::DOUBLE), ('click', 0.3::DOUBLE)) x(symbol, w) UNION ALL SELECT 'single', trade_date, 'error', 1.0, 'error' FROM s""", "rp")
def rotation_targets(spark, d):
    p = staged(prices(spark, d))
    s = staged(weekly(p, momentum(p, 5).withColumn("variant", F.lit("cs"))))
    parts = [RO.targets(s, k, "error", ("view", "click"), 0.4, BY).withColumn("kind", F.lit(k)) for k in ("core_satellite", "balanced", "single")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("variant"), "weight")


@query("period_backtest", f"""WITH {rot_sql(ONE)} SELECT trade_date, entry_date, exit_date, round(gross_return, 8) AS gross_return, round(turnover, 6) AS turnover, round(fee_cost, 8) AS fee_cost, round(net_return, 8) AS net_return FROM res""", "rp")
def period_backtest(spark, d):
    res = rotation(spark, d)[2].drop("variant")
    return rounded(rounded(res, "gross_return", "fee_cost", "net_return", digits=8), "turnover")


@query("daily_reconstruction", f"WITH {rot_sql(ONE)} SELECT rebalance_date, trade_date, round(gross_daily, 8) AS gross_daily, round(net_daily, 8) AS net_daily FROM day", "rp")
def daily_reconstruction(spark, d):
    p, t, res = rotation(spark, d)
    return rounded(RO.daily_reconstruction(staged(res), t, p, p, BY).drop("variant"), "gross_daily", "net_daily", digits=8)


ROT = ["total_return", "annual_return", "sharpe", "gross_total_return", "turnover_sum", "fee_cost_sum", "cost_drag"]
SUM_SQL = """a AS (SELECT variant, count(*) AS days, product(1 + net_daily) - 1 AS total_return, power(product(1 + net_daily), 252.0::DOUBLE / count(*)) - 1 AS annual_return, avg(net_daily) / stddev_samp(net_daily) * sqrt(252.0::DOUBLE) AS sharpe, product(1 + gross_daily) - 1 AS gross_total_return FROM day GROUP BY 1),
    b AS (SELECT variant, count(*) AS periods, sum(turnover) AS turnover_sum, sum(fee_cost) AS fee_cost_sum FROM res GROUP BY 1), c AS (SELECT variant, count(*) FILTER (ch) AS switches FROM (SELECT variant, stronger <> lag(stronger) OVER (PARTITION BY variant ORDER BY trade_date) AS ch FROM s) GROUP BY 1)
    SELECT variant, days, periods, switches, """ + ", ".join(f"round({c}, 6) AS {c}" for c in ROT[:-1]) + ", round(gross_total_return - total_return, 6) AS cost_drag FROM a JOIN b USING (variant) JOIN c USING (variant)"


def summarized(p, t, res):
    res = staged(res)
    return rounded(RO.summary(res, RO.daily_reconstruction(res, t, p, p, BY), t, BY), *ROT)


@query("rotation_summary", f"WITH {rot_sql(ONE)}, {SUM_SQL}", "rp")
def rotation_summary(spark, d):
    return summarized(*rotation(spark, d))


LOOKBACKS = ((3, "lb3"), (5, "lb5"), (8, "lb8"))


@query("lookback_sensitivity", "WITH " + rot_sql(" UNION ALL ".join(f"SELECT '{v}' AS variant, trade_date, stronger FROM ({mom_sql(n)}) WHERE ma IS NOT NULL AND trade_date >= (SELECT min(trade_date) FROM ({mom_sql(8)}) WHERE ma IS NOT NULL)" for n, v in LOOKBACKS)) + f", {SUM_SQL}", "rp")
def lookback_sensitivity(spark, d):
    return summarized(*rotation(spark, d, LOOKBACKS))


@query("linear_cost_stress", f"""WITH {rot_sql(ONE)} SELECT variant, cost_bps, count(*) AS periods, round(sum(fee_cost * cost_bps / 25), 8) AS fee_sum, round(product(1 + gross_return - fee_cost * cost_bps / 25) - 1, 8) AS total_return FROM res, (VALUES (0.0::DOUBLE), (10.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE)) c(cost_bps) GROUP BY 1, 2""", "rp")
def linear_cost_stress(spark, d):
    return rounded(RO.linear_cost_stress(rotation(spark, d)[2], 25.0, [0, 10, 25, 50], BY), "fee_sum", "total_return", digits=8)


# --- style factors -------------------------------------------------------------------------

FUND = {"pb": "CAST(symbol % 13 - 1 AS DOUBLE) * 0.7::DOUBLE", "pe_ttm": "CAST(symbol % 37 - 4 AS DOUBLE)", "ps_ttm": "CAST(symbol % 11 AS DOUBLE) * 0.5::DOUBLE", "dv_ttm": "CAST(symbol % 5 AS DOUBLE)",
        "roe": "CASE WHEN symbol % 7 <> 0 THEN CAST(symbol % 19 AS DOUBLE) END", "debt_to_assets": "CAST(symbol % 83 AS DOUBLE)", "netprofit_yoy": "CASE WHEN symbol % 6 <> 0 THEN CAST(symbol % 41 - 20 AS DOUBLE) END",
        "or_yoy": "CASE WHEN symbol % 4 <> 0 THEN CAST(symbol % 29 - 10 AS DOUBLE) END", "earnings_stability": "-CAST(symbol % 9 AS DOUBLE)", "cash_quality": "CASE WHEN symbol % 3 <> 0 THEN CAST(symbol % 15 AS DOUBLE) / 10.0::DOUBLE END",
        "net_large_ratio": "CAST(symbol % 23 - 11 AS DOUBLE) / 100.0::DOUBLE", "top10_ratio": "CAST(symbol % 71 AS DOUBLE)", "institution_ratio": "CAST(symbol % 31 AS DOUBLE)"}
add_view("facts", ("daily",), "SELECT trade_date, symbol, close, total_mv, turnover_rate, " + ", ".join(f"{e} AS {c}" for c, e in FUND.items()) + " FROM daily")
add_view("raw_style", ("facts",), """
    WITH r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close / lag(close, 10) OVER w - 1 AS momentum FROM facts WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)), m AS (SELECT *, avg(ret) OVER (PARTITION BY trade_date) AS mkt FROM r)
    SELECT trade_date, symbol, ln(total_mv) AS size, CASE WHEN pb > 0 THEN 1 / pb END AS value, momentum, CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END AS earnings_yield, CASE WHEN count(ret) OVER a >= 5 THEN -stddev_samp(ret) OVER a END AS lowvol,
           (coalesce(netprofit_yoy, 0) + coalesce(or_yoy, 0)) / nullif((netprofit_yoy IS NOT NULL)::INT + (or_yoy IS NOT NULL)::INT, 0) AS growth, -debt_to_assets AS leverage, CASE WHEN count(ret) OVER b >= 10 THEN -covar_samp(ret, mkt) OVER b / var_samp(mkt) OVER b END AS beta, -turnover_rate AS liquidity,
           (coalesce(roe, 0) - debt_to_assets + earnings_stability + coalesce(cash_quality, 0)) / ((roe IS NOT NULL)::INT + 2 + (cash_quality IS NOT NULL)::INT) AS quality, net_large_ratio AS flow, top10_ratio AS chip, institution_ratio AS institution, dv_ttm AS dividend, CASE WHEN ps_ttm > 0 THEN 1 / ps_ttm END AS sales_yield
    FROM m WINDOW a AS (PARTITION BY symbol ORDER BY trade_date ROWS 9 PRECEDING), b AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING)""")


def raw_style(spark, d):
    b = staged(V.daily(spark, d).select(*KEYS, "close", "total_mv", "turnover_rate"))
    spark_sql = {c: e.replace("::DOUBLE", "D") for c, e in FUND.items()}
    f = b.select(*KEYS, "total_mv", "turnover_rate", *[F.expr(e).alias(c) for c, e in spark_sql.items()])
    basics = f.select(*KEYS, "total_mv", "turnover_rate", "pb", "pe_ttm", "ps_ttm", "dv_ttm")
    facts = f.drop("total_mv", "turnover_rate", "pb", "pe_ttm", "ps_ttm", "dv_ttm")
    return ST.raw_factors(b.select(*KEYS, "close"), basics, facts, 10, 10, 5, 20, 10)


@query("style_factor_panel", "SELECT trade_date, symbol, " + ", ".join(f"round({c}, 6) AS {c}" for c in ST.RAW) + " FROM raw_style", "raw_style")
def style_factor_panel(spark, d):
    return rounded(raw_style(spark, d), *ST.RAW)


@query("factor_specific_eligibility", "SELECT trade_date, symbol, value IS NULL AS value_void, earnings_yield IS NULL AS yield_void, sales_yield IS NULL AS sales_void, size IS NOT NULL AS size_known FROM raw_style", "raw_style")
def factor_specific_eligibility(spark, d):
    s = raw_style(spark, d)
    return s.select(*KEYS, F.col("value").isNull().alias("value_void"), F.col("earnings_yield").isNull().alias("yield_void"), F.col("sales_yield").isNull().alias("sales_void"), F.col("size").isNotNull().alias("size_known"))


@query("available_factors", " UNION ALL ".join(f"SELECT '{c}' AS factor, count({c}) AS \"values\" FROM raw_style HAVING count({c}) > 0" for c in ST.RAW), "raw_style")
def available_factors(spark, d):
    return ST.available_factors(raw_style(spark, d), [*ST.RAW, "absent"])


@query("earnings_stability", """
    WITH q AS (SELECT o_custkey AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS end_date, sum(o_totalprice) / 100000 AS roe FROM orders GROUP BY 1, 2)
    SELECT symbol, end_date, round(CASE WHEN count(roe) OVER w >= 4 THEN -stddev_samp(roe) OVER w END, 6) AS earnings_stability FROM q WINDOW w AS (PARTITION BY symbol ORDER BY end_date ROWS 7 PRECEDING)""")
def earnings_stability(spark, d):
    q = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("end_date")).agg((F.sum("o_totalprice") / 100000).alias("roe"))
    return rounded(ST.earnings_stability(q, "roe").select("symbol", "end_date", "earnings_stability"), "earnings_stability")


JOB_COVERAGE = {20: 5, 60: 15}  # a quarter of the sessions, as in turnover_lookback: events span thirty
JOB_LEGS = [(leg, k) for leg, kinds in ST.LEGS.items() for k in kinds]
JOB_COLS = ["formation_coverage", "mean_size_correlation", "mean_lowvol_correlation", "baseline_return_correlation", "monotonicity", "positive_year_ratio", *[f"{leg}_{k}" for leg, k in JOB_LEGS]]


def standard_sql(src: str) -> str:
    """Winsorised, industry-demeaned z-score ``z`` of ``value`` per (variant, trade_date)."""
    return f"""SELECT * EXCLUDE (x, e), (e - avg(e) OVER d) / nullif(stddev_samp(e) OVER d, 0) AS z FROM (SELECT *, x - avg(x) OVER (PARTITION BY variant, trade_date, industry) AS e FROM
        (SELECT s.*, CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END AS x FROM {src} s JOIN (SELECT variant, trade_date, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM {src} GROUP BY 1, 2) USING (variant, trade_date)))
        WINDOW d AS (PARTITION BY variant, trade_date)"""


def job_sql() -> str:
    from .reports import metrics_sql
    looks = ", ".join(f"CASE WHEN count(v) OVER w{n} >= {k} THEN avg(v) OVER w{n} END AS turnover_mean_{n}d, CASE WHEN count(v) OVER w{n} >= {k} THEN quantile_cont(v, 0.5) OVER w{n} END AS turnover_median_{n}d" for n, k in JOB_COVERAGE.items())
    frames = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY i RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in JOB_COVERAGE)
    quint = ", ".join(f"avg(g) FILTER (bucket = {i}) AS q{i + 1}" for i in range(5))
    rets = ", ".join(f"{c} / coalesce(lag({c}) OVER p, 1) - 1 AS {c}" for c in ("q1", "q2", "q3", "q4", "q5", "universe"))
    names = ["q1", "q2", "q3", "q4", "q5", "universe", "long", "short", "long_short", "long_excess"]
    return f"""WITH c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM daily)),
      tv AS (SELECT trade_date, symbol, i, least(greatest(turnover_rate, 0.01::DOUBLE), 100.0::DOUBLE) AS v FROM daily JOIN c USING (trade_date) WHERE turnover_rate IS NOT NULL),
      lb AS (SELECT trade_date, symbol, v AS turnover_1d, {looks} FROM tv WINDOW {frames}),
      pr AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r1 FROM daily WHERE amount > 0),
      vo AS (SELECT *, CASE WHEN count(r1) OVER w >= 10 THEN stddev_samp(r1) OVER w END AS vol FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
      cr AS (SELECT * FROM vo WHERE trade_date IN (SELECT trade_date FROM reb) AND total_mv > 0),
      cl AS (SELECT trade_date, symbol, industry, 'size' AS variant, ln(total_mv + 1) AS value FROM cr UNION ALL SELECT trade_date, symbol, industry, 'lowvol', -vol FROM cr), cz AS ({standard_sql('cl')}),
      ct AS (SELECT trade_date, symbol, industry, max(z) FILTER (variant = 'size') AS size_score, max(z) FILTER (variant = 'lowvol') AS lowvol_score FROM cz GROUP BY 1, 2, 3),
      l AS ({" UNION ALL ".join(f"SELECT ct.*, '{v}' AS variant, round(-{v}, 10) AS value FROM ct JOIN lb USING (trade_date, symbol)" for v in ST.DEFINITIONS)}), z AS ({standard_sql('l')}),
      m AS (SELECT variant, trade_date, count(*) AS n, avg(z) AS my, avg(size_score) AS ma, avg(lowvol_score) AS mb, covar_pop(size_score, size_score) AS caa, covar_pop(size_score, lowvol_score) AS cab, covar_pop(lowvol_score, lowvol_score) AS cbb, covar_pop(size_score, z) AS cay, covar_pop(lowvol_score, z) AS cby
        FROM z WHERE z IS NOT NULL AND size_score IS NOT NULL AND lowvol_score IS NOT NULL GROUP BY 1, 2),
      r AS (SELECT z.*, CASE WHEN n >= 30 THEN z - my - (cay * cbb - cby * cab) / nullif(caa * cbb - cab * cab, 0) * (size_score - ma) - (cby * caa - cay * cab) / nullif(caa * cbb - cab * cab, 0) * (lowvol_score - mb) END AS u FROM z LEFT JOIN m USING (variant, trade_date)),
      s AS (SELECT variant, false AS neutralized, trade_date, symbol, size_score, lowvol_score, round(z, 9) AS s FROM r UNION ALL SELECT variant || '_neutral', true, trade_date, symbol, size_score, lowvol_score, round((u - avg(u) OVER d) / nullif(stddev_samp(u) OVER d, 0), 9) FROM r WINDOW d AS (PARTITION BY variant, trade_date)),
      dg AS (SELECT variant, neutralized, CAST(sum(n) AS BIGINT) AS formation_observations, sum(n) / sum(k) AS formation_coverage, avg(a) FILTER (NOT isnan(a)) AS mean_size_correlation, avg(b) FILTER (NOT isnan(b)) AS mean_lowvol_correlation
        FROM (SELECT variant, neutralized, trade_date, count(s) AS n, count(*) AS k, corr(s, size_score) AS a, corr(s, lowvol_score) AS b FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
      q AS (SELECT s.*, c, e0, e1, (s > e1)::INT + (s > e2)::INT + (s > e3)::INT + (s > e4)::INT AS bucket FROM s JOIN (SELECT variant, trade_date, count(s) AS c, min(s) AS e0, quantile_cont(s, 0.2) AS e1, quantile_cont(s, 0.4) AS e2, quantile_cont(s, 0.6) AS e3, quantile_cont(s, 0.8) AS e4 FROM s GROUP BY 1, 2) USING (variant, trade_date) WHERE s IS NOT NULL),
      k AS (SELECT variant, trade_date AS formation_date, symbol, bucket FROM (SELECT *, count(DISTINCT bucket) OVER (PARTITION BY variant, trade_date) AS b FROM q) WHERE c >= 50 AND b = 5 AND e0 < e1),
      g AS (SELECT f.formation_date, f.symbol, w.trade_date, product(1 + coalesce(pct_chg, 0) / 100) OVER (PARTITION BY f.formation_date, f.symbol ORDER BY w.trade_date) AS g FROM (SELECT DISTINCT formation_date, symbol FROM k) f
        JOIN win w ON w.formation_date = f.formation_date LEFT JOIN daily d ON d.trade_date = w.trade_date AND d.symbol = f.symbol),
      v AS (SELECT variant, formation_date, g.trade_date, {quint}, avg(g) AS universe FROM k JOIN g USING (formation_date, symbol) GROUP BY 1, 2, 3), h AS (SELECT variant, trade_date, {rets} FROM v WINDOW p AS (PARTITION BY variant, formation_date ORDER BY trade_date)),
      x AS (SELECT variant, trade_date, unnest({names}) AS leg, unnest([q1, q2, q3, q4, q5, universe, q5, q1, q5 - q1, q5 - universe]) AS ret FROM h), y AS ({metrics_sql('x', 'variant, leg')}),
      o AS (SELECT variant, corr(i, rk) AS monotonicity, count(*) FILTER (a > p) AS improving_steps FROM (SELECT *, rank() OVER (PARTITION BY variant ORDER BY a) AS rk, lag(a) OVER (PARTITION BY variant ORDER BY i) AS p FROM (SELECT variant, CAST(leg[2:] AS INTEGER) AS i, geometric_annual_return AS a FROM y WHERE leg LIKE 'q_')) GROUP BY 1),
      yr AS (SELECT variant, avg((t > 0)::INT) AS positive_year_ratio FROM (SELECT variant, year(trade_date), product(1 + ret) - 1 AS t FROM x WHERE leg = 'long_short' GROUP BY 1, 2) GROUP BY 1),
      ba AS (SELECT a.variant, corr(a.ret, b.ret) AS baseline_return_correlation FROM x a JOIN x b ON b.trade_date = a.trade_date AND a.leg = 'long_short' AND b.leg = 'long_short' AND b.variant = 'turnover_1d' GROUP BY 1),
      wd AS (SELECT variant, max(days) FILTER (leg = 'long_short') AS days, {", ".join(f"max({ST.QUINTILE[kind]}) FILTER (leg = '{leg}') AS {leg}_{kind}" for leg, kind in JOB_LEGS)} FROM y GROUP BY 1)
      SELECT variant, neutralized, formation_observations, coalesce(days, 0) AS days, coalesce(improving_steps, 0) AS improving_steps, {", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in JOB_COLS)}
      FROM dg LEFT JOIN wd USING (variant) LEFT JOIN o USING (variant) LEFT JOIN yr USING (variant) LEFT JOIN ba USING (variant)"""


@query("liquidity_diagnostics_job", job_sql(), "daily reb win")
def liquidity_diagnostics_job(spark, d):
    b = staged(V.daily(spark, d).select(*KEYS, "industry", "close", "amount", "total_mv", "turnover_rate", (F.coalesce("pct_chg", F.lit(0.0)) / 100.0).alias("ret")))
    out = ST.diagnostics_job(b, staged(B.rebalance_every(b, 5)), 0.25)
    zero = [(r(c) + F.lit(0.0)).alias(c) for c in JOB_COLS]  # no negative zero: a neutral score's correlation is noise of either sign
    return out.select("variant", "neutralized", "formation_observations", "days", "improving_steps", *zero)


# --- style replica -------------------------------------------------------------------------

add_view("rep", ("panel_supplier", "industry_supplier"), """
    WITH r AS (SELECT p.*, industry, close / lag(close) OVER w - 1 AS ret, close / lag(close, 20) OVER w - 1 AS mom20, close / lag(close, 60) OVER w - 1 AS mom120, row_number() OVER w AS i FROM panel_supplier p LEFT JOIN industry_supplier USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
    m AS (SELECT *, avg(ret) OVER (PARTITION BY trade_date) AS mkt FROM r),
    b AS (SELECT *, covar_samp(ret, mkt) OVER a / var_samp(mkt) OVER a AS be, covar_samp(ret, mkt) OVER a AS cv, var_samp(ret) OVER a AS vr, stddev_samp(ret) OVER a AS sl, stddev_samp(ret) OVER s AS ss, avg(amount) OVER s AS am FROM m WINDOW a AS (PARTITION BY symbol ORDER BY trade_date ROWS 35 PRECEDING), s AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING))
    SELECT trade_date, symbol, industry, CASE WHEN i > 24 THEN sqrt(greatest(0, vr - be * cv)) END AS resvol, CASE WHEN i > 24 THEN be END AS beta, ln(close) AS size, ln(am) AS liquidity, mom20, mom120, avg(mom20) OVER (PARTITION BY trade_date, industry) AS industry_mom, CASE WHEN i > 24 THEN ss / sl END AS vol_convergence, i FROM b""")


def replica_factors(spark, d):
    p = V.panel_supplier(spark, d).select(*KEYS, "close", "amount").join(V.industry_supplier(spark, d), "symbol", "left")
    return RP.factors(staged(p), 24, 36, 60)


@query("style_replica_factors", "SELECT trade_date, symbol, industry, " + ", ".join(f"round({c}, 6) AS {c}" for c in RP.FACTORS) + " FROM rep", "rep")
def style_replica_factors(spark, d):
    return rounded(replica_factors(spark, d), *RP.FACTORS)


A_W, B_W = {"resvol": 2.0, "mom20": 1.0}, {"resvol": -2.0, "liquidity": 1.0}


def pr(c: str) -> str:
    return f"(rank() OVER (PARTITION BY trade_date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY trade_date)"


add_view("repscore", ("rep",), f"""
    SELECT trade_date, symbol, industry, i, (2 * coalesce(CASE WHEN resvol IS NOT NULL THEN pv END, 0.5) + coalesce(CASE WHEN mom20 IS NOT NULL THEN pm END, 0.5)) / 3.0::DOUBLE AS score_a,
           (2 * coalesce(CASE WHEN resvol IS NOT NULL THEN 1 - pv END, 0.5) + coalesce(CASE WHEN liquidity IS NOT NULL THEN pl END, 0.5)) / 3.0::DOUBLE AS score_b
    FROM (SELECT *, {pr('resvol')} AS pv, {pr('mom20')} AS pm, {pr('liquidity')} AS pl FROM rep)""")


def replica_scores(spark, d):
    f = staged(replica_factors(spark, d).select(*KEYS, "industry", *dict.fromkeys([*A_W, *B_W])))  # ranking moves every column it is given
    return RP.leg_score(RP.leg_score(f, A_W, "score_a"), B_W, "score_b").select(*KEYS, "industry", "score_a", "score_b")


@query("style_replica_scores", "SELECT trade_date, symbol, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b FROM repscore", "repscore")
def style_replica_scores(spark, d):
    return rounded(replica_scores(spark, d).drop("industry"), "score_a", "score_b")


@query("style_replica_universe", "SELECT trade_date, symbol FROM rep WHERE i >= 40 AND symbol % 17 <> 0", "rep")
def style_replica_universe(spark, d):
    p = V.panel_supplier(spark, d).select(*KEYS)
    inst = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_suppkey") % 17 == 0).alias("is_st"))
    return RP.universe(p, inst, 40)


QUOTAS = {"AFRICA": 6, "ASIA": 4}
POS_SQL = """t AS (SELECT trade_date, symbol, leg FROM (SELECT *, 'A' AS leg, row_number() OVER (PARTITION BY trade_date, industry ORDER BY score_a DESC, symbol) AS k FROM repscore WHERE industry IN ('AFRICA', 'ASIA')) WHERE k <= CASE industry WHEN 'AFRICA' THEN 6 ELSE 4 END
    UNION ALL SELECT trade_date, symbol, 'B' FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score_b DESC, symbol) AS k FROM repscore) WHERE k <= 10), pos AS (SELECT trade_date, symbol, string_agg(leg, '+' ORDER BY leg) AS leg, least(count(*) * 0.01::DOUBLE, 0.02::DOUBLE) AS weight FROM t GROUP BY 1, 2)"""


def replica_positions(spark, d):
    s = replica_scores(spark, d).withColumnRenamed("industry", "theme").withColumns({"score_a": r("score_a", 12), "score_b": r("score_b", 12)})
    return RP.positions(staged(s), QUOTAS, 10)


POS_SQL = POS_SQL.replace("score_a DESC", "round(score_a, 12) DESC").replace("score_b DESC", "round(score_b, 12) DESC")


@query("style_replica_positions", f"WITH {POS_SQL} SELECT trade_date, symbol, leg, round(weight, 6) AS weight FROM pos", "repscore")
def style_replica_positions(spark, d):
    return rounded(replica_positions(spark, d), "weight")


@query("position_changes", f"""WITH {POS_SQL}, c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM pos)), p AS (SELECT pos.*, i FROM pos JOIN c USING (trade_date)),
    j AS (SELECT coalesce(a.i, b.i + 1) AS i, coalesce(a.symbol, b.symbol) AS symbol, b.weight AS weight_before, a.weight AS weight_now FROM p a FULL JOIN p b ON b.symbol = a.symbol AND b.i = a.i - 1)
    SELECT trade_date, symbol, CASE WHEN weight_before IS NULL THEN 'new' WHEN weight_now IS NULL THEN 'exit' ELSE 'stay' END AS action, round(weight_before, 6) AS weight_before, round(weight_now, 6) AS weight_now FROM j JOIN c USING (i) WHERE i > 1""", "repscore")
def position_changes(spark, d):
    return rounded(RP.position_changes(staged(replica_positions(spark, d))), "weight_before", "weight_now")


@query("position_exposure", f"""WITH {POS_SQL} SELECT trade_date, count(*) AS total_stocks, count(*) FILTER (leg LIKE '%A%') AS a_leg_count, count(*) FILTER (leg LIKE '%B%') AS b_leg_count, count(*) FILTER (leg = 'A+B') AS overlap_count, round(sum(weight), 6) AS total_weight FROM pos GROUP BY 1""", "repscore")
def position_exposure(spark, d):
    return rounded(RP.exposure(replica_positions(spark, d)), "total_weight")


@query("theme_lookup", """
    SELECT p_partkey AS symbol, CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_type = 'ECONOMY' THEN 'economy' WHEN contains(p_type, 'STAN') THEN 'standard' WHEN p_brand = 'PROMO' THEN 'promo' WHEN p_brand = 'ECONOMY' THEN 'economy' END AS theme FROM part""")
def theme_lookup(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_type").alias("industry"), F.col("p_brand").alias("tag"))
    return RP.theme_lookup(p, {"PROMO": "promo", "ECONOMY": "economy"}, {"STAN": "standard"}).select("symbol", "theme")
