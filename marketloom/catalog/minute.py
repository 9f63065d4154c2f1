"""Minute-path queries on six-hour bars (four slots make a session)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as V
from ..fixtures import add_view
from ..operators import execution as E
from ..operators import minute as M
from ..session import staged
from .execution import signals
from .registry import query, rounded

GRID = M.Session(blocks=((0, 4),), step=360)
TERMS = M.Terms(entry_slot=1, take_profit=0.02, opening_bars=2)
TOP = 20
CAND = ["signal_date", "entry_date", "symbol", "limit_band", "execution_eligible", "entry_limit_available", "blocked_limit_up_open",
        "blocked_not_next_session", "exec_next_up_limit", "exec_next_down_limit", "exec_next_open", "exec_next_high", "exec_next_close"]


def parts(spark, d):
    s = staged(signals(spark, d).where("entry_date is not null").withColumnRenamed("trade_date", "signal_date").select(*CAND, "pred"))
    return s, staged(V.intraday(spark, d))


def picks(s):
    return E.top_rows(s, "pred", TOP, ["signal_date"]).select(*CAND)


def trades(spark, d, terms=TERMS):
    s, bars = parts(spark, d)
    return s, bars, M.daily_ohlc_diagnostic(M.audit(picks(s), bars, GRID, terms, "sparse_session"), terms)


add_view("sessions_min", ("intraday",), """
    SELECT symbol, trade_date, count(*) AS bar_count, count(*) = 4 AS full_session, count(*) >= 2 AND max(entry) IS NOT NULL AND max(close) FILTER (slot = 3) IS NOT NULL AS sparse_session,
           bool_and(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high)) AS valid, max(entry) AS entry_reference,
           max(amount) FILTER (slot = 1) AS entry_bar_amount, max(close) FILTER (slot = 3) AS close_reference, arg_max(close, slot) FILTER (slot > 1) AS path_close, max(high) FILTER (slot > 1) AS path_high,
           min(trade_time) FILTER (slot > 1 AND high > entry * (1 + 0.02::DOUBLE)) AS cross_time, min(trade_time) FILTER (slot > 1 AND high >= entry * (1 + 0.02::DOUBLE)) AS touch_time,
           max(trade_time) FILTER (slot = 3) AS close_time, sum(amount) FILTER (rn <= 2) AS opening_amount
    FROM (SELECT *, max(close) FILTER (slot = 1) OVER (PARTITION BY symbol, trade_date) AS entry, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY trade_time) AS rn
          FROM (SELECT *, CAST(hour(trade_time) // 6 AS INTEGER) AS slot FROM intraday)) GROUP BY 1, 2""")
PATH_COLS = """CASE WHEN nup > 0 AND nup / entry_reference BETWEEN 0.5 AND 1.5 THEN nup END AS up, CASE WHEN ndown > 0 AND ndown / entry_reference BETWEEN 0.5 AND 1.5 THEN ndown END AS down"""
NET = "({x} * (1 - 5.0::DOUBLE / 10000)) / ({e} * (1 + 5.0::DOUBLE / 10000)) - 1 - 20.0::DOUBLE / 10000"
add_view("picks", ("signals",), "SELECT * EXCLUDE (trade_date), trade_date AS signal_date FROM signals WHERE entry_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY pred DESC, symbol) <= 20")
add_view("audit", ("picks", "sessions_min"), f"""
    SELECT *, CASE WHEN NOT execution_eligible THEN 'signal_unfilled' WHEN bar_count IS NULL THEN 'minute_missing' WHEN NOT sparse_session THEN 'minute_incomplete' WHEN NOT valid THEN 'minute_invalid'
           WHEN up IS NULL OR coalesce(entry_reference >= up * 0.999::DOUBLE, false) OR NOT coalesce(entry_bar_amount > 0, false) THEN 'minute_entry_blocked' ELSE 'audited' END AS status,
           CASE WHEN cross_time IS NOT NULL THEN entry_reference * (1 + 0.02::DOUBLE) ELSE close_reference END AS xref,
           CASE WHEN nhigh > nopen * (1 + 0.02::DOUBLE) THEN nopen * (1 + 0.02::DOUBLE) ELSE nclose END AS dx
    FROM (SELECT p.*, bar_count, sparse_session, valid, entry_reference, entry_bar_amount, close_reference, cross_time, touch_time, close_time, opening_amount, {PATH_COLS}
          FROM picks p LEFT JOIN sessions_min m ON m.symbol = p.symbol AND m.trade_date = p.entry_date AND p.execution_eligible)""")
add_view("mtrades", ("audit",), f"""
    SELECT *, CASE WHEN status = 'audited' THEN xref / entry_reference - 1 END AS gross_return, CASE WHEN status = 'audited' THEN {NET.format(x='xref', e='entry_reference')} END AS net_return,
           {NET.format(x='dx', e='nopen')} AS daily_net,
           CASE status WHEN 'signal_unfilled' THEN CASE WHEN entry_limit_available AND NOT blocked_limit_up_open AND same_next_session THEN 'other_daily_entry_gate' ELSE
                concat_ws(',', CASE WHEN NOT entry_limit_available THEN 'daily_missing_or_invalid_open_limit' END, CASE WHEN blocked_limit_up_open THEN 'daily_open_at_limit_up' END, CASE WHEN NOT same_next_session THEN 'not_next_market_session' END) END
             WHEN 'minute_entry_blocked' THEN concat_ws(',', CASE WHEN up IS NULL THEN 'missing_or_invalid_up_limit' END, CASE WHEN coalesce(entry_reference >= up * 0.999::DOUBLE, false) THEN 'limit_up_at_entry' END,
                CASE WHEN NOT coalesce(entry_bar_amount > 0, false) THEN 'nonpositive_entry_amount' END) END AS reasons FROM audit""")
add_view("mdetail", ("signals", "sessions_min"), f"""
    SELECT *, CASE WHEN allowed THEN x / entry_reference - 1 END AS gross_return, CASE WHEN allowed THEN {NET.format(x='x', e='entry_reference')} END AS net_return, allowed AND NOT hit AS close_exit
    FROM (SELECT *, up IS NOT NULL AND entry_bar_amount > 0 AND NOT coalesce(entry_reference >= up * 0.999::DOUBLE, false) AS allowed, cross_time IS NOT NULL AS hit,
                 CASE WHEN cross_time IS NOT NULL THEN entry_reference * (1 + 0.02::DOUBLE) ELSE path_close END AS x
          FROM (SELECT s.trade_date AS signal_date, entry_date, s.symbol, limit_band, entry_reference, entry_bar_amount, cross_time, path_close, {PATH_COLS} FROM signals s
                JOIN sessions_min m ON m.symbol = s.symbol AND m.trade_date = s.entry_date WHERE execution_eligible AND valid AND sparse_session AND path_close IS NOT NULL))""")
add_view("mbench", ("signals", "mdetail"), """
    SELECT s.trade_date AS signal_date, s.entry_date, CASE WHEN grouping(s.limit_band) = 0 THEN s.limit_band END AS limit_band, count(*) AS slots, count(*) FILTER (execution_eligible) AS executable,
           count(*) FILTER (allowed) AS audited, coalesce(sum(gross_return), 0.0) AS gross_return_sum, coalesce(sum(net_return), 0.0) AS net_return_sum, count(*) FILTER (execution_eligible AND d.symbol IS NULL) AS missing_or_incomplete,
           count(*) FILTER (d.symbol IS NOT NULL AND up IS NULL) AS limit_unavailable, count(*) FILTER (d.symbol IS NOT NULL AND NOT entry_bar_amount > 0) AS nonpositive_amount,
           count(*) FILTER (entry_reference >= up * 0.999::DOUBLE) AS blocked_limit_up, count(*) FILTER (close_exit) AS close_exits, count(*) FILTER (allowed AND hit) AS target_fills,
           coalesce(sum(net_return), 0.0) / count(*) AS benchmark_return, coalesce(sum(net_return) / nullif(count(*) FILTER (allowed), 0), 0.0) AS executed_mean_return, 1 - count(*) FILTER (allowed) / count(*) AS cash_weight
    FROM signals s LEFT JOIN mdetail d ON d.signal_date = s.trade_date AND d.symbol = s.symbol WHERE s.entry_date IS NOT NULL GROUP BY GROUPING SETS ((s.trade_date, s.entry_date), (s.trade_date, s.entry_date, s.limit_band))""")


@query("minute_session_completeness", "SELECT symbol, trade_date, bar_count, full_session, sparse_session FROM sessions_min", "sessions_min")
def minute_session_completeness(spark, d):
    return M.session_summary(V.intraday(spark, d), GRID, TERMS).select("symbol", "trade_date", "bar_count", "full_session", "sparse_session")


@query("minute_bar_validity", "SELECT symbol, trade_date, valid FROM sessions_min", "sessions_min")
def minute_bar_validity(spark, d):
    return M.session_summary(V.intraday(spark, d), GRID, TERMS).select("symbol", "trade_date", "valid")


@query("minute_path_exit", """
    SELECT signal_date, entry_date, symbol, round(entry_reference, 6) AS entry_reference, round(xref, 6) AS exit_reference, CASE WHEN cross_time IS NOT NULL THEN 'take_profit_cross' ELSE 'close' END AS exit_reason,
           coalesce(cross_time, close_time) AS exit_time, round(gross_return, 8) AS gross_return, round(net_return, 8) AS net_return, round(opening_amount * 0.05::DOUBLE, 4) AS opening_capacity_cny,
           cross_time IS NULL AND down IS NOT NULL AND xref <= down * 1.001::DOUBLE AS close_exit_at_down_limit FROM mtrades WHERE status = 'audited'""", "mtrades")
def minute_path_exit(spark, d):
    t = trades(spark, d)[2].where("status = 'audited'").select("signal_date", "entry_date", "symbol", "entry_reference", "exit_reference", "exit_reason", "exit_time",
                                                              "gross_return", "net_return", "opening_capacity_cny", "close_exit_at_down_limit")
    return rounded(rounded(rounded(t, "gross_return", "net_return", digits=8), "entry_reference", "exit_reference"), "opening_capacity_cny", digits=4)


@query("minute_audit_status", "SELECT signal_date, symbol, status, reasons FROM mtrades", "mtrades")
def minute_audit_status(spark, d):
    return trades(spark, d)[2].select("signal_date", "symbol", "status", "reasons")


@query("daily_ohlc_diagnostic", "SELECT signal_date, symbol, nhigh > nopen * (1 + 0.02::DOUBLE) AS daily_ohlc_target_hit, round(daily_net, 8) AS daily_ohlc_net_return FROM mtrades WHERE status = 'audited'", "mtrades")
def daily_ohlc_diagnostic(spark, d):
    t = trades(spark, d)[2].where("status = 'audited'").select("signal_date", "symbol", "daily_ohlc_target_hit", "daily_ohlc_net_return")
    return rounded(t, "daily_ohlc_net_return", digits=8)


@query("minute_benchmark_detail", """
    SELECT signal_date, symbol, round(entry_reference, 6) AS entry_reference, allowed AS entry_allowed, round(gross_return, 8) AS gross_return, round(net_return, 8) AS net_return, close_exit FROM mdetail""", "mdetail")
def minute_benchmark_detail(spark, d):
    s, bars = parts(spark, d)
    t = M.benchmark_detail(s, bars, GRID, TERMS, "sparse_session").select("signal_date", "symbol", "entry_reference", "entry_allowed", "gross_return", "net_return", "close_exit")
    return rounded(rounded(t, "gross_return", "net_return", digits=8), "entry_reference")


def bench(s, bars):
    return M.benchmark_daily(s, M.benchmark_detail(s, bars, GRID, TERMS, "sparse_session"))


FLOATS = ["gross_return_sum", "net_return_sum", "benchmark_return", "executed_mean_return", "cash_weight"]


@query("minute_benchmark_daily", "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in FLOATS) + ") FROM mbench", "mbench")
def minute_benchmark_daily(spark, d):
    return rounded(bench(*parts(spark, d)), *FLOATS)


@query("decomposition_check", "SELECT m AS measure, 0.0::DOUBLE AS gap, true AS passed FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in M.SUMS) + "]) AS m)")
def decomposition_check(spark, d):
    out = M.decomposition_gaps(staged(bench(*parts(spark, d))))
    return rounded(out, "gap")


MDAILY = """SELECT signal_date, entry_date, count(*) FILTER (status = 'audited') AS audited, coalesce(sum(net_return), 0) / 20 AS portfolio_return,
    avg(CASE WHEN status = 'audited' THEN (cross_time IS NOT NULL)::INT END) AS target_cross_rate, 1 - count(*) FILTER (status = 'audited') / 20 AS cash_weight,
    coalesce(sum(net_return - daily_net), 0) / 20 AS minute_minus_daily FROM mtrades GROUP BY 1, 2"""


@query("minute_daily_returns", f"""
    SELECT signal_date, entry_date, audited, round(portfolio_return, 8) AS portfolio_return, round(target_cross_rate, 6) AS target_cross_rate, round(cash_weight, 6) AS cash_weight,
           round(minute_minus_daily, 8) AS minute_minus_daily FROM ({MDAILY})""", "mtrades")
def minute_daily_returns(spark, d):
    out = M.daily_returns(trades(spark, d)[2], TOP)
    return rounded(rounded(out, "portfolio_return", "minute_minus_daily", digits=8), "target_cross_rate", "cash_weight")


@query("attach_band_matched_benchmark", f"""
    WITH s AS (SELECT signal_date, entry_date, limit_band, count(*) AS n FROM mtrades WHERE status = 'audited' GROUP BY 1, 2, 3),
    m AS (SELECT b.signal_date, b.entry_date, sum(executed_mean_return * coalesce(n, 0) / 20) AS r, sum(coalesce(n, 0) / 20) AS w FROM mbench b LEFT JOIN s USING (signal_date, entry_date, limit_band) WHERE limit_band IS NOT NULL GROUP BY 1, 2)
    SELECT signal_date, round(portfolio_return, 8) AS portfolio_return, round(r, 8) AS band_matched_return, round(w, 6) AS band_matched_weight, round(portfolio_return - r, 8) AS within_band_active FROM ({MDAILY}) JOIN m USING (signal_date, entry_date)""",
       "mtrades mbench")
def attach_band_matched_benchmark(spark, d):
    s, bars, t = trades(spark, d)
    t = staged(t)
    out = M.attach_band_matched(M.daily_returns(t, TOP), t, bench(s, bars), TOP)
    out = out.select("signal_date", "portfolio_return", "band_matched_return", "band_matched_weight", "within_band_active")
    return rounded(rounded(out, "portfolio_return", "band_matched_return", "within_band_active", digits=8), "band_matched_weight")


@query("limit_band_exposure", """
    WITH s AS (SELECT limit_band, count(*) AS n FROM mtrades WHERE status = 'audited' GROUP BY 1), b AS (SELECT limit_band, sum(audited) AS n FROM mbench WHERE limit_band IS NOT NULL GROUP BY 1)
    SELECT limit_band, CAST(coalesce(s.n, 0) AS BIGINT) AS selected, CAST(coalesce(b.n, 0) AS BIGINT) AS benchmark, round(coalesce(s.n, 0) / sum(coalesce(s.n, 0)) OVER (), 6) AS selected_share,
           round(coalesce(b.n, 0) / sum(coalesce(b.n, 0)) OVER (), 6) AS benchmark_share FROM b FULL JOIN s USING (limit_band)""", "mtrades mbench")
def limit_band_exposure(spark, d):
    s, bars, t = trades(spark, d)
    return rounded(M.limit_band_exposure(t, bench(s, bars)), "selected_share", "benchmark_share")


MSTRESS = ["selected_mean", "selected_sharpe", "selected_total", "benchmark_mean", "band_matched_mean", "active_mean", "active_sharpe"]


@query("minute_cost_stress", """
    WITH g AS (SELECT signal_date, entry_date, count(*) FILTER (status = 'audited') AS n, coalesce(sum(gross_return), 0) AS g FROM mtrades GROUP BY 1, 2),
    k AS (SELECT signal_date, entry_date, limit_band, count(*) AS k FROM mtrades WHERE status = 'audited' GROUP BY 1, 2, 3),
    m AS (SELECT b.signal_date, sum(k * coalesce(gross_return_sum / nullif(audited, 0), 0)) AS mg, sum(CASE WHEN audited > 0 THEN k ELSE 0 END) AS mk FROM mbench b JOIN k USING (signal_date, entry_date, limit_band) GROUP BY 1),
    d AS (SELECT drag_bps, (g - drag_bps / 10000 * n) / 20 AS s, (gross_return_sum - drag_bps / 10000 * b.audited) / slots AS b, (coalesce(mg, 0) - drag_bps / 10000 * coalesce(mk, 0)) / 20 AS m
          FROM g JOIN mbench b ON b.signal_date = g.signal_date AND b.limit_band IS NULL LEFT JOIN m ON m.signal_date = g.signal_date, (VALUES (0.0::DOUBLE), (20.0::DOUBLE), (50.0::DOUBLE)) v(drag_bps))
    SELECT drag_bps, count(*) AS days, round(avg(s), 6) AS selected_mean, round(avg(s) / nullif(stddev_pop(s), 0) * sqrt(252.0::DOUBLE), 6) AS selected_sharpe, round(product(1 + s) - 1, 6) AS selected_total,
           round(avg(b), 6) AS benchmark_mean, round(avg(m), 6) AS band_matched_mean, round(avg(s - m), 6) AS active_mean, round(avg(s - m) / nullif(stddev_pop(s - m), 0) * sqrt(252.0::DOUBLE), 6) AS active_sharpe FROM d GROUP BY 1""", "mtrades mbench")
def minute_cost_stress(spark, d):
    s, bars, t = trades(spark, d)
    return rounded(M.cost_stress(staged(t), staged(bench(s, bars)), TOP, [0, 20, 50]), *MSTRESS)


@query("execution_diagnostics", """
    WITH t AS (SELECT *, status IN ('audited', 'minute_entry_blocked') AS a FROM mtrades)
    SELECT count(*) AS candidate_rows, count(*) FILTER (NOT entry_limit_available) AS daily_limit_unavailable_rows, count(*) FILTER (blocked_limit_up_open) AS daily_limit_up_rows, count(*) FILTER (status = 'signal_unfilled') AS signal_unfilled_rows,
           count(*) FILTER (a) AS entry_rows, count(*) FILTER (a AND up IS NOT NULL) AS entry_limit_available_rows, count(*) FILTER (a AND entry_reference >= up * 0.999::DOUBLE) AS entry_limit_up_rows,
           count(*) FILTER (status = 'minute_entry_blocked') AS entry_blocked_rows, count(*) FILTER (status = 'audited') AS audited_rows, count(*) FILTER (status = 'audited' AND cross_time IS NULL) AS close_exit_rows,
           count(*) FILTER (status = 'audited' AND cross_time IS NULL AND xref <= down * 1.001::DOUBLE) AS close_at_down_limit_rows, count(*) FILTER (status = 'audited' AND cross_time IS NOT NULL) AS target_fill_rows,
           round(count(*) FILTER (status = 'signal_unfilled') / count(*), 6) AS signal_unfilled_rate, round(count(*) FILTER (status = 'minute_entry_blocked') / nullif(count(*) FILTER (a), 0), 6) AS entry_blocked_rate,
           round(count(*) FILTER (status = 'audited' AND cross_time IS NOT NULL) / nullif(count(*) FILTER (status = 'audited'), 0), 6) AS target_fill_rate FROM t""", "mtrades")
def execution_diagnostics(spark, d):
    return rounded(M.diagnostics(trades(spark, d)[2]), "signal_unfilled_rate", "entry_blocked_rate", "target_fill_rate")


@query("unfilled_reasons", "SELECT status, reasons, count(*) AS rows FROM mtrades WHERE reasons IS NOT NULL GROUP BY 1, 2", "mtrades")
def unfilled_reasons(spark, d):
    return M.reason_counts(trades(spark, d)[2])
