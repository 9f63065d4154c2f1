"""Next-session signal, execution and benchmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as V
from ..fixtures import add_view
from ..functions import expr as X
from ..functions.stats import newey_west
from ..operators import calendar as C
from ..operators import execution as E
from ..session import staged
from .registry import query, r, rounded

KEYS = ["trade_date", "symbol"]
TPS = [0.01, 0.03, None]
POLICIES = [X.policy_name(p) for p in TPS]
TOPS = [5, 10]
COSTS = dict(entry_bps=5.0, exit_bps=5.0, cost_bps=20.0, participation=0.1)

add_view("exec_panel", ("daily",), """
    SELECT *, coalesce(NOT (ok_limit AND nopen >= nup * 0.999::DOUBLE) AND ok_limit AND observable, false) AS execution_eligible,
           ok_limit AS entry_limit_available, coalesce(ok_limit AND nopen >= nup * 0.999::DOUBLE, false) AS blocked_limit_up_open,
           coalesce(next_high > 0 AND next_close > 0 AND namount > 0, false) AS outcome_available, namount * 1000.0::DOUBLE AS next_amount_cny,
           next_high / entry_price - 1.0::DOUBLE AS open_to_high, next_close / entry_price - 1.0::DOUBLE AS open_to_close
    FROM (SELECT *, coalesce(nopen > 0 AND nup > 0 AND nup / nopen BETWEEN 0.5 AND 1.5, false) AS ok_limit,
                 coalesce(ndate = entry_date, false) AS same_next_session,
                 coalesce(entry_date IS NOT NULL AND ndate = entry_date AND entry_price > 0 AND nopen > 0 AND NOT coalesce(nsusp, false) AND NOT coalesce(nst, false), false) AS observable
          FROM (SELECT a.*, m.nd AS entry_date, lead(trade_date) OVER w AS ndate, lead(open) OVER w AS nopen, lead(high) OVER w AS nhigh, lead(close) OVER w AS nclose,
                       lead(up_limit) OVER w AS nup, lead(down_limit) OVER w AS ndown, lead(amount) OVER w AS namount, lead(is_suspended) OVER w AS nsusp,
                       lead(is_st) OVER w AS nst, lead(open * adj_factor) OVER w AS entry_price,
                       lead(high * adj_factor) OVER w AS next_high, lead(close * adj_factor) OVER w AS next_close
                FROM daily a JOIN (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nd FROM (SELECT DISTINCT trade_date FROM daily)) m USING (trade_date)
                WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)))""")
add_view("signals", ("exec_panel",), """
    SELECT *, execution_eligible AND outcome_available AS evaluation_eligible,
           CASE WHEN pre_close > 0 AND abs((up_limit / pre_close - 1) * 100 - 5) <= 1 THEN '05pct'
                WHEN pre_close > 0 AND abs((up_limit / pre_close - 1) * 100 - 10) <= 1 THEN '10pct'
                WHEN pre_close > 0 AND abs((up_limit / pre_close - 1) * 100 - 20) <= 1 THEN '20pct'
                WHEN pre_close > 0 AND abs((up_limit / pre_close - 1) * 100 - 30) <= 1 THEN '30pct' ELSE 'unknown' END AS limit_band
    FROM exec_panel WHERE amount > 0 AND total_mv > 0 AND turnover_rate > 0 AND NOT is_suspended AND NOT is_st AND listed_days >= 60""")
add_view("selected", ("signals",), """
    SELECT s.*, trade_date AS signal_date, top_k FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY pred DESC, symbol) AS raw_rank FROM signals) s,
    (VALUES (5), (10)) k(top_k) WHERE raw_rank <= top_k""")
add_view("candidate_days", ("selected",), """
    SELECT d.signal_date, d.top_k, entry_date, raw_candidates, filled, max_raw_rank_used, blocked_limit_up_open_raw, filled / top_k AS fill_rate,
           CASE WHEN lag(filled) OVER w > 0 THEN 1 - coalesce(kept, 0) / top_k ELSE 1.0::DOUBLE END AS selection_turnover
    FROM (SELECT signal_date, top_k, min(entry_date) AS entry_date, count(*) AS raw_candidates, count(*) FILTER (execution_eligible) AS filled,
                 max(raw_rank) FILTER (execution_eligible) AS max_raw_rank_used, count(*) FILTER (blocked_limit_up_open) AS blocked_limit_up_open_raw
          FROM selected GROUP BY 1, 2) d
    LEFT JOIN (SELECT a.signal_date, a.top_k, count(*) AS kept FROM selected a JOIN selected b ON a.symbol = b.symbol AND a.top_k = b.top_k
               JOIN (SELECT trade_date AS t, lag(trade_date) OVER (ORDER BY trade_date) AS p FROM (SELECT DISTINCT trade_date FROM signals)) c
                    ON c.t = a.signal_date AND c.p = b.signal_date
               WHERE a.execution_eligible AND b.execution_eligible GROUP BY 1, 2) k USING (signal_date, top_k) WINDOW w AS (PARTITION BY top_k ORDER BY d.signal_date)""")


def trades_sql(src: str) -> str:
    return f"""SELECT *, exit_price / entry_price - 1 AS gross_return,
        exit_price * (1 - 5.0::DOUBLE / 10000) / (entry_price * (1 + 5.0::DOUBLE / 10000)) - 1 - 20.0::DOUBLE / 10000 AS net_return, next_amount_cny * 0.1::DOUBLE AS capacity_cny
      FROM (SELECT s.*, exit_policy, next_high > entry_price * (1 + tp) AS hit_take_profit,
                   CASE WHEN next_high > entry_price * (1 + tp) THEN entry_price * (1 + tp) ELSE next_close END AS exit_price
            FROM {src} s, (VALUES ('tp_1p00%', 0.01::DOUBLE), ('tp_3p00%', 0.03::DOUBLE), ('close', 'inf'::DOUBLE)) p(exit_policy, tp) WHERE evaluation_eligible)"""


add_view("trades", ("selected",), trades_sql("selected"))
add_view("bench", ("signals",), f"""
    SELECT s.signal_date, p.exit_policy, benchmark_slots, coalesce(benchmark_executed, 0) AS benchmark_executed, coalesce(g, 0.0) AS benchmark_gross_return_sum,
           coalesce(n, 0.0) AS benchmark_return_sum, coalesce(n, 0.0) / benchmark_slots AS benchmark_return,
           coalesce(benchmark_executed, 0) / benchmark_slots AS benchmark_invested_weight, coalesce(n / nullif(benchmark_executed, 0), 0.0) AS benchmark_executed_mean_return
    FROM (SELECT trade_date AS signal_date, count(*) AS benchmark_slots FROM signals GROUP BY 1) s CROSS JOIN (VALUES ('tp_1p00%'), ('tp_3p00%'), ('close')) p(exit_policy)
    LEFT JOIN (SELECT trade_date AS signal_date, exit_policy, count(*) AS benchmark_executed, sum(gross_return) AS g, sum(net_return) AS n
               FROM ({trades_sql('signals')}) GROUP BY 1, 2) t ON t.signal_date = s.signal_date AND t.exit_policy = p.exit_policy""")
add_view("book", ("trades", "candidate_days", "bench"), """
    SELECT c.signal_date, c.entry_date, c.top_k, p.exit_policy, fill_rate, selection_turnover, coalesce(f, 0) AS filled, hit_rate AS hit_take_profit_rate, cap,
           coalesce(n, 0.0) * coalesce(f, 0) / c.top_k AS portfolio_return, coalesce(g, 0.0) * coalesce(f, 0) / c.top_k AS gross_portfolio_return,
           1 - coalesce(f, 0) / c.top_k AS cash_weight, b.benchmark_return, b.benchmark_executed_mean_return * coalesce(f, 0) / c.top_k AS matched,
           coalesce(n, 0.0) * coalesce(f, 0) / c.top_k - b.benchmark_executed_mean_return * coalesce(f, 0) / c.top_k AS active_return
    FROM candidate_days c CROSS JOIN (VALUES ('tp_1p00%'), ('tp_3p00%'), ('close')) p(exit_policy)
    LEFT JOIN (SELECT signal_date, top_k, exit_policy, count(*) AS f, avg(net_return) AS n, avg(gross_return) AS g, avg(hit_take_profit::INT) AS hit_rate, sum(capacity_cny) AS cap
               FROM trades GROUP BY 1, 2, 3) t ON t.signal_date = c.signal_date AND t.top_k = c.top_k AND t.exit_policy = p.exit_policy
    JOIN bench b ON b.signal_date = c.signal_date AND b.exit_policy = p.exit_policy""")


def hac_sql(src: str, by: str, order: str, v: str, name: str = "hac_t") -> str:
    """Newey-West t with five Bartlett lags."""
    lags = ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, 6))
    terms = " + ".join(f"2.0 * (1 - {k} / 6.0::DOUBLE) * coalesce(sum(c * c{k}), 0) / count(*)" for k in range(1, 6))
    return f"""SELECT {by}, CASE WHEN count(*) >= 2 AND (sum(c * c) / count(*) + {terms}) > 0
        THEN avg(v) / sqrt((sum(c * c) / count(*) + {terms}) / count(*)) END AS {name}
      FROM (SELECT *, {lags} FROM (SELECT {by}, {order} AS o, {v} AS v, {v} - avg({v}) OVER (PARTITION BY {by}) AS c FROM {src} WHERE {v} IS NOT NULL)
            WINDOW w AS (PARTITION BY {by} ORDER BY o)) GROUP BY {by}"""


def exec_panel(spark, d):
    b = V.daily(spark, d).withColumns({f"adj_{c}": F.col(c) * F.col("adj_factor") for c in ("open", "high", "close")})
    lead = {"trade_date": "exec_next_trade_date", "open": "exec_next_open", "high": "exec_next_high", "close": "exec_next_close",
            "up_limit": "exec_next_up_limit", "down_limit": "exec_next_down_limit", "amount": "exec_next_amount",
            "is_suspended": "exec_next_is_suspended", "is_st": "exec_next_is_st", "adj_open": "next_adj_open",
            "adj_high": "next_adj_high", "adj_close": "next_adj_close"}
    b = E.lead_columns(b, lead)
    return E.execution_fields(E.with_market_next_date(b, C.sessions(V.table(spark, d, "events").select(F.to_date("ts").alias("trade_date")))))


def signals(spark, d):
    s = E.filter_signal_rows(exec_panel(spark, d))
    return s.withColumn("limit_band", X.limit_band("pre_close", "up_limit"))


def book_parts(spark, d):
    """Staged signal panel, top-K selection, candidate days and trades."""
    s = staged(signals(spark, d))
    sel = E.frozen_candidates(s, "pred", TOPS)
    days = E.candidate_days(sel, C.sessions(s))
    trades = E.exit_policies(sel.where("evaluation_eligible"), TPS, **COSTS)
    return s, sel, days, trades


def benchmark(s):
    u = s.withColumnRenamed("trade_date", "signal_date")
    return E.universe_benchmark(u, E.exit_policies(u.where("evaluation_eligible"), TPS, **COSTS), POLICIES)


def book(spark, d):
    s, _, days, trades = book_parts(spark, d)
    return E.attach_benchmark(E.daily_portfolio_returns(trades, days, POLICIES), benchmark(s))


@query("execution_fields", """
    SELECT trade_date, symbol, entry_date, same_next_session, entry_limit_available, blocked_limit_up_open, execution_eligible, outcome_available,
           round(open_to_high, 6) AS open_to_high, round(open_to_close, 6) AS open_to_close FROM exec_panel""", "exec_panel")
def execution_fields(spark, d):
    return rounded(exec_panel(spark, d).select(
        *KEYS, "entry_date", "same_next_session", "entry_limit_available", "blocked_limit_up_open", "execution_eligible",
        "outcome_available", "open_to_high", "open_to_close"), "open_to_high", "open_to_close")


@query("lead_next_row", """
    SELECT trade_date, symbol, lead(trade_date) OVER w AS exec_next_trade_date, round(lead(open) OVER w, 6) AS exec_next_open,
           lead(is_suspended) OVER w AS exec_next_is_suspended FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)""", "daily")
def lead_next_row(spark, d):
    out = E.lead_columns(V.daily(spark, d), {"trade_date": "exec_next_trade_date", "open": "exec_next_open", "is_suspended": "exec_next_is_suspended"})
    return rounded(out.select(*KEYS, "exec_next_trade_date", "exec_next_open", "exec_next_is_suspended"), "exec_next_open")


@query("next_market_session", """
    SELECT trade_date, symbol, entry_date AS market_next_date, same_next_session FROM exec_panel""", "exec_panel")
def next_market_session(spark, d):
    return exec_panel(spark, d).select(*KEYS, "market_next_date", "same_next_session")


@query("limit_band", "SELECT trade_date, symbol, limit_band FROM signals", "signals")
def limit_band(spark, d):
    return signals(spark, d).select(*KEYS, "limit_band")


@query("filter_signal_rows", "SELECT trade_date, symbol, listed_days FROM signals", "signals")
def filter_signal_rows(spark, d):
    return E.filter_signal_rows(V.daily(spark, d)).select(*KEYS, "listed_days")


@query("label_available", "SELECT trade_date, symbol, round(open_to_high, 6) AS open_to_high FROM signals WHERE same_next_session AND outcome_available AND open_to_high IS NOT NULL", "signals")
def label_available(spark, d):
    return rounded(E.label_available(signals(spark, d), "open_to_high").select(*KEYS, "open_to_high"), "open_to_high")


@query("temporal_split", """
    SELECT trade_date, symbol, CASE WHEN trade_date <= DATE '2024-01-15' THEN 'train' ELSE 'test' END AS split FROM signals
    WHERE (trade_date <= DATE '2024-01-15' AND entry_date <= DATE '2024-01-15') OR (trade_date > DATE '2024-01-15' AND trade_date <= DATE '2024-01-25')""", "signals")
def temporal_split(spark, d):
    return E.temporal_split(signals(spark, d), "2024-01-15", end="2024-01-25").select(*KEYS, "split")


@query("purge_overlap", "SELECT trade_date, symbol FROM daily WHERE trade_date + 7 < DATE '2024-01-20'", "daily")
def purge_overlap(spark, d):
    return E.purge_overlap(V.daily(spark, d), "2024-01-20", 5).select(*KEYS)


@query("topk_candidates", """
    SELECT signal_date, top_k, entry_date, raw_candidates, filled, max_raw_rank_used, blocked_limit_up_open_raw, round(fill_rate, 6) AS fill_rate,
           round(selection_turnover, 6) AS selection_turnover FROM candidate_days""", "candidate_days")
def topk_candidates(spark, d):
    return rounded(book_parts(spark, d)[2], "fill_rate", "selection_turnover").withColumn("max_raw_rank_used", F.col("max_raw_rank_used").cast("bigint"))


@query("exit_policy_returns", """
    SELECT signal_date, symbol, top_k, exit_policy, hit_take_profit, round(gross_return, 8) AS gross_return, round(net_return, 8) AS net_return,
           round(capacity_cny, 4) AS capacity_cny FROM trades""", "trades")
def exit_policy_returns(spark, d):
    t = book_parts(spark, d)[3].select("signal_date", "symbol", "top_k", "exit_policy", "hit_take_profit", "gross_return", "net_return", "capacity_cny")
    return rounded(rounded(t, "gross_return", "net_return", digits=8), "capacity_cny", digits=4)


@query("daily_portfolio_returns", """
    SELECT signal_date, entry_date, top_k, exit_policy, filled, round(portfolio_return, 8) AS portfolio_return, round(gross_portfolio_return, 8) AS gross_portfolio_return,
           round(cash_weight, 8) AS cash_weight FROM book""", "book")
@query("join_cross_policies", """
    SELECT signal_date, entry_date, top_k, exit_policy, filled, round(portfolio_return, 8) AS portfolio_return, round(gross_portfolio_return, 8) AS gross_portfolio_return,
           round(cash_weight, 8) AS cash_weight FROM book""", "book")
def daily_portfolio_returns(spark, d):
    _, _, days, trades = book_parts(spark, d)
    out = E.daily_portfolio_returns(trades, days, POLICIES).select(
        "signal_date", "entry_date", "top_k", "exit_policy", "filled", "portfolio_return", "gross_portfolio_return", "cash_weight")
    return rounded(out, "portfolio_return", "gross_portfolio_return", "cash_weight", digits=8)


BOOK = ["top_k", "exit_policy"]
METRICS = ["filled_avg", "daily_return_mean", "daily_return_median", "daily_win_rate", "daily_vol", "ann_return", "sharpe", "hac_mean_t_5", "total_return",
           "gross_total_return", "benchmark_total_return", "active_return_mean", "active_sharpe", "relative_nav", "max_drawdown",
           "fill_rate_avg", "turnover_avg", "capacity_median", "ann_vol", "benchmark_sharpe", "benchmark_hac_t_5", "active_hac_t_5"]
add_view("metrics", ("book",), f"""
    SELECT a.*, hac_mean_t_5, benchmark_hac_t_5, active_hac_t_5 FROM (SELECT top_k, exit_policy, count(*) AS days, avg(filled) AS filled_avg, avg(fill_rate) AS fill_rate_avg, avg(selection_turnover) AS turnover_avg,
        median(cap) AS capacity_median, stddev_pop(portfolio_return) * sqrt(252.0::DOUBLE) AS ann_vol, avg(benchmark_return) / nullif(stddev_pop(benchmark_return), 0) * sqrt(252.0::DOUBLE) AS benchmark_sharpe, avg(portfolio_return) AS daily_return_mean,
        median(portfolio_return) AS daily_return_median, avg((portfolio_return > 0)::INT) AS daily_win_rate, stddev_pop(portfolio_return) AS daily_vol,
        power(product(1 + portfolio_return), 252.0::DOUBLE / count(*)) - 1 AS ann_return,
        avg(portfolio_return) / nullif(stddev_pop(portfolio_return), 0) * sqrt(252.0::DOUBLE) AS sharpe, product(1 + portfolio_return) - 1 AS total_return,
        product(1 + gross_portfolio_return) - 1 AS gross_total_return, product(1 + benchmark_return) - 1 AS benchmark_total_return,
        avg(active_return) AS active_return_mean, avg(active_return) / nullif(stddev_pop(active_return), 0) * sqrt(252.0::DOUBLE) AS active_sharpe,
        product(1 + portfolio_return) / product(1 + matched) - 1 AS relative_nav, min(dd) AS max_drawdown
      FROM (SELECT *, nav / max(nav) OVER (PARTITION BY top_k, exit_policy ORDER BY signal_date) - 1 AS dd
            FROM (SELECT *, product(1 + portfolio_return) OVER (PARTITION BY top_k, exit_policy ORDER BY signal_date) AS nav FROM book)) GROUP BY 1, 2) a
    JOIN ({hac_sql('book', 'top_k, exit_policy', 'signal_date', 'portfolio_return', 'hac_mean_t_5')}) h USING (top_k, exit_policy)
    LEFT JOIN ({hac_sql('book', 'top_k, exit_policy', 'signal_date', 'benchmark_return', 'benchmark_hac_t_5')}) hb USING (top_k, exit_policy)
    LEFT JOIN ({hac_sql('book', 'top_k, exit_policy', 'signal_date', 'active_return', 'active_hac_t_5')}) ha USING (top_k, exit_policy)""")


def metrics(spark, d):
    return E.performance_metrics(book(spark, d), BOOK)


@query("performance_metrics", "SELECT top_k, exit_policy, days, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM metrics", "metrics")
def performance_metrics(spark, d):
    return rounded(metrics(spark, d), *METRICS)


@query("best_policy", """
    SELECT * FROM (SELECT 'best' AS choice, top_k, exit_policy, round(sharpe, 6) AS sharpe FROM metrics WHERE sharpe IS NOT NULL ORDER BY metrics.sharpe DESC, top_k, exit_policy LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'frozen', top_k, exit_policy, round(sharpe, 6) FROM metrics ORDER BY top_k DESC, exit_policy LIMIT 1)""", "metrics")
def best_policy(spark, d):
    """The frozen policy is the first one of the largest K."""
    m = staged(metrics(spark, d))
    top = m.orderBy(F.col("top_k").desc(), "exit_policy").first()
    out = E.chosen_policies(m, ["top_k", "exit_policy"], {"top_k": top.top_k, "exit_policy": top.exit_policy})
    return out.select("choice", "top_k", "exit_policy", r("sharpe").alias("sharpe"))


@query("hac_mean_t", f"SELECT series, round(hac_t, 6) AS hac_t FROM ({hac_sql('series', 'series', 'trade_date', 'ret')})", "series")
def hac_mean_t(spark, d):
    return rounded(newey_west(V.series(spark, d), ["series"], "trade_date", "ret"), "hac_t")


@query("matched_universe_benchmark", """
    SELECT signal_date, exit_policy, benchmark_slots, benchmark_executed, round(benchmark_gross_return_sum, 6) AS benchmark_gross_return_sum,
           round(benchmark_return, 8) AS benchmark_return, round(benchmark_invested_weight, 6) AS benchmark_invested_weight,
           round(benchmark_executed_mean_return, 8) AS benchmark_executed_mean_return FROM bench""", "bench")
def matched_universe_benchmark(spark, d):
    b = benchmark(staged(signals(spark, d))).drop("benchmark_return_sum")
    return rounded(rounded(b, "benchmark_return", "benchmark_executed_mean_return", digits=8), "benchmark_gross_return_sum", "benchmark_invested_weight")


@query("attach_exposure_matched_benchmark", """
    SELECT signal_date, top_k, exit_policy, round(matched, 8) AS benchmark_exposure_matched_return, round(active_return, 8) AS active_return FROM book""", "book")
def attach_exposure_matched_benchmark(spark, d):
    b = book(spark, d).select("signal_date", "top_k", "exit_policy", "benchmark_exposure_matched_return", "active_return")
    return rounded(b, "benchmark_exposure_matched_return", "active_return", digits=8)


STRESS = ["selected_return_mean", "selected_sharpe", "selected_total_return", "benchmark_return_mean", "active_return_mean", "active_sharpe", "relative_nav"]


@query("cost_stress", f"""
    WITH c AS (SELECT b.signal_date, b.top_k, b.exit_policy, drag_bps, b.filled, coalesce(g - drag_bps / 10000, 0) * b.filled / b.top_k AS pr,
                 (n.benchmark_gross_return_sum - drag_bps / 10000 * n.benchmark_executed) / n.benchmark_slots AS br,
                 coalesce((n.benchmark_gross_return_sum - drag_bps / 10000 * n.benchmark_executed) / nullif(n.benchmark_executed, 0), 0) * b.filled / b.top_k AS mr
               FROM book b CROSS JOIN (VALUES (0.0::DOUBLE), (30.0::DOUBLE), (60.0::DOUBLE)) v(drag_bps)
               LEFT JOIN (SELECT signal_date, top_k, exit_policy, avg(gross_return) AS g FROM trades GROUP BY 1, 2, 3) t USING (signal_date, top_k, exit_policy)
               JOIN bench n ON n.signal_date = b.signal_date AND n.exit_policy = b.exit_policy)
    SELECT drag_bps, top_k, exit_policy, count(*) AS days, round(avg(pr), 6) AS selected_return_mean,
           round(avg(pr) / nullif(stddev_pop(pr), 0) * sqrt(252.0::DOUBLE), 6) AS selected_sharpe, round(product(1 + pr) - 1, 6) AS selected_total_return,
           round(avg(br), 6) AS benchmark_return_mean, round(avg(pr - mr), 6) AS active_return_mean,
           round(avg(pr - mr) / nullif(stddev_pop(pr - mr), 0) * sqrt(252.0::DOUBLE), 6) AS active_sharpe, round(product(1 + pr) / product(1 + mr) - 1, 6) AS relative_nav
    FROM c GROUP BY 1, 2, 3""", "book trades bench")
def cost_stress(spark, d):
    s, _, days, trades = book_parts(spark, d)
    daily = E.stressed_daily(trades, days, POLICIES, [0, 30, 60])
    return rounded(E.cost_stress(daily, benchmark(s), ["drag_bps", "top_k", "exit_policy"]), *STRESS)


@query("bucket_mix", """
    SELECT top_k, board, industry, count(*) AS rows, round(avg(open_to_high), 6) AS open_to_high_mean, round(avg(open_to_close), 6) AS open_to_close_mean,
           round(median(next_amount_cny), 2) AS median_next_amount_cny, round(count(*) / sum(count(*)) OVER (PARTITION BY top_k), 6) AS selection_share
    FROM selected GROUP BY 1, 2, 3""", "selected")
def bucket_mix(spark, d):
    m = E.bucket_mix(E.frozen_candidates(signals(spark, d), "pred", TOPS), ["board", "industry"])
    return rounded(rounded(m, "open_to_high_mean", "open_to_close_mean", "selection_share"), "median_next_amount_cny", digits=2)


def mix_sql(src: str, date: str, scope: str) -> str:
    return f"""SELECT '{scope}' AS scope, limit_band, CAST(sum(n) AS BIGINT) AS rows, count(*) AS dates_present, max(td) AS total_dates, round(sum(n) / max(tr), 6) AS row_share,
        round(sum(w) / max(td), 6) AS daily_weight_mean, round(median(w), 6) AS daily_weight_median_when_present
      FROM (SELECT *, n / sum(n) OVER (PARTITION BY d) AS w FROM (SELECT {date} AS d, limit_band, count(*) AS n FROM {src} GROUP BY 1, 2)),
           (SELECT count(*) AS tr, count(DISTINCT {date}) AS td FROM {src}) GROUP BY 2"""


@query("band_mix", mix_sql("signals", "trade_date", "signal_universe") + " UNION ALL " + mix_sql("(SELECT * FROM selected WHERE top_k = 10)", "signal_date", "selected_signal")
       + " UNION ALL " + mix_sql("(SELECT * FROM selected WHERE top_k = 10 AND execution_eligible)", "signal_date", "selected_execution_eligible"), "signals selected")
def band_mix(spark, d):
    s = staged(signals(spark, d))
    sel = E.frozen_candidates(s, "pred", [10])
    out = (E.band_mix(s, "limit_band", "trade_date", "signal_universe")
           .unionByName(E.band_mix(sel, "limit_band", "signal_date", "selected_signal"))
           .unionByName(E.band_mix(sel.where("execution_eligible"), "limit_band", "signal_date", "selected_execution_eligible")))
    return rounded(out, "row_share", "daily_weight_mean", "daily_weight_median_when_present")


TOPK_DAYS = """
    s AS (SELECT signal_date AS trade_date, top_k, symbol, open_to_high, open_to_close, amount, adv FROM selected
               JOIN (SELECT trade_date AS t, symbol AS s, avg(amount) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING) AS adv FROM daily) a ON t = signal_date AND s = symbol),
    c AS (SELECT trade_date AS t, lag(trade_date) OVER (ORDER BY trade_date) AS p FROM (SELECT DISTINCT trade_date FROM s)),
    k AS (SELECT a.trade_date, a.top_k, count(*) AS kept FROM s a JOIN c ON c.t = a.trade_date JOIN s b ON b.trade_date = c.p AND b.symbol = a.symbol AND b.top_k = a.top_k GROUP BY 1, 2),
    d AS (SELECT trade_date, top_k, count(*) AS names, avg(open_to_high) AS m, avg(open_to_close) AS oc, avg((coalesce(open_to_high, -1) >= 0.02)::INT) AS h, avg((coalesce(open_to_high, -1) >= 0.03)::INT) AS h3,
                 avg((coalesce(open_to_high, -1) >= 0.05)::INT) AS h5, median(adv) AS med, quantile_cont(adv, 0.25) AS p25, sum(adv) * 0.1::DOUBLE AS cap FROM s GROUP BY 1, 2),
    t AS (SELECT *, CASE WHEN trade_date = min(trade_date) OVER () THEN 1.0::DOUBLE ELSE 1 - coalesce(kept, 0) / names END AS turnover FROM d LEFT JOIN k USING (trade_date, top_k))"""


def top_days(spark, d):
    from ..operators.portfolio import topk_days
    from ..operators.rolling import rolling

    adv = rolling(V.daily(spark, d).select(*KEYS, "amount"), "amount", 20, 1, {"adv": F.avg}).select(*KEYS, "adv")
    s = staged(signals(spark, d).join(adv, KEYS))
    return topk_days(s, "pred", TOPS, "open_to_high", "adv", 0.1, ("open_to_close",))


@query("topk_daily_metrics", f"""
    WITH {TOPK_DAYS}
    SELECT trade_date, top_k, names, round(turnover, 6) AS turnover, round(m, 6) AS target_mean, round(oc, 6) AS open_to_close_mean, round(h, 6) AS hit_2pct, round(h3, 6) AS hit_3pct,
           round(h5, 6) AS hit_5pct, round(med, 9) AS median_adv, round(p25, 9) AS p25_adv, round(cap, 9) AS capacity FROM t""", "selected daily")
def topk_daily_metrics(spark, d):
    out = rounded(top_days(spark, d), "turnover", "target_mean", "open_to_close_mean", "hit_2pct", "hit_3pct", "hit_5pct")
    return rounded(out, "median_adv", "p25_adv", "capacity", digits=9)


@query("topk_summary", f"""
    WITH {TOPK_DAYS}
    SELECT top_k, count(DISTINCT trade_date) AS days, round(avg(names), 6) AS avg_names, round(avg(turnover), 6) AS avg_turnover, round(avg(m), 6) AS target_mean, round(avg(oc), 6) AS open_to_close_mean,
           round(avg(h), 6) AS hit_2pct, round(avg(h3), 6) AS hit_3pct, round(avg(h5), 6) AS hit_5pct, round(median(med), 6) AS median_adv, round(median(p25), 6) AS p25_adv, round(median(cap), 6) AS capacity FROM t GROUP BY 1""", "selected daily")
def topk_summary(spark, d):
    from ..operators.portfolio import topk_summary as op
    out = op(top_days(spark, d))
    return rounded(out, *[c for c in out.columns if c not in ("top_k", "days")])
