"""Projection, filter, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as V
from ..functions import expr as X
from ..operators import asof as A
from ..operators import calendar as C
from ..operators import clean as CL
from ..operators import concepts as CO
from ..operators import keys as K
from ..operators import portfolio as P
from ..operators.rolling import median, rolling
from ..session import staged
from ..sources.tables import date_window
from .execution import exec_panel
from .registry import query, r, rounded

KEYS = ["trade_date", "symbol"]


@query("strip_exchange_suffix", "SELECT trade_date, ts_code, CAST(symbol AS VARCHAR) AS symbol FROM daily", "daily")
def strip_exchange_suffix(spark, d):
    return V.daily(spark, d).select("trade_date", "ts_code", X.strip_suffix("ts_code").alias("symbol"))


@query("filter_market_suffix", "SELECT trade_date, ts_code FROM daily WHERE symbol % 10 < 9", "daily")
def filter_market_suffix(spark, d):
    return V.daily(spark, d).where(X.market_suffix(F.lower("ts_code")).isin("SH", "SZ")).select("trade_date", "ts_code")


@query("filter_date_window", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem WHERE l_shipdate >= DATE '1997-03-01' AND l_shipdate < DATE '1998-03-01'")
def filter_date_window(spark, d):
    li = date_window(V.table(spark, d, "lineitem"), "1997-03-01", "1998-02-28", "l_shipdate")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("trade_date"))


@query("assert_unique_key", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS rows FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def assert_unique_key(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    K.assert_unique(o, ["o_orderkey"], "orders")
    return K.duplicate_keys(o, ["o_custkey", "day"])


@query("safe_divide", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(l_extendedprice / nullif(l_tax, 0), 4) AS ratio FROM lineitem")
def safe_divide(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", r(X.safe_divide("l_extendedprice", "l_tax"), 4).alias("ratio"))


CANDLE = ["daily_range", "upper_shadow", "lower_shadow", "body_return", "close_pos", "gap_open", "log_mcap", "amount_log", "mcap_turnover_interaction",
          "small_high_turnover", "signed_amount_pressure"]


@query("candle_features", "WITH b AS (SELECT *, CASE WHEN pre_close > 0 THEN pre_close ELSE close END AS base, ln(1 + total_mv) AS lm, ln(1 + amount) AS la FROM daily) SELECT trade_date, symbol, "
       + ", ".join(f"round({e}, 6) AS {n}" for n, e in zip(CANDLE, [
           "(high - low) / base", "(high - greatest(open, close)) / base", "(least(open, close) - low) / base", "close / open - 1", "(close - low) / nullif(high - low, 0)",
           "open / pre_close - 1", "lm", "la", "lm * turnover_rate", "-lm * turnover_rate", "pct_chg / 100 * la"])) + " FROM b", "daily")
def candle_features(spark, d):
    f = X.candle_features()
    return V.daily(spark, d).select(*KEYS, *[r(f[c]).alias(c) for c in CANDLE])


@query("tradable_flags", """SELECT trade_date, symbol, close > 0 AND NOT is_suspended AND NOT is_st AND NOT is_limit_up AS buy_tradable,
    close > 0 AND NOT is_suspended AND NOT is_limit_down AS sell_tradable FROM daily""", "daily")
def tradable_flags(spark, d):
    return CL.tradable_flags(V.daily(spark, d)).select(*KEYS, "buy_tradable", "sell_tradable")


@query("price_limit_flags", "SELECT trade_date, symbol, amount > 0 AS tradable, is_limit_up AS limit_up, is_limit_down AS limit_down, round(pct_chg / 100, 8) AS ret FROM daily", "daily")
def price_limit_flags(spark, d):
    return rounded(CL.price_limit_flags(V.daily(spark, d)), "ret", digits=8)


@query("clip_turnover", "SELECT trade_date, symbol, least(greatest(turnover + (symbol % 10 = 3)::INT, 40.0::DOUBLE), 100.0::DOUBLE) AS turnover FROM panel_part WHERE symbol % 7 <> 0", "panel_part")
def clip_turnover(spark, d):
    """A tenth of the keys come twice; the later copy counts."""
    p = V.panel_part(spark, d).select(*KEYS, F.when(F.col("symbol") % 7 == 0, "n/a").otherwise(F.col("turnover").cast("string")).alias("turnover"), F.lit(0).alias("copy"))
    later = p.where("symbol % 10 = 3").withColumns({"turnover": F.when(F.col("symbol") % 7 == 0, "n/a").otherwise((F.col("turnover").try_cast("double") + 1).cast("string")), "copy": F.lit(1)})
    return CL.clip_turnover(p.unionByName(later), "turnover", 40.0, order=["copy"]).drop("copy")


@query("overlay_suspensions", """
    SELECT trade_date, d.symbol, is_suspended OR e.symbol IS NOT NULL AS is_suspended, e.symbol IS NOT NULL AND NOT is_suspended AS newly_flagged
    FROM daily d LEFT JOIN (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS t FROM events WHERE event_type = 'error' AND value > 100) e ON e.symbol = d.symbol AND e.t = trade_date""", "daily")
def overlay_suspensions(spark, d):
    e = V.table(spark, d, "events").where("event_type = 'error' and value > 100").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"))
    return CL.overlay_suspensions(V.daily(spark, d), e).select(*KEYS, "is_suspended", "newly_flagged")


@query("build_clean_bridge", """
    SELECT trade_date, d.symbol, round(close * adj_factor, 6) AS tr_close, is_limit_up, is_limit_down,
           date_diff('day', least(l.list_date, min(trade_date) OVER (PARTITION BY d.symbol)), trade_date) AS listed_days, CASE WHEN n > 1 THEN round(total_mv, 4) END AS total_mv
    FROM daily d LEFT JOIN (SELECT c_custkey AS symbol, DATE '2023-12-01' + (c_custkey % 40)::INT AS list_date FROM customer) l ON l.symbol = d.symbol""", "daily")
def build_clean_bridge(spark, d):
    b = V.daily(spark, d)
    inst = V.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.date_add(F.lit("2023-12-01").cast("date"), (F.col("c_custkey") % 40).cast("int")).alias("list_date"))
    out = CL.clean_bridge(b.select(*KEYS, "close"), b.where("n > 1").select(*KEYS, "total_mv"), b.select(*KEYS, "adj_factor"), b.select(*KEYS, "up_limit", "down_limit"), inst)
    return rounded(out.select(*KEYS, "tr_close", "is_limit_up", "is_limit_down", F.col("listed_days").cast("bigint").alias("listed_days"), r("total_mv", 4).alias("total_mv")), "tr_close")


@query("assemble_clean_history", """
    SELECT trade_date, symbol, round(CASE WHEN trade_date < DATE '2024-01-15' THEN close * adj_factor ELSE close * 1.5::DOUBLE END, 6) AS tr_close FROM daily
    WHERE trade_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'""", "daily")
def assemble_clean_history(spark, d):
    b = V.daily(spark, d)
    early = b.where("trade_date < date'2024-01-15'").select(*KEYS, "close", "adj_factor")
    late = b.where("trade_date >= date'2024-01-15'").select(*KEYS, "close", (F.col("close") * 1.5).alias("tr_close"))
    out = K.assert_unique(CL.assemble_history(early, late, "2024-01-03", "2024-01-28"), KEYS, "history")
    return rounded(out.select(*KEYS, "tr_close"), "tr_close")


@query("union_history", "SELECT DISTINCT trade_date, symbol FROM daily WHERE (trade_date < DATE '2024-01-20' OR amount > 50) AND trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-28'", "daily")
def union_history(spark, d):
    b = V.daily(spark, d)
    both = b.where("trade_date < date'2024-01-20'").select(*KEYS).unionByName(b.where("amount > 50").select(*KEYS)).dropDuplicates()
    return date_window(both, "2024-01-05", "2024-01-28")


@query("coverage_select", "SELECT trade_date, symbol, round(close, 6) AS close, round(pct_chg, 6) AS pct_chg FROM daily WHERE pct_chg IS NOT NULL", "daily")
def coverage_select(spark, d):
    b = V.daily(spark, d).withColumn("rare", F.when(F.col("symbol") % 5 == 0, F.col("amount"))).select(*KEYS, "close", "pct_chg", "rare")
    keep = CL.covered_columns(b, ["close", "pct_chg", "rare"])
    return rounded(b.select(*KEYS, *keep).dropna(), *keep)


@query("signal_filter_flags", """
    WITH w AS (SELECT *, sum(vol) OVER (w ROWS 34 PRECEDING) AS s35, count(vol) OVER (w ROWS 34 PRECEDING) AS c35, max(high) OVER (w ROWS 125 PRECEDING) AS h, min(low) OVER (w ROWS 125 PRECEDING) AS l,
               count(high) OVER (w ROWS 125 PRECEDING) AS c126 FROM ship_daily WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
    f AS (SELECT trade_date, symbol, amount < 60000 AS small_cap, close > 1000 AS rich, coalesce(c35 >= 35 AND s35 > 1000, false) AS active, coalesce(c126 >= 126 AND h / l - 1 < 100, false) AS calm, vol > 10 AS tradable FROM w)
    SELECT *, small_cap AND rich AND active AND calm AND tradable AS signal_ok FROM f""", "ship_daily")
def signal_filter_flags(spark, d):
    from ..operators.events import add_windows, filter_flags
    w = add_windows(V.ship_daily(spark, d), turnover="vol")
    flags = filter_flags({"small_cap": F.col("amount") < 60000, "rich": F.col("close") > 1000, "active": F.col("turnover_sum") > 1000,
                          "calm": F.col("range_high") / F.col("range_low") - 1 < 100, "tradable": F.col("vol") > 10})
    return w.withColumns(flags).withColumn("signal_ok", X.all_of([F.col(c) for c in flags])).select(*KEYS, *flags, "signal_ok")


ELIG = """WITH m AS (SELECT trade_date, symbol, listed_days, close, is_suspended, is_st, CASE WHEN count(amount) OVER w >= 10 THEN quantile_cont(amount, 0.5) OVER w END AS med FROM daily
          WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING))"""


@query("filter_eligible_panel", ELIG + "SELECT trade_date, symbol, round(med, 6) AS median_amount FROM m WHERE listed_days >= 60 AND med >= 80 AND close > 0 AND NOT is_suspended AND NOT is_st", "daily")
def filter_eligible_panel(spark, d):
    b = V.daily(spark, d)
    facts = rolling(b.select(*KEYS, "listed_days", "close", "is_suspended", "is_st", "amount"), "amount", 20, 10, {"median_amount": median})
    return rounded(CL.eligible_panel(b.select(*KEYS, "pred"), facts, 60, 80.0).select(*KEYS, "median_amount"), "median_amount")


@query("formation_eligibility", "SELECT trade_date, symbol, listed_days FROM daily WHERE n > 1 AND listed_days >= 60 AND amount > 0 AND NOT is_st", "daily")
def formation_eligibility(spark, d):
    b = V.daily(spark, d)
    j = CL.formation_universe(b.select(*KEYS, "pred"), b, b.where("n > 1"), b.where("is_st"))
    return CL.formation_eligible(j, 60).select(*KEYS, "listed_days")


@query("formation_exclusions", """SELECT count(*) AS factor_rows_in_universe, count(*) FILTER (listed_days < 60) AS excluded_immature, count(*) FILTER (is_st) AS excluded_st,
    count(*) FILTER (amount <= 0) AS excluded_not_trading FROM daily WHERE n > 1""", "daily")
def formation_exclusions(spark, d):
    b = V.daily(spark, d)
    return CL.formation_exclusions(CL.formation_universe(b.select(*KEYS, "pred"), b, b.where("n > 1"), b.where("is_st")), 60)


# --- joins ---------------------------------------------------------------------------------

@query("join_keyed_one_to_one", "SELECT trade_date, symbol, round(close, 8) AS close, round(disc, 6) AS disc FROM panel_part", "panel_part")
def join_keyed_one_to_one(spark, d):
    p = staged(V.panel_part(spark, d))
    return rounded(rounded(K.checked_join(p.select(*KEYS, "close"), p.select(*KEYS, "disc"), KEYS), "close", digits=8), "disc")


@query("join_semi_universe", "SELECT trade_date, symbol, round(amount, 2) AS amount FROM panel_part WHERE turnover > 50", "panel_part")
def join_semi_universe(spark, d):
    p = V.panel_part(spark, d)
    return rounded(p.select(*KEYS, "amount").join(p.where("turnover > 50").select(*KEYS), KEYS, "left_semi"), "amount", digits=2)


@query("join_interval_expand", """
    WITH e AS (SELECT max(trade_date) AS t FROM ship_daily GROUP BY date_trunc('month', trade_date))
    SELECT DISTINCT t AS trade_date, symbol FROM membership JOIN e ON t BETWEEN in_date AND out_date""", "membership ship_daily")
def join_interval_expand(spark, d):
    dates = C.month_ends(V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")))
    return A.expand_intervals(V.membership(spark, d), dates, "in_date", "out_date")


@query("join_interval_industry_pit", """
    SELECT p.trade_date, p.symbol, s.industry FROM panel_supplier p LEFT JOIN industry_spells s ON p.symbol = s.symbol AND p.trade_date >= in_date AND (out_date IS NULL OR p.trade_date < out_date)""",
       "panel_supplier industry_spells")
def join_interval_industry_pit(spark, d):
    return A.interval_value(V.panel_supplier(spark, d).select(*KEYS), V.industry_spells(spark, d), "industry")


@query("join_asof_pit_fields", """
    WITH f AS (SELECT DISTINCT o_custkey AS symbol, CAST(last_day(o_orderdate) AS DATE) AS trade_date FROM orders)
    SELECT f.trade_date, f.symbol, round(arg_max(roe, (report_period, available_date, -seq)) FILTER (roe IS NOT NULL), 6) AS roe,
           round(arg_max(growth, (report_period, available_date, -seq)) FILTER (growth IS NOT NULL), 6) AS growth
    FROM f LEFT JOIN pit_events e ON e.symbol = f.symbol AND e.available_date <= f.trade_date GROUP BY 1, 2""", "pit_events")
def join_asof_pit_fields(spark, d):
    f = V.table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.last_day("o_orderdate").alias("trade_date")).distinct()
    out = A.latest_pit_fields(V.pit_events(spark, d), f, ["roe", "growth"], ["report_period", "available_date"])
    return rounded(out.select(*KEYS, "roe", "growth"), "roe", "growth")


@query("fundamental_asof", """
    WITH a AS (SELECT symbol, available_date, max(roe) AS roe FROM pit_events WHERE roe IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT DISTINCT o_custkey AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date FROM orders)
    SELECT p.trade_date, p.symbol, round(a.roe, 4) AS roe FROM p ASOF LEFT JOIN a ON p.symbol = a.symbol AND p.trade_date >= a.available_date""", "pit_events")
def fundamental_asof(spark, d):
    p = V.table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.trunc("o_orderdate", "MM").alias("trade_date")).distinct()
    return rounded(A.latest_row_asof(V.pit_events(spark, d), p, ["roe"], "available_date").select(*KEYS, "roe"), "roe", digits=4)


@query("pit_overlay", """
    WITH a AS (SELECT symbol, available_date AS trade_date, max(roe) AS roe, max(growth) AS growth FROM pit_events GROUP BY 1, 2)
    SELECT trade_date, symbol, round(coalesce(roe, growth * 2), 4) AS roe FROM a""", "pit_events")
def pit_overlay(spark, d):
    from ..plans.style import pit_overlay as op
    a = V.pit_events(spark, d).groupBy("symbol", F.col("available_date").alias("trade_date")).agg(F.max("roe").alias("roe"), F.max("growth").alias("growth"))
    out = op(a.select(*KEYS, (F.col("growth") * 2).alias("roe")), a.select(*KEYS, "roe"), ["roe"])
    return rounded(out, "roe", digits=4)


@query("aux_same_day_merge", """
    SELECT d.trade_date, d.symbol, e.event FROM daily d LEFT JOIN (SELECT CAST(ts AS DATE) AS t, user_id AS s, max(event_type) AS event FROM events WHERE value > 150 GROUP BY 1, 2) e ON t = trade_date AND s = symbol""", "daily")
def aux_same_day_merge(spark, d):
    e = V.table(spark, d, "events").where("value > 150").groupBy(F.to_date("ts").alias("trade_date"), F.col("user_id").alias("symbol")).agg(F.max("event_type").alias("event"))
    return V.daily(spark, d).select(*KEYS).join(e, KEYS, "left")


@query("join_asof_membership_dates", """
    WITH e AS (SELECT max(trade_date) AS m FROM ship_daily GROUP BY date_trunc('month', trade_date)), d AS (SELECT DISTINCT trade_date FROM ship_daily)
    SELECT trade_date, m AS rebalance_date FROM d ASOF LEFT JOIN e ON trade_date > m""", "ship_daily")
def join_asof_membership_dates(spark, d):
    days = V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()
    return C.last_session_before(days, C.month_ends(days), "rebalance_date")


@query("next_trading_date", """
    WITH f AS (SELECT DISTINCT CAST(last_day(o_orderdate) AS DATE) AS formation_date FROM orders), d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS t FROM lineitem)
    SELECT formation_date, t AS execution_date FROM f ASOF LEFT JOIN d ON t > formation_date""")
def next_trading_date(spark, d):
    f = V.table(spark, d, "orders").select(F.last_day("o_orderdate").alias("formation_date")).distinct()
    cal = V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()
    return C.next_session(f, cal, "formation_date", "execution_date")


@query("entry_date_attach", """
    WITH c AS (SELECT trade_date AS t, lead(trade_date) OVER (ORDER BY trade_date) AS nd FROM (SELECT DISTINCT trade_date FROM panel_supplier))
    SELECT trade_date, symbol, nd AS entry_date FROM panel_supplier JOIN c ON t = trade_date""", "panel_supplier")
def entry_date_attach(spark, d):
    p = staged(V.panel_supplier(spark, d).select(*KEYS))
    return p.join(C.sessions(p).select("trade_date", F.col("next_date").alias("entry_date")), "trade_date")


@query("month_end_calendar", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(max(l_shipdate) AS DATE) AS trade_date FROM lineitem GROUP BY 1")
def month_end_calendar(spark, d):
    return C.month_ends(V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")))


@query("delist_event_date", """
    WITH x AS (SELECT o_custkey AS symbol, CAST(max(o_orderdate) AS DATE) AS delist_date FROM orders GROUP BY 1), d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS t FROM lineitem)
    SELECT symbol, delist_date, t AS event_date FROM x ASOF JOIN d ON t >= delist_date""")
def delist_event_date(spark, d):
    x = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol")).agg(F.to_date(F.max("o_orderdate")).alias("delist_date"))
    cal = V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()
    return C.next_session(x, cal, "delist_date", "event_date", strict=False).where("event_date is not null")


@query("join_next_session_bars", """
    SELECT trade_date, symbol, round(close, 6) AS close, entry_date, same_next_session AND NOT nsusp AND NOT nst AND NOT coalesce(nopen >= nup * 0.999, false) AS entry_ok,
           round(CASE WHEN same_next_session AND NOT nsusp AND NOT nst AND NOT coalesce(nopen >= nup * 0.999, false) THEN nopen END, 6) AS entry_price FROM exec_panel WHERE pred > 0.7""", "exec_panel")
def join_next_session_bars(spark, d):
    from ..operators.events import next_session_entry
    b = V.daily(spark, d)
    sig = b.where("pred > 0.7").select(*KEYS)
    out = next_session_entry(sig, staged(b))
    return rounded(out.select(*KEYS, "close", "entry_date", "entry_ok", "entry_price"), "close", "entry_price")


@query("join_qualified_activity", """
    SELECT trade_date, symbol FROM ((SELECT trade_date, symbol FROM daily WHERE pct_chg > 3) UNION (SELECT trade_date, symbol FROM daily WHERE amount > 150)) WHERE (trade_date, symbol) IN (SELECT (trade_date, symbol) FROM daily WHERE NOT is_st)""", "daily")
def join_qualified_activity(spark, d):
    b = V.daily(spark, d)
    return P.qualified_activity([b.where("pct_chg > 3"), b.where("amount > 150")], b.where("not is_st"))


@query("reason_union", "(SELECT trade_date, symbol FROM daily WHERE pct_chg > 3) UNION (SELECT trade_date, symbol FROM daily WHERE amount > 150)", "daily")
def reason_union(spark, d):
    b = V.daily(spark, d)
    return P.union_keys([b.where("pct_chg > 3"), b.where("amount > 150")])


@query("join_match_rate", """
    SELECT 'bars_basics' AS "join", count(*) AS rows, round(avg((n > 1)::INT), 6) AS rate FROM daily UNION ALL
    SELECT 'lines_parts', count(*), round(avg((p_partkey IS NOT NULL)::INT), 6) FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10""", "daily")
def join_match_rate(spark, d):
    b, li = V.daily(spark, d), V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"))
    parts = V.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("symbol"))
    return rounded(CL.match_rate(b, b.where("n > 1"), KEYS, "bars_basics").unionByName(CL.match_rate(li, parts, ["symbol"], "lines_parts")), "rate")


@query("align_common_dates", """
    WITH l AS (SELECT series, trade_date, ret FROM series WHERE NOT (series = 'view' AND day(trade_date) % 3 = 0))
    SELECT * REPLACE (round(ret, 8) AS ret) FROM l WHERE trade_date IN (SELECT trade_date FROM l GROUP BY 1 HAVING count(*) = 5)""", "series")
def align_common_dates(spark, d):
    s = staged(V.series(spark, d).where("not (series = 'view' and day(trade_date) % 3 = 0)").withColumn("all", F.lit(1)))
    return rounded(CL.common_dates(s, ["all"], "series").drop("all"), "ret", digits=8)


# Keyword weights per dimension, entity exposures per dimension.
KEYWORDS = {"red": {"heat": 0.6, "cycle": 0.4}, "gear": {"cycle": 1.0}, "eco": {"value": 0.8}, "promotion": {"heat": 0.5}, "small": {"value": 0.2, "heat": 0.3}}
KW_SQL = "(VALUES " + ", ".join(f"('{k}', '{dim}', {w}::DOUBLE)" for k, v in KEYWORDS.items() for dim, w in v.items()) + ") kw(k, dimension, weight)"
CONCEPTS_SQL = "SELECT trade_date, symbol, hot, unnest(list_distinct(list_transform(string_split(trim(concepts, '[]'), ','), lambda x: trim(x)))) AS concept FROM hot_list"
DIM_SQL = f"SELECT trade_date, dimension, sum(weight) AS score FROM ({CONCEPTS_SQL}), {KW_SQL} WHERE contains(lower(concept), k) OR contains(k, lower(concept)) GROUP BY 1, 2"


def dimension_scores(spark, d):
    return CO.keyword_scores(CO.explode_concepts(V.hot_list(spark, d)), KEYWORDS, ["trade_date"])


@query("join_concept_exposure", f"SELECT trade_date, dimension, round(score, 4) AS score FROM ({DIM_SQL})", "hot_list")
def join_concept_exposure(spark, d):
    return rounded(dimension_scores(spark, d), "score", digits=4)


@query("score_entities_by_exposure", f"""
    SELECT trade_date, n_nationkey AS entity, round(sum(score * (0.1::DOUBLE * (n_nationkey % 7) + 0.05::DOUBLE)), 4) AS score FROM ({DIM_SQL}) s JOIN nation
    ON dimension = CASE n_nationkey % 3 WHEN 0 THEN 'heat' WHEN 1 THEN 'cycle' ELSE 'value' END GROUP BY 1, 2""", "hot_list")
def score_entities_by_exposure(spark, d):
    k = F.col("n_nationkey") % 3
    ex = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("entity"), F.when(k == 0, "heat").when(k == 1, "cycle").otherwise("value").alias("dimension"),
                                            (0.1 * (F.col("n_nationkey") % 7) + 0.05).alias("exposure"))
    return rounded(CO.entity_scores(dimension_scores(spark, d), ex, ["trade_date"]), "score", digits=4)


@query("map_concept_to_members", """
    WITH c AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS concept FROM part UNION SELECT DISTINCT lower(p_type) FROM part),
    m AS (SELECT concept, p_partkey AS member FROM c JOIN part ON contains(lower(p_name), lower(concept)) OR contains(lower(concept), lower(p_name)))
    SELECT * FROM m UNION SELECT concept, p_partkey FROM c JOIN part ON contains(lower(p_type), lower(concept)) WHERE concept NOT IN (SELECT concept FROM m)""")
def map_concept_to_members(spark, d):
    p = V.table(spark, d, "part")
    c = p.select(F.substring_index("p_name", " ", 1).alias("concept")).union(p.select(F.lower("p_type"))).distinct()
    return CO.concept_members(c, p.select(F.col("p_partkey").alias("member"), F.col("p_name").alias("name"), F.col("p_type").alias("description")))


@query("join_forward_open_return", """
    WITH l AS (SELECT trade_date AS t, lead(trade_date) OVER w AS d1, lead(trade_date, 2) OVER w AS d2 FROM (SELECT DISTINCT trade_date FROM panel_supplier WHERE month(trade_date) % 6 <> 0) WINDOW w AS (ORDER BY trade_date))
    SELECT t AS trade_date, a.symbol, round(b.close / a.close - 1, 6) AS label FROM l JOIN panel_supplier a ON a.trade_date = d1 JOIN panel_supplier b ON b.trade_date = d2 AND b.symbol = a.symbol
    WHERE abs(b.close / a.close - 1) <= 0.5""", "panel_supplier")
def join_forward_open_return(spark, d):
    p = staged(V.panel_supplier(spark, d).select(*KEYS, "close"))
    return rounded(A.forward_pair_return(p.where("month(trade_date) % 6 <> 0"), p, "close"), "label")


@query("attach_daily_benchmark", """
    SELECT s.trade_date, series, round(ret, 8) AS ret, round(ret - b, 8) AS active FROM series s JOIN (SELECT trade_date, avg(pct_chg) / 100 AS b FROM daily GROUP BY 1) USING (trade_date) WHERE b IS NOT NULL AND series = 'click'""", "series daily")
def attach_daily_benchmark(spark, d):
    bench = V.daily(spark, d).groupBy("trade_date").agg((F.avg("pct_chg") / 100).alias("benchmark_return")).where("benchmark_return is not null")
    mine = V.series(spark, d).where("series = 'click'").join(bench.select("trade_date"), "trade_date", "left_semi")
    out = P.attach_full(mine, bench, "trade_date", "benchmark_return").withColumn("active", F.col("ret") - F.col("benchmark_return"))
    return rounded(out.select("trade_date", "series", "ret", "active"), "ret", "active", digits=8)


@query("position_factor_exposure", """
    WITH t AS (SELECT trade_date, symbol, disc, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS w FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k FROM panel_supplier) WHERE k <= 20)
    SELECT trade_date, round(sum(w * disc) / sum(w), 6) AS score, count(*) AS names, round(max(w), 6) AS max_weight FROM t GROUP BY 1""", "panel_supplier")
def position_factor_exposure(spark, d):
    p = staged(V.panel_supplier(spark, d))
    t = P.equal_weight_top(p, "amount", 20)
    return rounded(P.position_exposure_to(t.select(*KEYS, "weight"), p.select(*KEYS, "disc"), "weight", "disc"), "score", "max_weight")


# --- sets, top-k ---------------------------------------------------------------------------

@query("universe_month_end_liquid", """
    WITH m AS (SELECT *, CASE WHEN count(amount) OVER w >= 30 THEN quantile_cont(amount, 0.5) OVER w END AS liq FROM ship_daily WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
    SELECT trade_date, symbol, round(liq, 4) AS liq_metric FROM m WHERE liq IS NOT NULL AND trade_date IN (SELECT max(trade_date) FROM ship_daily GROUP BY date_trunc('month', trade_date))""", "ship_daily")
def universe_month_end_liquid(spark, d):
    s = staged(V.ship_daily(spark, d).select(*KEYS, "amount"))
    m = rolling(s, "amount", 60, 30, {"liq_metric": median}, shift=1)
    return rounded(m.join(C.month_ends(s).select("trade_date"), "trade_date", "left_semi").where("liq_metric is not null").select(*KEYS, "liq_metric"), "liq_metric", digits=4)


@query("set_turnover", """
    WITH t AS (SELECT trade_date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k FROM panel_supplier) WHERE k <= 20),
    c AS (SELECT trade_date AS d, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM t)), m AS (SELECT symbol, i FROM t JOIN c ON d = trade_date)
    SELECT d AS trade_date, i AS idx, names, entered, CAST(coalesce(exited, 0) AS BIGINT) AS exited, round((entered + coalesce(exited, 0)) / 40.0::DOUBLE, 6) AS turnover FROM c
    JOIN (SELECT m.i, count(*) AS names, count(*) FILTER (p.symbol IS NULL) AS entered FROM m LEFT JOIN m p ON p.symbol = m.symbol AND p.i = m.i - 1 GROUP BY 1) USING (i)
    LEFT JOIN (SELECT m.i + 1 AS i, count(*) AS exited FROM m LEFT JOIN m p ON p.symbol = m.symbol AND p.i = m.i + 1 WHERE p.symbol IS NULL GROUP BY 1) USING (i)""", "panel_supplier")
def set_turnover(spark, d):
    t = staged(P.equal_weight_top(V.panel_supplier(spark, d), "amount", 20).select(*KEYS))
    out = P.set_turnover(t).withColumn("turnover", r((F.col("entered") + F.col("exited")) / 40.0))
    return out.withColumn("idx", F.col("idx").cast("bigint"))


@query("topn_universe_daily", "SELECT trade_date, symbol FROM panel_part QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) <= 50", "panel_part")
def topn_universe_daily(spark, d):
    from ..operators.execution import top_rows
    return top_rows(V.panel_part(spark, d), "amount", 50).select(*KEYS)


@query("pit_topn_membership", """
    SELECT trade_date, symbol, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS rank FROM daily WHERE listed_days >= 41 AND NOT is_suspended
    QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) <= 5""", "daily")
def pit_topn_membership(spark, d):
    b = staged(V.daily(spark, d).select(*KEYS, "listed_days", "is_suspended", F.col("amount").alias("liq_metric")))
    return P.pit_top_n(b.select(*KEYS, "liq_metric"), b, 5, 41).select(*KEYS, F.col("rank").cast("bigint").alias("rank"))


@query("liquidity_filter_train", """
    SELECT trade_date, symbol, round(amount, 2) AS amount FROM (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY amount DESC) AS k, count(*) OVER (PARTITION BY symbol) AS c FROM panel_part) WHERE k <= 100 OR c >= 35""", "panel_part")
def liquidity_filter_train(spark, d):
    return rounded(P.kth_largest_filter(staged(V.panel_part(spark, d).select(*KEYS, "amount")), "amount", 100, 35), "amount", digits=2)


@query("worst_days", """
    SELECT *, count(*) OVER (PARTITION BY year(trade_date)) AS in_year, count(*) OVER (PARTITION BY weekday) AS on_weekday FROM (
    SELECT trade_date, round(ret, 6) AS ret, round(next_ret, 6) AS next_ret, dayname(trade_date) AS weekday FROM (SELECT *, lead(ret) OVER (ORDER BY trade_date) AS next_ret FROM
    (SELECT trade_date, avg(pct_chg) / 100 AS ret FROM daily WHERE pct_chg IS NOT NULL GROUP BY 1)) ORDER BY 2, 1 LIMIT 10)""", "daily")
def worst_days(spark, d):
    from ..operators.series import market_proxy, worst_days as op
    return rounded(op(market_proxy(V.daily(spark, d)), 10), "ret", "next_ret")


@query("sample_per_date", """SELECT trade_date, symbol FROM panel_part QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY md5('42|' || symbol), symbol) <= 100""", "panel_part")
def sample_per_date(spark, d):
    return P.sample_per_date(V.panel_part(spark, d).select(*KEYS), 100, 42, ["symbol"])
