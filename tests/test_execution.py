import datetime as dt
import math

import pytest
from market_helpers import pdf

from marketloom.functions import expr as X
from marketloom.operators import execution as E
from marketloom.operators import minute as M
from marketloom.operators.metrics import ols

ROW = ("2024-01-02", "A", "2024-01-03", "2024-01-03", 10.0, 11.0, 10.5, 100.0, False, False, 10.0, 11.0)
COLS = ("trade_date date, symbol string, exec_next_trade_date date, market_next_date date, next_adj_open double, next_adj_high double, next_adj_close double, "
        "exec_next_amount double, exec_next_is_suspended boolean, exec_next_is_st boolean, exec_next_open double, exec_next_up_limit double")


def variant(**change):
    names = [c.split()[0] for c in COLS.split(", ")]
    row = dict(zip(names, ROW)) | change
    return tuple(row[n] for n in names)


@pytest.mark.parametrize("change, eligible", [
    ({}, True), ({"exec_next_is_suspended": True}, False), ({"exec_next_is_suspended": None}, True), ({"exec_next_is_st": True}, False),
    ({"exec_next_open": 10.99, "next_adj_open": 10.99}, False), ({"exec_next_up_limit": None}, False), ({"exec_next_up_limit": 30.0}, False),
    ({"exec_next_trade_date": "2024-01-04"}, False), ({"next_adj_open": None}, False)])
def test_entry_gates_fail_closed(frame, change, eligible):
    got = E.execution_fields(frame(COLS, [variant(**change)])).first()
    assert got["execution_eligible"] is eligible
    assert got["evaluation_eligible"] is eligible


def test_take_profit_needs_a_strict_cross(frame):
    rows = [variant(symbol=s, next_adj_high=h) for s, h in (("A", 10.8), ("B", 10.800001))]
    t = E.exit_policies(E.execution_fields(frame(COLS, rows)), [0.08, None], 0, 0, 0, 0.1)
    got = {(r["symbol"], r["exit_policy"]): r["hit_take_profit"] for r in t.collect()}
    assert got == {("A", "tp_8p00%"): False, ("B", "tp_8p00%"): True, ("A", "close"): False, ("B", "close"): False}


def test_unfilled_names_are_not_replaced_and_missing_days_are_cash(frame):
    from marketloom.operators.calendar import sessions
    from pyspark.sql import functions as F

    rows = [variant(symbol=s, trade_date=d, exec_next_is_suspended=(s == "A")) for d in ("2024-01-02",) for s in "ABC"]
    df = E.execution_fields(frame(COLS, rows)).withColumn("pred", F.when(F.col("symbol") == "A", 3.0).when(F.col("symbol") == "B", 2.0).otherwise(1.0))
    sel = E.frozen_candidates(df, "pred", [2])
    assert sorted(r["symbol"] for r in sel.collect()) == ["A", "B"]
    days = E.candidate_days(sel, sessions(df))
    trades = E.exit_policies(sel.where("evaluation_eligible"), [None], 0, 0, 0, 0.1)
    d = E.daily_portfolio_returns(trades, days, ["close"]).first()
    assert d["filled"] == 1 and math.isclose(d["portfolio_return"], 0.05 / 2) and d["cash_weight"] == 0.5


@pytest.mark.parametrize("up, want", [(10.5, "05pct"), (11.0, "10pct"), (12.0, "20pct"), (13.0, "30pct"), (11.5, "unknown"), (None, "unknown")])
def test_limit_band(frame, up, want):
    assert frame("pre_close double, up_limit double", [(10.0, up)]).select(X.limit_band("pre_close", "up_limit")).first()[0] == want


# --- minute path ---------------------------------------------------------------------------

DAY = "2024-01-03"


def minutes():
    base = dt.datetime(2024, 1, 3)
    return [base + dt.timedelta(minutes=m) for m in [*range(570, 691), *range(781, 901)]]


def session(symbol, high_at=None, high=10.0, drop=None, bad=None):
    out = []
    for i, t in enumerate(minutes()):
        if i == drop:
            continue
        h = high if i == high_at else 10.0
        out.append((symbol, DAY, t.isoformat(" "), 10.0, 9.0 if i == bad else h, 10.0, 10.0, 1000.0))
    return out


BARS = "symbol string, trade_date date, trade_time timestamp, open double, high double, low double, close double, amount double"
CAND = "signal_date date, entry_date date, symbol string, limit_band string, execution_eligible boolean, entry_limit_available boolean, blocked_limit_up_open boolean, blocked_not_next_session boolean, exec_next_up_limit double, exec_next_down_limit double"


def candidates(frame, names, up=11.0):
    return frame(CAND, [("2024-01-02", DAY, s, "10pct", True, True, False, False, up, 9.0) for s in names])


def test_minute_statuses_and_path(frame):
    bars = session("HIT", 50, 10.9) + session("TOUCH", 50, 10.8) + session("FLAT") + session("GAP", drop=30) + session("BAD", bad=7)
    c = candidates(frame, ["HIT", "TOUCH", "FLAT", "GAP", "BAD", "NONE"])
    terms = M.Terms(entry_bps=0, exit_bps=0, cost_bps=0)
    out = {r["symbol"]: r for r in M.audit(c, frame(BARS, bars), M.Session(), terms).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"HIT": "audited", "TOUCH": "audited", "FLAT": "audited", "GAP": "minute_incomplete",
                                                        "BAD": "minute_invalid", "NONE": "minute_missing"}
    assert math.isclose(out["HIT"]["net_return"], 0.08) and out["HIT"]["exit_reason"] == "take_profit_cross"
    assert out["TOUCH"]["net_return"] == 0.0 and out["TOUCH"]["target_touched"] and not out["TOUCH"]["target_crossed"]
    assert out["FLAT"]["opening_capacity_cny"] == 5 * 1000 * 0.05
    blocked = M.audit(candidates(frame, ["FLAT"], up=10.0), frame(BARS, session("FLAT")), M.Session(), terms).first()
    assert blocked["status"] == "minute_entry_blocked" and blocked["reasons"] == "limit_up_at_entry"


def test_benchmark_counts_missing_names_as_cash(frame):
    c = candidates(frame, ["A", "B", "C"])
    bars = frame(BARS, session("A", 50, 10.9))
    b = M.benchmark_daily(c, M.benchmark_detail(c, bars, M.Session(), M.Terms(entry_bps=0, exit_bps=0, cost_bps=0)))
    broad = b.where("limit_band is null").first()
    assert broad["slots"] == 3 and broad["audited"] == 1
    assert math.isclose(broad["cash_weight"], 2 / 3) and math.isclose(broad["benchmark_return"], 0.08 / 3)
    assert M.decomposition_gaps(b).where("not passed").count() == 0


def test_sparse_session_needs_entry_and_close(frame):
    keep = [b for i, b in enumerate(session("S")) if i in (1, 40, 240)]
    got = M.session_summary(frame(BARS, keep), M.Session(), M.Terms()).first()
    assert got["sparse_session"] and not got["full_session"]
    got = M.session_summary(frame(BARS, keep[:-1]), M.Session(), M.Terms()).first()
    assert not got["sparse_session"]


def test_ols_recovers_coefficients(spark):
    import numpy as np
    import pandas as pd

    i = np.arange(400)
    p = pd.DataFrame({"size": np.sin(i), "value": np.cos(i * 0.7)})
    p["strategy"] = 0.5 * p["size"] + 0.2 * p["value"] + 1e-4
    got = pdf(ols(spark.createDataFrame(p), "strategy", ["size", "value"], [], 20), "factor")
    assert np.allclose(got["beta"], [0.5, 0.2]) and np.allclose(got["intercept"], 1e-4) and np.allclose(got["r_squared"], 1.0)


def test_split_without_a_side_and_absent_frozen_policy_raise(frame):
    import pytest

    rows = frame("trade_date date, symbol string, entry_date date", [("2024-01-02", "A", "2024-01-03"), ("2024-01-10", "A", "2024-01-11")])
    assert sorted(r.split for r in E.temporal_split(rows, "2024-01-05").collect()) == ["test", "train"]
    with pytest.raises(ValueError, match="no test"):
        E.temporal_split(rows, "2024-02-01")
    m = frame("top_k int, exit_policy string, sharpe double", [(5, "a", 1.0), (10, "a", 2.0), (10, "b", 2.0), (20, "a", None)])
    got = {r.choice: (r.top_k, r.exit_policy) for r in E.chosen_policies(m, ["top_k", "exit_policy"], {"top_k": 20, "exit_policy": "a"}).collect()}
    assert got == {"best": (10, "a"), "frozen": (20, "a")}
    with pytest.raises(ValueError, match="frozen"):
        E.chosen_policies(m, ["top_k", "exit_policy"], {"top_k": 7, "exit_policy": "a"})
