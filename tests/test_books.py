import math

import numpy as np
import pandas as pd
import pytest
from market_helpers import days, pdf

from marketloom.operators import events as EV
from marketloom.operators import portfolio as P
from marketloom.operators import rolling as R
from marketloom.operators.calendar import sessions
from marketloom.plans import books as B
from marketloom.plans import replica as RP
from marketloom.plans import rotation as RO


def test_point_in_time_index(frame):
    """Membership takes effect the session after it is formed; a missing return is zero."""
    rows = [("2024-01-02", s, pct, 100.0 + pct, 100.0, 100, False) for s, pct in (("A", 50.0), ("B", 0.0), ("C", 0.0))]
    rows += [("2024-01-03", "A", 10.0, 110.0, 100.0, 101, False), ("2024-01-03", "B", 10.0, 110.0, 100.0, 101, False)]
    rows += [("2024-01-04", "A", 30.0, 130.0, 100.0, 102, False)]
    bars = frame("trade_date date, symbol string, pct_chg double, close double, pre_close double, listed_days int, is_suspended boolean", rows)
    uni = frame("trade_date date, symbol string, liq_metric double", [("2024-01-02", "A", 3.0), ("2024-01-02", "B", 2.0), ("2024-01-02", "C", 1.0)])
    m = P.pit_top_n(uni, bars, 2, 60)
    got = pdf(B.equal_weight_index(m, bars, 2), "trade_date")
    assert np.allclose(got["ret"], [0.10, 0.15]) and got["missing"].tolist() == [0, 1]
    with pytest.raises(Exception, match="fewer than 4"):
        P.pit_top_n(uni, bars, 4, 60).collect()


def stuck_loop(top, entry, n):
    held, out = set(), []
    for i in range(1, n + 1):
        e = {s: (b, c) for j, s, b, c in entry if j == i}
        buy = {s for j, s in top if j == i and e.get(s, (False, False))[0]}
        held = buy | {s for s in held if s in e and not e[s][1]}
        out += [(i, s) for s in held]
    return set(out)


def test_unsellable_names_stay_as_in_the_loop(spark):
    rng = np.random.default_rng(1)
    n, names = 12, 40
    top = [(i, int(s)) for i in range(1, n + 1) for s in rng.choice(names, 8, replace=False)]
    entry = [(i, s, bool(rng.random() < 0.7), bool(rng.random() < 0.5)) for i in range(1, n + 1) for s in range(names) if rng.random() < 0.9]
    got = B.held_with_stuck(spark.createDataFrame(top, "idx int, symbol int"), spark.createDataFrame(entry, "idx int, symbol int, buy_tradable boolean, sell_tradable boolean"))
    assert {(r["idx"], r["symbol"]) for r in got.collect()} == stuck_loop(top, entry, n)


def test_fixed_shares_match_a_day_by_day_portfolio(spark):
    rng = np.random.default_rng(2)
    dates = days(15)
    names = list("ABCDE")
    r = pd.DataFrame(rng.normal(0, 0.02, (15, 5)), index=dates, columns=names)
    form = [dates[0], dates[6]]
    hold = {form[0]: {"A": 0.5, "B": 0.5}, form[1]: {"C": 0.2, "D": 0.8}}
    h = spark.createDataFrame([(d, s, w) for d, x in hold.items() for s, w in x.items()], "trade_date string, symbol string, weight double")
    ret = spark.createDataFrame([(d, s, float(r.loc[d, s])) for d in dates for s in names if (d, s) != (dates[3], "B")], "trade_date string, symbol string, ret double")
    h, ret = (x.withColumn("trade_date", x.trade_date.cast("date")) for x in (h, ret))
    r.loc[dates[3], "B"] = 0.0
    got = pdf(B.fixed_share_returns(h.selectExpr("'b' book", "*"), ret, ret, ["book"]), "trade_date")["ret"]
    want, value = [], None
    for d in dates[1:]:
        base = form[1] if d > form[1] else form[0]
        if d in (dates[1], dates[7]):
            value = dict(hold[base])
        before = sum(value.values())
        value = {s: v * (1 + r.loc[d, s]) for s, v in value.items()}
        want.append(sum(value.values()) / before - 1)
    assert np.allclose(got, want, atol=1e-12)


def test_turnover_lookback_needs_coverage(frame):
    d = days(60)
    rows = [(x, s, float(v * (i + 1))) for i, x in enumerate(d) for s, v in (("A", 1), ("B", 2))]
    df = frame("trade_date date, symbol string, t double", rows)
    got = pdf(R.market_lookback(df, sessions(df), frame("trade_date date", [(d[-1],)]), "t"), "symbol").iloc[0]
    assert (got.turnover_1d, got.turnover_mean_20d, got.turnover_median_60d) == (60.0, 50.5, 30.5)
    thin = frame("trade_date date, symbol string, t double", [x for i, x in enumerate(rows) if x[1] == "A" or i >= 100])
    b = pdf(R.market_lookback(thin, sessions(thin), frame("trade_date date", [(d[-1],)]), "t"), "symbol").iloc[1]
    assert b.turnover_observations_20d == 10 and math.isnan(b.turnover_mean_20d)


def test_indicator_moments_match_pandas(spark):
    from marketloom.operators.technical import indicators

    rng = np.random.default_rng(4)
    p = pd.DataFrame({"trade_date": pd.bdate_range("2020-01-01", periods=150).date, "symbol": 1, "close": 10 * np.exp(np.cumsum(rng.normal(0.001, 0.02, 150)))})
    p["high"], p["low"], p["vol"], p["open"] = p.close * 1.01, p.close * 0.99, 100.0, p.close * 0.8
    got = pdf(indicators(spark.createDataFrame(p)), "trade_date").iloc[-1]
    r = p.close.pct_change()
    assert np.allclose([got.skew_60, got.kurt_60], [r.iloc[-60:].skew(), r.iloc[-60:].kurt()])
    assert math.isclose(got.close_open, 1.25)
    assert np.allclose([got.vol_120, got.cumret_120], [r.iloc[-120:].std() * np.sqrt(252), (1 + r.iloc[-120:]).prod() - 1])


def test_macd_matches_pandas(spark):
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"trade_date": pd.bdate_range("2020-01-01", periods=120).date, "symbol": 1, "close": np.exp(np.cumsum(rng.normal(0, 0.02, 120)))})
    got = pdf(EV.macd(spark.createDataFrame(p)), "trade_date")
    e = lambda s, n: s.ewm(span=n, adjust=False, min_periods=n).mean()
    dif = e(p.close, 12) - e(p.close, 26)
    assert np.allclose(got["dif"], dif, equal_nan=True) and np.allclose(got["dea"], e(dif, 9), equal_nan=True)
    assert (got["golden"] & got["dead"]).sum() == 0 and got["golden"].sum() > 0


def test_overlapping_signals_are_skipped(spark):
    rng = np.random.default_rng(8)
    d = [x.date() for x in pd.bdate_range("2020-01-01", periods=80)]
    rows = []
    for s in range(5):
        for i in sorted(rng.choice(70, 15, replace=False)):
            j = i + 1 + int(rng.integers(1, 12))
            rows.append((s, d[i], d[i + 1], 10.0, d[j] if j < 75 else None, 11.0 if j < 75 else None))
    df = spark.createDataFrame(rows, "symbol int, signal_date date, entry_date date, entry_price double, exit_date date, exit_price double")
    got = {(r["symbol"], r["signal_date"]) for r in EV.nonoverlapping(df, []).collect()}
    want = set()
    for s in range(5):
        bound = None
        for r in [x for x in rows if x[0] == s]:
            if bound is not None and r[2] <= bound:
                continue
            if r[4] is None:
                bound = d[-1]
                continue
            want.add((s, r[1]))
            bound = r[4]
    assert got == want


def test_linear_cost(frame):
    res = frame("variant string, trade_date date, gross_return double, fee_cost double", [("a", "2024-01-02", 0.02, 0.001)])
    got = RO.linear_cost_stress(res, 10.0, [25.0], ["variant"]).first()
    assert math.isclose(got["total_return"], 0.0175)


def test_daily_reconstruction_compounds_to_the_net_period_return(frame):
    d = days(8)
    px = frame("trade_date date, symbol string, price double", [(x, s, 10.0 + (i * (1 if s == "A" else -0.5))) for i, x in enumerate(d) for s in "AB"])
    t = frame("variant string, trade_date date, symbol string, weight double, selected_leg string", [("v", d[0], "A", 0.6, "A"), ("v", d[0], "B", 0.4, "A")])
    sig = t.select("variant", "trade_date").distinct()
    res = RO.period_backtest(t, RO.signal_periods(sig, px, ["variant"]), px, 25.0, ["variant"])
    daily = RO.daily_reconstruction(res, t, px, px, ["variant"]).toPandas()
    assert math.isclose(np.prod(1 + daily["net_daily"]) - 1, res.first()["net_return"], abs_tol=1e-12)


def test_replica_rules(spark):
    rng = np.random.default_rng(42)
    p = pd.DataFrame([(x, s, 10 * math.exp(0.001 * i), 1.0) for i, x in enumerate(pd.bdate_range("2025-01-01", periods=60).date) for s in range(6)], columns=["trade_date", "symbol", "close", "amount"])
    p["close"] *= np.exp(rng.normal(0, 0.02, len(p)).cumsum() * 0.05)
    f = pdf(RP.factors(spark.createDataFrame(p.assign(industry="x"))), "symbol", "trade_date")
    one = f[f.symbol == 0].reset_index(drop=True)
    assert one.resvol.iloc[:39].isna().all() and one.resvol.iloc[45:].notna().any()
    sig = pd.DataFrame({"trade_date": pd.Timestamp("2025-01-01").date(), "symbol": range(50), "theme": ["a", "b"] * 25, "score_a": rng.random(50), "score_b": rng.random(50)})
    pos = pdf(RP.positions(spark.createDataFrame(sig), {"a": 20, "b": 20}, 10))
    assert (pos.weight <= 0.02 + 1e-15).all() and pos.leg.str.contains("A").sum() == 40 and pos.leg.str.contains("B").sum() == 10


def test_an_invalid_formation_empties_the_book(spark):
    """Weights 1/2 each: all bought (2), all sold on the empty date (2), two names bought anew (2)."""
    from marketloom.operators.portfolio import cost_adjusted_spread

    legs = [("2024-01-01", s, 0.1 if side == "long" else 0.0, side) for s, side in ((1, "long"), (2, "long"), (3, "short"), (4, "short"))]
    legs += [("2024-03-01", s, 0.2 if side == "long" else 0.1, side) for s, side in ((1, "long"), (2, "long"), (3, "short"), (4, "short"))]
    df = spark.createDataFrame(legs, "trade_date string, symbol long, next_ret double, side string")
    dates = spark.createDataFrame([("2024-01-01",), ("2024-02-01",), ("2024-03-01",)], "trade_date string")
    got = {r.trade_date: r for r in cost_adjusted_spread(df, [10.0], [0.0], dates).collect()}
    assert {d: round(r.traded, 9) for d, r in got.items()} == {"2024-01-01": 2.0, "2024-02-01": 2.0, "2024-03-01": 2.0}
    assert {d: round(r.net, 9) for d, r in got.items()} == {"2024-01-01": 0.098, "2024-02-01": -0.002, "2024-03-01": 0.098}


def test_start_sweep_is_every_path_by_itself(spark):
    """Against a loop over the starts; one book has equal returns, one a single date."""
    import datetime as dt
    import random

    r, rows, bench = random.Random(4), [], []
    dates = [dt.date(2020, 1, 31) + dt.timedelta(days=30 * i) for i in range(14)]
    for variant, n in (("a", 14), ("b", 5), ("c", 1)):
        rows += [(variant, 10, d, 8, 0.8 if i == 0 else r.random(), r.uniform(-0.2, 0.2)) for i, d in enumerate(dates[:n])]
    bench = [(d, r.uniform(-0.1, 0.1)) for d in dates]
    books = spark.createDataFrame(rows, "variant string, top_k int, trade_date date, names long, turnover double, ret double")
    got = {(x.variant, x.start): x for x in B.start_sweep(books, spark.createDataFrame(bench, "trade_date date, benchmark_ret double"), 30.0, 12).collect()}
    assert len(got) == len(rows)
    of = dict(bench)
    for v, _, start, names, turnover, ret in rows:
        first = (1 + ret) / (1 - turnover * 0.003) * (1 - names / 10 * 0.003) - 1
        path = [first] + [x[5] for x in rows if x[0] == v and x[2] > start]
        value, peak, fall, b = 1.0, 0.0, 0.0, 1.0
        for p in path:
            value *= 1 + p
            peak = max(peak, value)
            fall = min(fall, value / peak - 1)
        for x in rows:
            b *= 1 + of[x[2]] if x[0] == v and x[2] >= start else 1.0
        g = got[v, start]
        assert g.periods == len(path)
        assert abs(g.total_return - (value - 1)) < 1e-9 and abs(g.max_drawdown - fall) < 1e-9 and abs(g.benchmark_return - (b - 1)) < 1e-9
        mean = sum(path) / len(path)
        if len(path) > 1:
            sd = (sum((p - mean) ** 2 for p in path) / (len(path) - 1)) ** 0.5
            assert abs(g.sharpe - mean / sd * 12**0.5) < 1e-6
        else:
            assert g.sharpe is None
    assert B.start_sweep(books.limit(0), spark.createDataFrame(bench, "trade_date date, benchmark_ret double"), 30.0, 12).count() == 0


def test_equal_amounts_tie_in_blended_targets(frame):
    """0.1 + 0.2 is more than 0.3 in doubles; as amounts they tie and the smaller symbol is taken."""
    from marketloom.catalog.books import blended

    rows = [("2024-01-02", s, float(-s), (0.3, 0.1 + 0.2)[s == 1], "x") for s in range(11)]
    df = frame("trade_date date, symbol int, pred double, amount double, industry string", rows)
    got = {r.symbol: r.weight for r in blended(df.where("symbol < 4")).collect()}
    assert max(got, key=got.get) == 0


def test_calls_hold_many_whole_groups(spark):
    from marketloom.operators.rolling import per_group

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "333")  # batches end inside groups
    try:
        df = spark.range(300 * 40).selectExpr("nullif(id % 300, 7) as symbol", "date_add(date'2020-01-01', cast(id div 300 as int)) as trade_date")
        fn = lambda p, g: pd.DataFrame({"symbol": p.groupby(g).symbol.first().astype("Int64"), "rows": p.groupby(g).size(), "ordered": p.groupby(g).trade_date.apply(lambda d: d.is_monotonic_increasing), "groups": g[-1] + 1})
        got = per_group(df, ["symbol"], ["trade_date"], fn, {"symbol": "bigint", "rows": "bigint", "ordered": "boolean", "groups": "bigint"}).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 300 and got.symbol.isna().sum() == 1 and (got.rows == 40).all() and got.ordered.all()
    assert got.groups.max() > 1


def test_window_stats_of_batched_symbols_match_pandas():
    from marketloom.operators.technical import BARS, window_stats

    rng, parts = np.random.default_rng(5), []
    for s, n in enumerate((90, 200, 61, 3)):
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        p = pd.DataFrame({"trade_date": np.arange(n), "symbol": s, "open": close, "close": close, "high": np.round(close, 0) + 1, "low": np.round(close, 0) - 1, "vol": rng.random(n) + 1})
        p.loc[rng.random(n) < 0.05, ["vol", "high"]] = np.nan
        parts.append(p)
    p = pd.concat(parts, ignore_index=True)
    got = window_stats(p, p.symbol.to_numpy(), 1)
    for s, q in p.groupby("symbol"):
        mine = got[got.symbol == s]
        ret = q.close.pct_change()
        tail = lambda c, n: q[c].rolling(n, min_periods=1)
        assert np.allclose(mine._sd120, ret.rolling(120, min_periods=2).std(), equal_nan=True)
        assert np.allclose(mine._l18, q.close.shift(18), equal_nan=True) and list(mine[BARS].columns) == BARS
        assert np.allclose(mine._vol20, tail("vol", 20).mean(), equal_nan=True) and np.allclose(mine._sd5, tail("close", 5).std(), equal_nan=True)
        up = [int(len(w) - 1 - np.nan_to_num(w, nan=-np.inf).argmax()) for w in (q.high.to_numpy()[max(0, i - 24) : i + 1] for i in range(len(q)))]
        assert mine._up.tolist() == up
        if len(q) > 60:
            r = ret.to_numpy()[-60:]
            d = r - r.mean()
            assert np.allclose([mine._skew60.iloc[-1], mine._kurt60.iloc[-1]], [(d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3])
