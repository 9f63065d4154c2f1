import datetime as dt
import itertools
import math
import random

import pytest

from marketloom.plans import combos as C

SIGNS = {"a": 1.0, "b": -1.0, "c": 1.0, "d": 1.0}
PANEL = "trade_date date, symbol string, a double, b double, c double, d double"
RET = "trade_date date, symbol string, ret double"


def loop(panel, returns, calendar, combo, k, bps):
    """One book, day by day."""
    dates, daily, held = sorted({r[0] for r in panel}), {}, set()
    for i, date in enumerate(dates):
        entry = min((x for x in calendar if x > date), default=None)
        if entry is None:
            break
        until = dates[i + 1] if i + 1 < len(dates) else max(calendar)
        score = {r[1]: sum(SIGNS[f] * (r[2 + "abcd".index(f)] or 0.0) for f in combo) for r in panel if r[0] == date}
        top = set(sorted(score, key=lambda s: (-score[s], s))[:k])
        moved, held = len(top ^ held), top
        window = [r for r in returns if r[1] in top and entry < r[0] <= until and r[2] is not None]
        if not window:
            continue
        for x in {r[0] for r in window}:
            day = [r[2] for r in window if r[0] == x]
            daily[x] = sum(day) / len(day)
        daily[entry] = -moved / k * bps / 1e4
    return daily


@pytest.fixture(scope="module")
def market():
    r = random.Random(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(150) if i % 7 not in (3, 4)]
    forms = [dt.date(2020, m, 1) for m in (1, 2, 3, 4)] + [days[-1]]
    names = [f"s{i}" for i in range(30)]
    panel = [(f, s, *[None if r.random() < 0.1 else float(r.randint(-2, 2)) for _ in "abcd"]) for f in forms for s in names if r.random() < 0.9]
    returns = [(d, s, None if r.random() < 0.1 else r.uniform(-0.1, 0.1)) for d in days for s in names if r.random() < 0.6 and not (dt.date(2020, 2, 1) < d < dt.date(2020, 3, 2))]
    return panel, returns, days


@pytest.mark.parametrize("block", [7, 10_000])
def test_every_combination_is_its_own_loop(spark, monkeypatch, market, block):
    """Integer factors tie often; February has no returns; the last formation has no session after it; small blocks split each date."""
    monkeypatch.setattr(C, "BLOCK", block)
    panel, returns, days = market
    combos = C.combination_names(list(SIGNS), (2, 3))
    assert len(combos) == 10 and combos[0] == ("a", "b") and len(set(combos)) == 10
    df = spark.createDataFrame([(*r, 1) for r in panel], PANEL + ", combo int")
    cal = spark.createDataFrame([(d,) for d in days], "trade_date date")
    got = {}
    for x in C.combination_daily(df, spark.createDataFrame(returns, RET), cal, SIGNS, combos, 5, 30.0).collect():
        assert (x.combo, x.trade_date) not in got
        got[x.combo, x.trade_date] = x.ret
    want = {(i, d): v for i, c in enumerate(combos) for d, v in loop(panel, returns, days, c, 5, 30.0).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_statistics_of_a_path(spark):
    r = random.Random(6)
    months = [dt.date(2020 + i // 12, i % 12 + 1, 5) for i in range(12) if i != 4]  # one calendar month has no day
    daily = [(0, d + dt.timedelta(days=i), r.uniform(-0.05, 0.05)) for d in months for i in range(3)] + [(1, months[0], 0.1), (1, months[1], 0.1)]
    got = {x.variant: x for x in C.combination_search(spark.createDataFrame(daily, "combo int, trade_date date, ret double"), [("a", "b"), ("a", "b", "c")], 3).collect()}
    x = [v for c, _, v in daily if c == 0]
    growth = [math.prod([1 + v for c, d, v in daily if c == 0 and d.month == m]) for m in range(1, 13)]
    windows = [math.prod(growth[i : i + 3]) - 1 for i in range(10)]
    lost = sum(w < 0 for w in windows)
    mean = sum(x) / len(x)
    sd = (sum((v - mean) ** 2 for v in x) / (len(x) - 1)) ** 0.5
    one, two = got["a+b"], got["a+b+c"]
    assert (one.n_factors, one.days, two.n_factors, two.days) == (2, len(x), 3, 2)
    assert math.isclose(one.sharpe, mean / sd * 252**0.5) and math.isclose(one.ann, math.prod(1 + v for v in x) ** (252 / len(x)) - 1)
    assert lost and math.isclose(one.odds, (10 - lost) / lost) and two.odds is None and two.sharpe is None


def test_growth_outside_the_range_of_doubles(spark):
    """0.1 ** 400 and 10 ** 400 are no doubles; a day that loses everything has no growth."""
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    daily = [(c, d, r) for c, r in ((0, -0.9), (1, 9.0), (2, 0.0)) for d in days] + [(2, days[-1] + dt.timedelta(days=1), -1.0)]
    got = {x.variant: x for x in C.combination_search(spark.createDataFrame(daily, "combo int, trade_date date, ret double"), list(itertools.combinations("abc", 2))).collect()}
    assert math.isclose(got["a+b"].log_ann, -252 * math.log(10)) and math.isclose(got["a+c"].log_ann, 252 * math.log(10))
    assert got["b+c"].log_ann is None and got["b+c"].ann is None


def test_empty_tables(spark, market):
    combos = list(itertools.combinations("abcd", 2))
    empty, none = spark.createDataFrame([], PANEL), spark.createDataFrame([], RET)
    panel = spark.createDataFrame(market[0], PANEL)
    returns = spark.createDataFrame(market[1], RET)
    assert C.combination_daily(empty, returns, returns, SIGNS, combos, 5, 30.0).count() == 0
    assert C.combination_daily(panel, none, none, SIGNS, combos, 5, 30.0).count() == 0
