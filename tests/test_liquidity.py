"""The low-turnover diagnostics against a loop over definitions, dates and names."""

import numpy as np
import pandas as pd
import pytest

from market_helpers import days, pdf
from marketloom.plans import books as B
from marketloom.plans import style as ST

NAMES, DAYS, FORMED, COVERAGE = 70, 44, (9, 24, 34), 0.5


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(5)
    rows = []
    for s in range(NAMES):
        close = 10.0 + s % 9
        for t, d in enumerate(days(DAYS)):
            close *= 1.0 + rng.normal(0.0005, 0.02)
            if rng.random() < 0.93:
                rows.append((d, s, f"i{s % 4}", close, 0.0 if rng.random() < 0.01 else 100.0, close * (50 + s), round(rng.gamma(2.0 + s % 3, 0.4), 2)))
    p = pd.DataFrame(rows, columns=["trade_date", "symbol", "industry", "close", "amount", "total_mv", "turnover_rate"])
    p["ret"] = p.groupby("symbol")["close"].pct_change().fillna(0.0)
    return p


def standard(p, c):
    g = p.groupby("trade_date")[c]
    x = p[c].clip(g.transform(lambda v: v.quantile(0.01)), g.transform(lambda v: v.quantile(0.99)))
    e = x - x.groupby([p["trade_date"], p["industry"]]).transform("mean")
    d = e.groupby(p["trade_date"])
    return (e - d.transform("mean")) / d.transform("std")


def loop(bars):
    """(scores by variant, legs by variant) without Spark."""
    cal, dates = days(DAYS), [days(DAYS)[i] for i in FORMED]
    p = bars[bars["amount"] > 0].copy()
    p["r"] = p.groupby("symbol")["close"].pct_change()
    p["lowvol_score"] = -p.groupby("symbol")["r"].transform(lambda v: v.rolling(21, min_periods=10).std().shift(1))
    p["size_score"] = np.log(p["total_mv"] + 1)
    p = p[p["trade_date"].isin(dates)].copy()
    p["size_score"], p["lowvol_score"] = standard(p, "size_score"), standard(p, "lowvol_score")
    t = bars.assign(turnover_rate=bars["turnover_rate"].clip(0.01, 100))
    for d in dates:
        at = p["trade_date"] == d
        past = t[t["trade_date"] <= d]
        p.loc[at, "turnover_1d"] = p[at]["symbol"].map(past[past["trade_date"] == d].set_index("symbol")["turnover_rate"])
        for n in (20, 60):
            g = past[past["trade_date"].isin(cal[max(0, cal.index(d) - n + 1):])].groupby("symbol")["turnover_rate"]
            for name in ("mean", "median"):
                p.loc[at, f"turnover_{name}_{n}d"] = p[at]["symbol"].map(g.agg(name).where(g.count() >= n * COVERAGE))
    scores, legs = {}, {}
    for v in ST.DEFINITIONS:
        p["plain"] = standard(p.assign(x=-p[v].round(10)), "x")
        p["neutral"] = np.nan
        for d in dates:
            ok = (p["trade_date"] == d) & p[["plain", "size_score", "lowvol_score"]].notna().all(axis=1)
            if ok.sum() >= 30:
                x = np.column_stack([np.ones(ok.sum()), p[ok]["size_score"], p[ok]["lowvol_score"]])
                u = p[ok]["plain"] - x @ np.linalg.lstsq(x, p[ok]["plain"], rcond=None)[0]
                p.loc[ok, "neutral"] = (u - u.mean()) / u.std()
        for name, c in ((v, "plain"), (f"{v}_neutral", "neutral")):
            scores[name] = p[["trade_date", "symbol", "size_score", "lowvol_score"]].assign(score=p[c].round(9))
    ret = bars.pivot(index="trade_date", columns="symbol", values="ret").reindex(cal).fillna(0.0)
    for name, s in scores.items():
        parts = []
        for d, end in zip(dates, [*dates[1:], cal[-1]]):
            x = s[(s["trade_date"] == d) & s["score"].notna()].set_index("symbol")["score"]
            if len(x) < 50:
                continue
            bucket = sum((x > x.quantile(q)).astype(int) for q in (0.2, 0.4, 0.6, 0.8))
            grown = (1 + ret.loc[(ret.index > d) & (ret.index <= end)]).cumprod()
            value = pd.DataFrame({**{f"q{i + 1}": grown[bucket.index[bucket == i]].mean(axis=1) for i in range(5)}, "universe": grown[x.index].mean(axis=1)})
            parts.append(value / value.shift(1).fillna(1.0) - 1.0)
        legs[name] = pd.concat(parts) if parts else None
    return scores, legs


def annual(r):
    return ((1 + r).prod() ** (252 / len(r)) - 1) * 100


def test_five_definitions_plain_and_neutral(spark, bars):
    df = spark.createDataFrame(bars).selectExpr("date(trade_date) trade_date", "* except (trade_date)")
    formation = spark.createDataFrame([(days(DAYS)[i],) for i in FORMED], "trade_date string").selectExpr("date(trade_date) trade_date")
    got = ST.diagnostics_job(df, formation, COVERAGE).toPandas().set_index("variant")
    scores, legs = loop(bars)
    assert set(got.index) == set(scores) and len(scores) == 10
    assert legs["turnover_mean_60d_neutral"] is not None and len(legs["turnover_mean_60d"]) < len(legs["turnover_1d"]), "the data has long and short histories"
    for v, s in scores.items():
        row, x = got.loc[v], legs[v]
        assert row["neutralized"] == v.endswith("_neutral") and row["formation_observations"] == s["score"].notna().sum(), v
        assert row["formation_coverage"] == pytest.approx(s["score"].notna().mean())
        for c, name in (("size_score", "mean_size_correlation"), ("lowvol_score", "mean_lowvol_correlation")):
            assert row[name] == pytest.approx(np.nanmean([g["score"].corr(g[c]) for _, g in s.groupby("trade_date")]), abs=1e-7), (v, name)
        spread = x["q5"] - x["q1"]
        assert row["days"] == len(x)
        q = [annual(x[f"q{i}"]) for i in range(1, 6)]
        assert [row[f"q{i}_annual"] for i in range(1, 6)] == pytest.approx(q)
        assert row["improving_steps"] == (np.diff(q) > 0).sum() and row["monotonicity"] == pytest.approx(pd.Series(q).rank().corr(pd.Series(range(5))))
        assert row["long_short_annual"] == pytest.approx(annual(spread)) and row["long_excess_annual"] == pytest.approx(annual(x["q5"] - x["universe"]))
        assert row["q3_volatility"] == pytest.approx(x["q3"].std() * np.sqrt(252) * 100)
        base = legs["turnover_1d"]["q5"] - legs["turnover_1d"]["q1"]
        assert row["baseline_return_correlation"] == pytest.approx(spread.corr(base))
        by_year = (1 + spread).groupby(spread.index.str[:4]).prod() - 1
        assert row["positive_year_ratio"] == pytest.approx((by_year > 0).mean())


def test_shared_books_equal_single_ones(spark, bars):
    df = spark.createDataFrame(bars).selectExpr("date(trade_date) trade_date", "* except (trade_date)")
    dates = [days(DAYS)[i] for i in FORMED]
    formation = spark.createDataFrame([(d,) for d in dates], "trade_date string").selectExpr("date(trade_date) trade_date")
    b = df.join(formation, "trade_date", "left_semi").selectExpr("trade_date", "symbol", "explode(array(struct('a' as book, symbol % 5 as bucket), struct('b' as book, symbol div 14 as bucket))) as e", "true as valid").select("trade_date", "symbol", "e.*", "valid")
    got = pdf(B.shared_quantile_portfolios(b, df, formation, ["book"]), "book", "leg", "trade_date")
    for book in ("a", "b"):
        want = pdf(B.quantile_portfolios(b.where(f"book = '{book}'"), df, df), "leg", "trade_date")
        mine = got[got["book"] == book].reset_index(drop=True)
        assert mine["leg"].tolist() == want["leg"].tolist() and np.allclose(mine["ret"], want["ret"], atol=1e-12)
