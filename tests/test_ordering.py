import numpy as np
import pandas as pd
import pytest
from market_helpers import pdf

from marketloom.operators import ordering as O
from marketloom.operators import xsection as XS
from marketloom.plans.books import top_fraction


@pytest.fixture
def sample(spark):
    """One group holds most rows, a third of all rows share one value, some values are missing."""
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.8, "big", rng.choice(["a", "b"], n))
    v = np.where(rng.random(n) < 0.33, 0.0, np.round(rng.normal(size=n) * 10.0 ** rng.integers(-3, 6, n), 4))
    p = pd.DataFrame({"trade_date": g, "symbol": np.arange(n), "v": v})
    p.loc[rng.random(n) < 0.05, "v"] = np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "trade_date string, symbol long, v double")
    return p, df


def test_ranks_match_pandas(sample):
    p, df = sample
    got = pdf(O.ranked(df, ["trade_date"], "v", "r_"), "symbol")
    by = p.groupby("trade_date")["v"]
    for col, want in (("r_avg", by.rank()), ("r_min", by.rank(method="min")), ("r_n", by.transform("count"))):
        known = p["v"].notna()
        assert np.array_equal(got[col][known].astype(float), want[known].astype(float))
        assert got[col][~known].isna().all()


def test_quantiles_match_pandas(sample):
    p, df = sample
    got = pdf(O.quantiles(df, ["trade_date"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.99}), "trade_date")
    for name, q in (("lo", 0.01), ("mid", 0.5), ("hi", 0.99)):
        assert np.allclose(got[name], p.groupby("trade_date")["v"].quantile(q).sort_index().to_numpy(), rtol=1e-12, atol=1e-12)


def test_one_group_is_spread_over_bins(spark, monkeypatch):
    """Nine rows in ten on one date, a third of them with one value: no window holds much of it, and ranks and quantiles are exact."""
    monkeypatch.setattr(O, "BIN", 200)
    df = spark.range(8000).selectExpr("if(id % 10 = 0, 'a', 'big') as trade_date", "id as symbol", "if(id % 3 = 0, 0D, cast(hash(id) as double)) as v", "cast(hash(id) % 50 as double) as w")
    bins = O.binned(df, ["trade_date"], ["v", "w"]).where("trade_date = 'big'").toPandas()
    for i in (0, 1):
        between = bins[bins[f"_bin{i}"] % 2 == 0].groupby(f"_bin{i}").size()
        assert between.max() < 500 and bins[f"_bin{i}"].nunique() > 20
    got = O.ranked_many(df, ["trade_date"], {"v": "r_", "w": "s_"}).toPandas()
    for c, p in (("v", "r_"), ("w", "s_")):
        by = got.groupby("trade_date")[c]
        assert np.array_equal(got[p + "avg"], by.rank()) and np.array_equal(got[p + "min"], by.rank(method="min")) and np.array_equal(got[p + "n"], by.transform("count"))
    q = pdf(O.quantiles_many(df, ["trade_date"], {"v": {"a": 0.01, "b": 0.35}, "w": {"c": 0.5, "d": 1.0}}), "trade_date")
    for c, name, p in (("v", "a", 0.01), ("v", "b", 0.35), ("w", "c", 0.5), ("w", "d", 1.0)):
        assert np.allclose(q[name], got.groupby("trade_date")[c].quantile(p).to_numpy(), rtol=1e-12)


def test_one_exchange_of_rows_for_each_measure(spark):
    df = spark.range(100).selectExpr("id % 3 as trade_date", "id as symbol", "rand(1) as v")
    plan = O.ranked(df, ["trade_date"], "v").select("symbol", "rk_avg")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(trade_date") == 1 and plan.count("Exchange") == 1


def test_strings_are_ranked_in_their_own_order(spark, monkeypatch):
    monkeypatch.setattr(O, "BIN", 20)
    names = ["".join(chr(97 + (i * k) % 26) for k in (7, 3, 11, 5, 17, 23, 1, 9)) for i in range(300)] + ["", "é", "abc"]
    got = O.ranked(spark.createDataFrame([("d", n) for n in names], "trade_date string, v string"), ["trade_date"], "v", "r_").toPandas()
    assert np.array_equal(got["r_avg"], got["v"].map(lambda x: x.encode()).rank())


def test_qcut_matches_pandas(sample):
    p, df = sample
    got = pdf(XS.qcut(df, "v", 5, min_per_bucket=1).where("trade_date = 'a'"), "symbol")
    a = p[(p.trade_date == "a") & p.v.notna()].sort_values("symbol")
    want = pd.qcut(a["v"], 5, labels=False, duplicates="drop")
    assert bool(got["valid"].iloc[0]) == (want.nunique() == 5)
    if want.nunique() == 5:
        assert np.array_equal(got["bucket"].to_numpy(), want.to_numpy())


def test_standardised_signal_matches_pandas(sample):
    from pyspark.sql import functions as F

    p, df = sample
    p = p.assign(industry=np.where(p.symbol % 7 == 0, None, (p.symbol % 3).astype(str)))
    df = df.withColumn("industry", F.when(F.col("symbol") % 7 != 0, (F.col("symbol") % 3).cast("string")))
    got = pdf(XS.industry_zscore(df, "v", out="z"), "symbol")
    g = p.groupby("trade_date")["v"]
    x = p["v"].clip(g.transform(lambda s: s.quantile(0.01)), g.transform(lambda s: s.quantile(0.99)))
    x = x - x.groupby([p.trade_date, p.industry], dropna=False).transform("mean")
    want = (x - x.groupby(p.trade_date).transform("mean")) / x.groupby(p.trade_date).transform("std")
    assert np.allclose(got["z"].astype(float), want, equal_nan=True, atol=1e-9)


def test_residual_is_orthogonal_to_controls(spark):
    rng = np.random.default_rng(0)
    n = 200
    p = pd.DataFrame({"trade_date": ["d1", "d2"] * (n // 2), "symbol": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    p["y"] = 2 * p.a - p.b + rng.normal(size=n)
    out = pdf(XS.residualize(spark.createDataFrame(p), "y", ("a", "b"), out="e"))
    for _, g in out.groupby("trade_date"):
        assert abs(g.e.corr(g.a)) < 1e-10 and abs(g.e.corr(g.b)) < 1e-10
        assert abs(g.e.std() - 1) < 1e-10


@pytest.mark.parametrize("controls", [(), ("a",), ("a", "b", "c"), ("a", "b", "twice", "one", "c", "sum")])
def test_residuals_equal_least_squares_of_any_rank(spark, controls):
    """Collinear and constant controls, missing values, a date with too few rows and a null date."""
    rng = np.random.default_rng(7)
    n = 400
    p = pd.DataFrame({"trade_date": rng.choice(["d1", "d2", "few", ""], n, p=[0.6, 0.2, 0.03, 0.17]), "symbol": range(n), **{c: rng.normal(size=n) for c in "abc"}})
    p = p.assign(twice=2 * p.a + 5, one=3.0, y=2 * p.a - p.b + 0.3 * p.c + rng.normal(size=n))
    p["sum"] = p.a + p.b - 1
    p.loc[rng.random(n) < 0.05, "y"] = np.nan
    p.loc[rng.random(n) < 0.05, "c"] = np.nan
    p["trade_date"] = p.trade_date.astype(object).where(p.trade_date != "", None)
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "trade_date string, symbol long, a double, b double, c double, twice double, one double, y double, sum double")
    got = pdf(XS.residualize(df, "y", controls, out="e")).sort_values("symbol")
    want = pd.Series(np.nan, index=p.index)
    for _, g in p.groupby("trade_date", dropna=False):
        g = g.dropna(subset=["y", *controls])
        if len(g) >= 30:
            x = np.column_stack([np.ones(len(g)), *[g[c] for c in controls]])
            e = g.y - x @ np.linalg.lstsq(x, g.y, rcond=None)[0]
            want[g.index] = (e - e.mean()) / e.std()
    assert want.notna().sum() > 200
    assert np.allclose(got["e"].astype(float).to_numpy(), want.to_numpy(), atol=1e-8, equal_nan=True)


def test_top_fraction_ties_by_symbol(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"trade_date": "d", "symbol": range(300), "industry": rng.choice(["x", "y"], 300, p=[0.9, 0.1]), "s": rng.integers(0, 6, 300).astype(float)})
    got = set(pdf(top_fraction(spark.createDataFrame(p), "s", 0.2, "industry"))["symbol"])
    want = set()
    for _, g in p.groupby("industry"):
        want |= set(g.sort_values(["s", "symbol"], ascending=[False, True]).head(max(1, int(len(g) * 0.2)))["symbol"])
    assert got == want


@pytest.mark.parametrize("width", [0.01, 1e-9])
def test_bracketed_quantiles(spark, monkeypatch, width):
    """Large groups by brackets: ties, nulls, a null key, a group without values; brackets too narrow take the whole group."""
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(O, "SKETCHED", 500)
    monkeypatch.setattr(O, "WIDTH", width)
    seen = []
    plain = O.bracketed_quantiles
    monkeypatch.setattr(O, "bracketed_quantiles", lambda *a: seen.append(1) or plain(*a))
    r = np.random.default_rng(3)
    rows = [(g, float(a) if i % 7 else None, None if g == "d" else float(b)) for g in ("a", None, "d") for i, (a, b) in enumerate(zip(r.normal(size=2000), r.integers(0, 4, 2000), strict=True))]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    wanted = {"a": {"lo": 0.01, "mid": 0.5, "hi": 0.99}, "b": {"b_min": 0.0, "b_q": 1 / 3, "b_max": 1.0}}
    got = {x.g: x for x in O.quantiles_many(df, ["g"], wanted).collect()}
    assert seen and got.keys() == {"a", None, "d"}
    for g, x in got.items():
        for i, v in enumerate(wanted, 1):
            have = [t[i] for t in rows if t[0] == g and t[i] is not None]
            for name, p in wanted[v].items():
                assert x[name] is None if not have else abs(x[name] - np.quantile(have, p)) < 1e-12
        assert x.n == sum(t[0] == g and t[1] is not None for t in rows)


def test_ranks_and_group_sizes_share_one_sort(sample):
    _, df = sample
    plan = O.ranked(df, ["trade_date"], "v", "r_")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_one_sketch_for_all_places_of_a_measure(sample, monkeypatch):
    p, df = sample
    asked, sketch = [], O.F.percentile_approx
    monkeypatch.setattr(O.F, "percentile_approx", lambda c, e, n: (asked.append(c), sketch(c, e, n))[1])
    got = pdf(O.bracketed_quantiles(df.withColumn("u", -O.F.col("v")), ["trade_date"], {"v": {"lo": 0.2, "hi": 0.8}, "u": {"mid": 0.5}}, "n"), "trade_date")
    by = p.groupby("trade_date")["v"]
    assert len(asked) == 2
    assert np.allclose(got["lo"], by.quantile(0.2)) and np.allclose(got["hi"], by.quantile(0.8)) and np.allclose(got["mid"], -by.quantile(0.5))


def test_statistics_of_groups_are_written_before_the_join(sample, monkeypatch):
    _, df = sample
    written, staged = [], XS.staged
    monkeypatch.setattr(XS, "staged", lambda d: (written.append(d.columns), staged(d))[1])
    XS.zscore(df, "v", out="z").count()
    assert written == [["trade_date", "_m", "_s"]]
