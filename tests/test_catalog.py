"""Registered queries against their SQL, and plan shape of the main scans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from marketloom.catalog import load

DIR = "/root/testdata/sf0.001"
SAMPLE = ["scan_partition_window", "join_asof_pit_fields", "join_interval_industry_pit", "qcut_bucket", "bucket_ic", "cost_stress", "minute_benchmark_daily",
          "set_turnover", "rolling_odds", "ols_attribution", "promotion_gate", "walk_forward", "style_factor_panel", "period_backtest", "nonoverlap_exits"]
NAMES = list(load()[0]) if os.environ.get("ALL_QUERIES") else SAMPLE


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6 or (a != a and b != b)
    return a == b or (a is None and b != b) or (b is None and a != a)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(load()[0]) == set(load()[1])


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name not in entry.oracle_sql():
        return
    rel = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    order = [df.columns.index(c) for c in cols]
    key = lambda t: tuple((x is None, str(type(x)), str(x)) for x in t)
    mine = sorted((tuple(r[i] for i in order) for r in got), key=key)
    theirs = sorted(rel.fetchall(), key=key)
    assert len(mine) == len(theirs)
    assert all(all(close(x, y) for x, y in zip(a, b)) for a, b in zip(mine, theirs))


def test_entry_runs(spark):
    assert "long_short" in entry.entry(spark).columns and entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folder_scan_prunes_partitions_and_columns(spark, tmp_path):
    from marketloom import fixtures as V
    from marketloom.sources import sinks, tables

    sinks.by_date_folders(V.bars_daily(spark, DIR), str(tmp_path / "bars"))
    text = plan(tables.partition_window(spark, str(tmp_path / "bars"), ["close"], "2024-01-05", "2024-01-10"))
    assert "PartitionFilters: [" in text and "20240105" in text
    assert "ReadSchema: struct<symbol:bigint,close:double>" in text


def test_top_k_is_limited_before_the_shuffle(spark):
    from marketloom import fixtures as V
    from marketloom.operators.execution import top_rows

    text = plan(top_rows(V.panel_part(spark, DIR), "amount", 50))
    assert "WindowGroupLimit" in text


def test_no_cross_joins_in_scenario_queries(spark):
    for name in ("daily_portfolio_returns", "cost_stress", "combo_search", "join_concept_exposure"):
        text = plan(entry.queries()[name](spark, DIR))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_shuffled_input_gives_the_same_result(spark):
    from marketloom import fixtures as V
    from marketloom.operators import xsection as XS
    from pyspark.sql import functions as F

    p = V.panel_supplier(spark, DIR)
    a = XS.pct_rank(p, "amount", out="r").select("trade_date", "symbol", "r")
    b = XS.pct_rank(p.orderBy(F.rand(1)), "amount", out="r").select("trade_date", "symbol", "r")
    assert a.exceptAll(b).count() == 0


def test_bucket_groups_travel_as_one_number(spark, monkeypatch):
    from marketloom.catalog import xsection as C

    seen, ic = [], C.XS.daily_ic
    monkeypatch.setattr(C.XS, "daily_ic", lambda df, *a: (seen.append(dict(df.dtypes)), ic(df, *a))[1])
    C.bucket_ic(spark, DIR)
    assert seen == [{"trade_date": "date", "f_value": "double", "next_ret": "double", "g": "tinyint"}]


def test_replica_frames_are_asked_for_once(spark):
    from marketloom.catalog import jobs

    plan = jobs.replica_factors(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(f"{f}(") for f in ("var_samp", "stddev_samp")) == 4  # the covariance is in the first


def test_symbol_files_and_their_manifest(spark, tmp_path):
    from marketloom.sources import sinks

    rows = [(s, d, float(i)) for i, (s, d) in enumerate((s, d) for d in ("2024-01-03", "2024-01-02") for s in ("a", "b c", None))]
    df = spark.createDataFrame(rows, "symbol string, trade_date string, close double").selectExpr("symbol", "date(trade_date) trade_date", "close")
    written = sinks.by_symbol_csv(df, f"file://{tmp_path}/csv")
    assert {(r.symbol, r.rows) for r in written.collect()} == {("a", 2), ("b c", 2), (None, 2)}
    assert (tmp_path / "csv" / "symbol=a").is_dir() and not [f for f in (tmp_path / "csv").rglob("*") if f.is_file() and f.suffix != ".csv"]
    back = sinks.read_symbol_csv(written, "trade_date date, close double").collect()
    assert sorted((str(r.symbol), str(r.trade_date), r.close) for r in back) == sorted((str(s), d, c) for s, d, c in rows)
    assert next((tmp_path / "csv" / "symbol=a").iterdir()).read_text().splitlines()[0].replace('"', "") == "trade_date,close"


def test_keys_are_counted_and_checked_in_parts(spark, monkeypatch):
    from marketloom.operators import keys

    monkeypatch.setattr(keys, "KEYS_HELD", 100)
    assert keys.count_unique(spark.range(1000), ["id"]) == 1000
    assert keys.count_unique(spark.range(0), ["id"]) == 0
    with pytest.raises(keys.DuplicateKeyError):
        keys.count_unique(spark.range(1000).selectExpr("id % 999 as id"), ["id"])


def test_constituent_features_of_equal_medians(spark, tmp_path):
    """A date whose concepts share one median has no IC; the other features and dates keep theirs."""
    lines, parts = tmp_path / "lineitem.parquet", tmp_path / "part.parquet"
    con = duckdb.connect()
    con.execute(f"copy (select p % 60 as l_partkey, make_timestamp(2024, 1 + m, 5, 0, 0, 0) as l_shipdate, case when m = 1 then 1.0::double + p % 6 else 2.0::double end as l_quantity, (100.0::double + p * p % 17 + m * (p % 6) * (p % 5)) as l_extendedprice, 0.05::double as l_discount from range(60) a(p), range(4) b(m)) to '{lines}' (format parquet)")
    con.execute(f"copy (select p as p_partkey, 'b' || (p % 6) as p_brand from range(60) a(p)) to '{parts}' (format parquet)")
    con.execute(f"create view lineitem as select * from '{lines}'; create view part as select * from '{parts}'")
    got = {r.factor: r for r in entry.queries()["constituent_feature_ic"](spark, str(tmp_path)).collect()}
    want = {r[0]: r[1:] for r in con.execute(entry.oracle_sql()["constituent_feature_ic"]).fetchall()}
    for name in ("median_amount", "dispersion"):
        assert all(close(a, b) for a, b in zip((got[name].days, got[name].rank_ic_mean, got[name].pearson_ic_mean), want[name]))
    month = con.execute("select corr(q, r) from (select l_partkey % 6 as b, median(l_quantity) filter (month(l_shipdate) = 2) as q, avg(l_extendedprice / l_quantity) filter (month(l_shipdate) = 3) / avg(l_extendedprice / l_quantity) filter (month(l_shipdate) = 2) as r from lineitem group by 1)").fetchone()[0]
    assert got["median_turnover"].days == 3 and close(got["median_turnover"].pearson_ic_mean, round(month, 6))
