"""Scans, readers and writers, over layouts that Spark derives from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as V
from ..fixtures import add_view
from ..functions.expr import compact_date
from ..operators.calendar import month_ends
from ..operators.keys import assert_unique, count_unique
from ..session import shared_dir, staged
from ..sources import documents as D
from ..sources import sinks
from ..sources import tables as S
from .registry import query, r, rounded

KEYS = ["trade_date", "symbol"]


def fresh(spark) -> str:
    return f"{shared_dir(spark)}/layouts/{uuid.uuid4().hex}"


def dated_folders(spark, d) -> str:
    """Daily bars as date folders, a tenth of the rows written twice with another close."""
    path = fresh(spark)
    b = V.bars_daily(spark, d).select(*KEYS, "close", "amount", F.lit(0).alias("copy"))
    sinks.by_date_folders(b.unionByName(b.where("symbol % 10 = 3").withColumns(
        {"close": F.col("close") + 1.0, "copy": F.lit(1)})), path)
    return path


def spread_folders(spark, d) -> str:
    """Daily bars as date folders, every third calendar day, so that the month of bars spans three."""
    path = fresh(spark)
    day = F.date_add(F.lit("2024-01-01").cast("date"), 3 * F.datediff("trade_date", F.lit("2024-01-01").cast("date")))
    sinks.by_date_folders(V.bars_daily(spark, d).select(day.alias("trade_date"), "symbol", "close", "amount"), path)
    return path


add_view("spread_daily", ("bars_daily",), "SELECT CAST(DATE '2024-01-01' + 3 * (trade_date - DATE '2024-01-01')::INT AS DATE) AS trade_date, symbol, close, amount FROM bars_daily")


@query("scan_partition_window", """
    SELECT trade_date, symbol, round(close, 6) AS close, round(amount, 2) AS amount FROM bars_daily
    WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""", "bars_daily")
def scan_partition_window(spark, d):
    df = S.partition_window(spark, dated_folders(spark, d), ["close", "amount"], "2024-01-05", "2024-01-20", ["copy"])
    return df.select(*KEYS, r("close").alias("close"), r("amount", 2).alias("amount"))


@query("recover_partition_column", "SELECT trade_date, count(*) AS rows FROM (SELECT trade_date FROM bars_daily UNION ALL SELECT trade_date FROM bars_daily WHERE symbol % 10 = 3) GROUP BY 1", "bars_daily")
def recover_partition_column(spark, d):
    return S.with_folder_date(spark, dated_folders(spark, d)).groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"))


@query("scan_month_end_partitions", """
    WITH e AS (SELECT max(trade_date) AS trade_date FROM spread_daily GROUP BY date_trunc('month', trade_date))
    SELECT trade_date, symbol, round(close, 8) AS close FROM spread_daily
    WHERE trade_date IN (SELECT trade_date FROM e WHERE date_trunc('month', trade_date) <> DATE '2024-03-01')""", "spread_daily")
def scan_month_end_partitions(spark, d):
    """March is running on the 30th, so its last folder is no month end."""
    return S.month_end_folders(spark, spread_folders(spark, d), "2024-03-30").select(*KEYS, r("close", 8).alias("close"))


@query("scan_symbol_files", """
    SELECT trade_date, symbol, round(close + CASE WHEN symbol % 10 = 3 THEN 1 ELSE 0 END, 6) AS close FROM bars_daily
    WHERE trade_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'""", "bars_daily")
def scan_symbol_files(spark, d):
    path = fresh(spark)
    b = V.bars_daily(spark, d).select(*KEYS, "close", F.lit(0).alias("copy"))
    b.unionByName(b.where("symbol % 10 = 3").withColumns({"close": F.col("close") + 1.0, "copy": F.lit(1)})).write.parquet(path)
    return S.symbol_files(spark, path, "2024-01-03", "2024-01-25", ["copy"]).select(*KEYS, r("close").alias("close"))


@query("resolve_latest_vintage", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def resolve_latest_vintage(spark, d):
    path = fresh(spark)
    V.table(spark, d, "orders").withColumn("vintage", F.year("o_orderdate")).hint("rebalance", "vintage").write.partitionBy("vintage").parquet(path)
    return S.latest_vintage(spark, path).select("o_orderkey", "o_totalprice")


@query("scan_latest_announcement", """
    SELECT symbol, end_date, ann_date, roe FROM (
      SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS end_date,
             CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS ann_date, o_totalprice AS roe,
             row_number() OVER (PARTITION BY o_custkey, date_trunc('quarter', o_orderdate)
                 ORDER BY (CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) DESC NULLS FIRST, o_totalprice DESC) AS k
      FROM orders WHERE o_orderstatus = 'P' OR o_orderdate <= DATE '2000-06-30') WHERE k = 1""")
def scan_latest_announcement(spark, d):
    o = V.table(spark, d, "orders").select(
        F.concat(F.col("o_custkey").cast("string"), F.lit(".SZ")).alias("symbol"),
        F.date_trunc("quarter", "o_orderdate").cast("date").alias("end_date"),
        F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("ann_date"), F.col("o_totalprice").alias("roe"))
    return S.latest_announcement(o, "2000-06-30")


@query("scan_moneyflow", "SELECT trade_date, symbol, round(amount, 2) AS amount, n FROM bars_daily WHERE trade_date >= DATE '2024-01-10'", "bars_daily")
def scan_moneyflow(spark, d):
    df = S.present_columns(V.bars_daily(spark, d), ["net_amount", "amount", "n"], "2024-01-10")
    return rounded(df, "amount", digits=2)


@query("scan_holder_structure", """
    SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS trade_date, max(o_totalprice) AS top10 FROM orders GROUP BY 1, 2""")
def scan_holder_structure(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("trade_date"),
                                           F.col("o_totalprice").alias("top10"), (-F.col("o_totalprice")).alias("k"))
    return S.present_columns(o, ["top10", "institution", "k"], order=["k"]).drop("k")


@query("scan_limit_events", """
    SELECT CAST(ts AS DATE) AS trade_date, user_id AS symbol, bool_or(event_type = 'purchase') AS is_limit_up,
           bool_or(event_type = 'error') AS is_limit_down FROM events GROUP BY 1, 2""")
def scan_limit_events(spark, d):
    e = V.table(spark, d, "events").select(F.to_date("ts").alias("trade_date"), F.col("user_id").alias("symbol"),
                                           F.upper("event_type").alias("kind"), F.lit(None).cast("string").alias("note"))
    return S.limit_events(e, ["kind", "note"], "purchase", "error")


@query("scan_margin_market", """
    WITH m AS (SELECT CAST(ts AS DATE) AS trade_date, sum(value) AS rzye, sum(value * 2) AS rzrqye FROM events GROUP BY 1)
    SELECT trade_date, round(rzye, 2) AS rzye, round(rzrqye, 2) AS rzrqye, round(rzye / lag(rzye) OVER w - 1, 6) AS rzye_yoy,
           round(rzrqye / lag(rzrqye) OVER w - 1, 6) AS rzrqye_yoy FROM m WINDOW w AS (ORDER BY trade_date)""")
def scan_margin_market(spark, d):
    e = V.table(spark, d, "events").select(F.to_date("ts").alias("trade_date"), "event_type", F.col("value").alias("rzye"),
                                           (F.col("value") * 2).alias("rzrqye"))
    m = S.market_balances(e, ["rzye", "rzrqye"], ["rzye", "rzrqye"])
    return rounded(rounded(m, "rzye", "rzrqye", digits=2), "rzye_yoy", "rzrqye_yoy")


@query("scan_industry_membership", """
    SELECT s_suppkey AS symbol, DATE '1995-01-01' AS in_date, CAST(NULL AS DATE) AS out_date,
           CASE WHEN n_regionkey < 3 THEN r_name ELSE n_name END AS industry_l1
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def scan_industry_membership(spark, d):
    n = V.table(spark, d, "nation")
    m = V.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("symbol"), F.lit("1995-01-01").cast("date").alias("in_date"),
        F.lit(None).cast("date").alias("out_date"), F.col("n_regionkey").alias("index_code"), F.col("n_name").alias("own_name"))
    names = V.table(spark, d, "region").select(F.col("r_regionkey").alias("index_code"), F.col("r_name").alias("industry_name"),
                                               F.when(F.col("r_regionkey") < 3, "L1").otherwise("L2").alias("level"))
    return S.industry_membership(m, names)


@query("scan_static_class_map", "SELECT DISTINCT l_partkey AS symbol, 'concept' AS class FROM lineitem")
def scan_static_class_map(spark, d):
    return V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol")).distinct().withColumn("class", F.lit("concept"))


@query("scan_formation_semijoin", """
    WITH e AS (SELECT max(trade_date) AS t FROM spread_daily GROUP BY date_trunc('month', trade_date))
    SELECT trade_date, symbol, round(amount, 2) AS amount FROM spread_daily WHERE trade_date IN (SELECT t FROM e)""", "spread_daily")
def scan_formation_semijoin(spark, d):
    return S.month_end_folders(spark, spread_folders(spark, d)).select(*KEYS, r("amount", 2).alias("amount"))


@query("scan_positive_activity", """
    WITH e AS (SELECT max(trade_date) AS t FROM ship_daily GROUP BY date_trunc('month', trade_date))
    SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date, l_suppkey AS symbol FROM lineitem
    WHERE CAST(l_shipdate AS DATE) IN (SELECT t FROM e) AND (l_discount > 0.05 OR l_tax > 0.04)""", "ship_daily")
def scan_positive_activity(spark, d):
    li = V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"), F.col("l_suppkey").alias("symbol"),
                                              (F.col("l_discount") - 0.05).alias("a"), (F.col("l_tax") - 0.04).alias("b"))
    li = li.withColumns({"a": r("a", 4).cast("string"), "b": F.when(r("b", 4) > 0, r("b", 4).cast("string")).otherwise(F.lit("n/a"))})
    return S.positive_activity(li, month_ends(li), ["a", "b"])


@query("scan_early_overlay_sources", """
    SELECT 'bars' AS source, count(*) AS rows FROM bars_daily UNION ALL SELECT 'shipments', count(*) FROM ship_daily
    UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem""", "bars_daily ship_daily")
def scan_early_overlay_sources(spark, d):
    parts = {"bars": (V.bars_daily(spark, d), KEYS), "shipments": (V.ship_daily(spark, d), KEYS),
             "orders": (V.table(spark, d, "orders"), ["o_orderkey"]),
             "lines": (V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])}
    most = {name: V.table(spark, d, raw).count() for name, raw in (("bars", "events"), ("shipments", "lineitem"))}
    return spark.createDataFrame([(name, count_unique(df, k, name, most.get(name))) for name, (df, k) in parts.items()], "source string, rows long")


@query("scan_late_clean_universe", "SELECT trade_date, symbol FROM bars_daily WHERE n > 1", "bars_daily")
def scan_late_clean_universe(spark, d):
    path = fresh(spark)
    V.bars_daily(spark, d).select(*KEYS, (F.col("n") > 1).cast("int").alias("selected")).write.option("header", True).csv(path)
    return assert_unique(S.selected_universe(spark, path), KEYS, "universe")


@query("scan_instruments", """
    SELECT o_custkey AS symbol, CAST(min(o_orderdate) AS DATE) AS list_date,
           CASE WHEN max(o_orderdate) < DATE '2001-01-01' THEN CAST(max(o_orderdate) AS DATE) END AS delist_date FROM orders GROUP BY 1""")
def scan_instruments(spark, d):
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol")).agg(
        F.date_format(F.min("o_orderdate"), "yyyyMMdd").alias("list_date"),
        F.when(F.max("o_orderdate") < F.lit("2001-01-01"), F.date_format(F.max("o_orderdate"), "yyyyMMdd")).otherwise("").alias("delist_date"))
    return assert_unique(S.instruments(o), ["symbol"], "instruments")


@query("scan_pit_events", """
    SELECT o_custkey AS symbol, strftime(o_orderdate, '%Y%m%d') AS available_date, o_totalprice AS roe, CAST(NULL AS DOUBLE) AS or_yoy FROM orders""")
def scan_pit_events(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.regexp_replace(
        F.date_format("o_orderdate", "yyyy-MM-dd"), "-", "").alias("available_date"), F.col("o_totalprice").alias("roe"))
    return S.tolerant_columns(o, {"symbol": "bigint", "available_date": "string", "roe": "double", "or_yoy": "double"})


@query("scan_minute_day", """
    SELECT symbol, trade_date, count(*) AS bars, round(max(high), 6) AS high FROM intraday
    WHERE (symbol, trade_date) IN (SELECT (symbol, trade_date) FROM bars_daily WHERE n > 3) GROUP BY 1, 2""", "intraday bars_daily")
def scan_minute_day(spark, d):
    want = V.bars_daily(spark, d).where("n > 3").select(*KEYS)
    bars = V.intraday(spark, d).join(want, KEYS, "left_semi")
    assert_unique(bars, ["symbol", "trade_time"], "minute bars")
    return bars.groupBy("symbol", "trade_date").agg(F.count(F.lit(1)).alias("bars"), r(F.max("high")).alias("high"))


@query("scan_coverage_manifest", """
    SELECT trade_date, CASE WHEN day(trade_date) % 2 = 0 THEN 'full_day' ELSE 'deals' END AS minute_source
    FROM (SELECT DISTINCT trade_date FROM bars_daily) WHERE day(trade_date) % 7 <> 0 AND day(trade_date) % 5 <> 0""", "bars_daily")
def scan_coverage_manifest(spark, d):
    days = V.bars_daily(spark, d).select("trade_date").distinct()
    day = F.dayofmonth("trade_date")
    rec = F.struct(F.date_format("trade_date", "yyyyMMdd").alias("date"),
                   F.when(day % 7 == 0, "other").when(day % 2 == 0, "full_day").otherwise("deals").alias("canonical_source"),
                   (day % 5 != 0).alias("valid"))
    path = fresh(spark)  # the calendar: one record per session
    days.agg(F.lit("passed").alias("status"), F.lit("passed").alias("quality_status"), F.collect_list(rec).alias("daily")).write.json(path)
    return D.coverage_manifest(spark, path, ("full_day", "deals"))


@query("scan_selections", """
    WITH s AS (SELECT CASE WHEN symbol % 11 = 0 THEN NULL ELSE trade_date END AS t FROM daily WHERE symbol % 10 < 9)
    SELECT count(*) AS rows, count(*) FILTER (t IS NULL) AS null_rows, count(*) FILTER (t < DATE '2024-01-05') AS before_rows,
           count(*) FILTER (t > DATE '2024-01-25') AS after_rows FROM s""", "daily")
def scan_selections(spark, d):
    every = 2**31 - 1  # no bound on a date's names
    s = V.daily(spark, d).select(F.when(F.col("symbol") % 11 != 0, F.col("trade_date")).alias("signal_date"), "ts_code",
                                 F.lit(every).alias("top_k"), F.lit(None).cast("boolean").alias("execution_eligible"))
    kept, audit = D.selections(s, every, ["SH", "SZ"], "2024-01-05", "2024-01-25")
    return audit


@query("scan_benchmark_universe", """
    SELECT trade_date AS signal_date, ts_code, coalesce(NOT is_limit_up, false) AS execution_eligible,
           CASE WHEN pre_close IS NULL THEN 'unknown' ELSE 'known' END AS limit_band FROM daily
    WHERE trade_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-20' AND symbol % 10 < 9""", "daily")
def scan_benchmark_universe(spark, d):
    u = V.daily(spark, d).select("trade_date", F.lower("ts_code").alias("ts_code"), (~F.col("is_limit_up")).alias("execution_eligible"),
                                 F.when(F.col("pre_close").isNotNull(), "known").alias("limit_band"))
    return S.benchmark_universe(u, ["SH", "SZ"], "2024-01-02", "2024-01-20").withColumn("ts_code", F.upper("ts_code"))


@query("scan_return_series", "SELECT series, trade_date, round(ret, 8) AS ret FROM series", "series")
def scan_return_series(spark, d):
    s = V.series(spark, d)
    path = fresh(spark)
    s.where("trade_date <= date'2024-01-20'").write.option("header", True).csv(path)
    early = spark.read.csv(path, schema="series string, trade_date date, ret double", header=True)
    late = s.where("trade_date > date'2024-01-15'").select("series", "trade_date", (F.col("ret") * 100).alias("pct_chg"))
    return rounded(S.return_series([early, late.select("series", "trade_date", (F.col("pct_chg") / 100).alias("ret"))]), "ret", digits=8)


@query("scan_factor_series_files", "SELECT series AS factor, trade_date, round(ret, 8) AS ret FROM series WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'", "series")
def scan_factor_series_files(spark, d):
    path = fresh(spark)
    s = staged(V.series(spark, d))
    for name in ("view", "click", "error", "signup", "purchase"):
        s.where(F.col("series") == name).select("trade_date", "ret").write.option("header", True).csv(f"{path}/factor_{name}_daily")
    return rounded(S.named_series_csv(spark, path, "factor_([a-z]+)_daily", "2024-01-05", "2024-01-25"), "ret", digits=8)


@query("scan_etf_csv", """
    SELECT trade_date, symbol, round(close, 6) AS close, min(trade_date) OVER (PARTITION BY symbol) AS first_date
    FROM bars_daily WHERE n > 1""", "bars_daily")
def scan_etf_csv(spark, d):
    path = fresh(spark)
    b = V.bars_daily(spark, d).select("trade_date", "symbol", F.when(F.col("n") > 1, F.col("close").cast("string")).otherwise("--").alias("close"))
    b.write.option("header", True).csv(path)
    raw = spark.read.csv(path, schema="trade_date date, symbol bigint, close string", header=True)
    return rounded(S.listing_first_date(raw), "close").select("trade_date", "symbol", "close", "first_date")


@query("latest_positions", """
    WITH p AS (SELECT trade_date AS entry_date, symbol, amount FROM panel_supplier)
    SELECT entry_date, p.symbol, round(amount, 2) AS amount, s_name AS name, h.industry FROM p
    LEFT JOIN supplier ON s_suppkey = p.symbol
    LEFT JOIN (SELECT symbol, arg_max(industry, in_date) AS industry FROM industry_spells GROUP BY 1) h ON h.symbol = p.symbol
    WHERE entry_date = (SELECT max(trade_date) FROM panel_supplier)""", "panel_supplier industry_spells")
def latest_positions(spark, d):
    p = V.panel_supplier(spark, d).select(F.col("trade_date").alias("entry_date"), "symbol", r("amount", 2).alias("amount"))
    names = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"))
    hist = V.industry_spells(spark, d).select("symbol", F.col("in_date").alias("trade_date"), "industry")
    return S.latest_positions(p, names, hist)


@query("candidates_to_universe", """
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date, CAST(o_custkey AS VARCHAR) AS symbol, 1 AS selected
    FROM orders WHERE o_orderstatus <> 'P'""")
def candidates_to_universe(spark, d):
    o = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date"), F.when(F.col("o_orderstatus") == "P", "  ").otherwise(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))).alias("symbol"), "o_orderkey")
    path = fresh(spark)
    S.candidate_universe(o, ["o_orderkey"]).write.mode("append").json(path)
    return spark.read.json(path, schema="trade_date date, symbol string, selected int")


@query("normalize_membership_changes", """
    SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_returnflag AS industry_code, CAST(min(l_shipdate) AS DATE) AS effective_date,
           CASE WHEN l_returnflag <> 'N' THEN CAST(max(l_shipdate) AS DATE) - 1 END AS end_date, 1 AS copy FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def normalize_membership_changes(spark, d):
    m = V.membership(spark, d).select(
        F.concat(F.lit(" "), F.col("symbol").cast("string")).alias("symbol"), F.concat("industry", F.lit(" ")).alias("industry_code"),
        F.date_format("in_date", "yyyyMMdd").alias("in_date"),
        F.when(F.col("industry") != "N", F.date_format("out_date", "yyyyMMdd")).otherwise("None").alias("out_date"))
    both = m.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return S.membership_changes(both, ["copy"]).withColumn("end_date", F.col("end_date").cast("date"))


@query("write_partitioned_by_symbol", "SELECT symbol, count(*) AS rows, round(sum(close), 4) AS close_sum FROM panel_supplier GROUP BY 1", "panel_supplier")
def write_partitioned_by_symbol(spark, d):
    path = fresh(spark)
    written = sinks.by_symbol_csv(V.panel_supplier(spark, d).select("trade_date", "symbol", "close"), path)
    back = sinks.read_symbol_csv(written, "trade_date date, close double")
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), r(F.sum("close"), 4).alias("close_sum"))


@query("write_result_tables", """
    SELECT f.format, count(*) AS rows, round(sum(ret), 6) AS ret_sum FROM series, (VALUES ('parquet'), ('csv'), ('json')) f(format) GROUP BY 1""", "series")
def write_result_tables(spark, d):
    path = fresh(spark)
    sinks.result_tables({"daily": staged(V.series(spark, d))}, path)
    schema = "series string, trade_date date, ret double"
    back = {"parquet": spark.read.parquet(f"{path}/daily.parquet"), "csv": spark.read.csv(f"{path}/daily.csv", schema=schema, header=True),
            "json": spark.read.json(f"{path}/daily.json", schema=schema)}
    parts = [df.agg(F.lit(k).alias("format"), F.count(F.lit(1)).alias("rows"), r(F.sum("ret")).alias("ret_sum")) for k, df in back.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dataset_receipts", "SELECT count(DISTINCT trade_date) AS matched, CAST(0 AS BIGINT) AS differing FROM bars_daily", "bars_daily")
def dataset_receipts(spark, d):
    path = fresh(spark)
    V.bars_daily(spark, d).select("trade_date", "symbol", "close").hint("rebalance", "trade_date").write.partitionBy("trade_date").parquet(path)
    now = D.file_receipts(spark, path)
    kept = staged(now)
    same = D.complete_source(kept.withColumn("quality_status", F.lit("complete")), now)
    diff = D.receipt_differences(kept, now)
    days = same.where("file like 'trade_date=%'").select(F.regexp_extract("file", "trade_date=([^/]+)/", 1).alias("t"))
    return days.agg(F.countDistinct("t").alias("matched")).withColumn("differing", diff.agg(F.count(F.lit(1))).scalar())


@query("normalize_trade_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS trade_date FROM orders WHERE o_orderkey % 3 <> 2")
def normalize_trade_date(spark, d):
    k = F.col("o_orderkey") % 3
    o = V.table(spark, d, "orders").select("o_orderkey", F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(
        k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("not a date").alias("raw"))
    return o.select("o_orderkey", compact_date("raw").alias("trade_date")).where("trade_date is not null")
