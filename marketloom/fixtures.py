"""Market-shaped views over the driver's tables, in Spark and in SQL.

Bars come from ``events`` (one symbol per user), monthly panels from ``lineitem``, point-in-time
facts from ``orders``. Flags the tables lack follow fixed arithmetic rules, the same in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import expr as X

EPOCH = "2024-01-01"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tick_order():
    """(ts, event_id) as one decimal: a fixed-width key keeps the first / last price in a hash aggregate,
    where a struct key would make every map task sort its ticks first."""
    return F.expr("cast(unix_micros(cast(ts as timestamp)) as decimal(20,0)) * cast(1000000000000000000 as decimal(19,0))"
                  " + cast(event_id as decimal(20,0))")


def bars_daily(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(
        F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"),
        tick_order().alias("k"), (20.0 + 0.02 * F.col("value")).alias("p"), "value")
    return e.groupBy("symbol", "trade_date").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"), F.sum("value").alias("amount"), F.count(F.lit(1)).alias("n"))


def daily(spark, d) -> DataFrame:
    """Daily bars with limits, flags, capital and listing age."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    s, day = F.col("symbol"), F.datediff("trade_date", F.lit(EPOCH).cast("date"))
    b = bars_daily(spark, d).withColumn("pre_close", F.lag("close").over(w))
    b = b.withColumn("band", F.when(s % 4 == 0, 10.0).when(s % 4 == 1, 20.0).when(s % 4 == 2, 5.0).otherwise(30.0))
    b = b.withColumns({
        "pct_chg": (F.col("close") / F.col("pre_close") - 1.0) * 100.0,
        "turnover_rate": 0.5 + F.col("n") * 0.25 + (s % 5) * 0.1,
        "total_mv": F.col("close") * (1000.0 + 37.0 * (s % 101)),
        "up_limit": F.col("pre_close") * (1.0 + F.col("band") / 100.0),
        "down_limit": F.col("pre_close") * (1.0 - F.col("band") / 100.0),
        "is_suspended": (s + day) % 29 == 0,
        "is_st": s % 17 == 0,
        "listed_days": (40 + day + s % 60).cast("int"),
        "board": F.when(s % 3 == 0, "main").when(s % 3 == 1, "growth").otherwise("star"),
        "industry": F.concat(F.lit("ind_"), (s % 7).cast("string")),
        "adj_factor": 1.0 + day * 0.001,
        "ts_code": F.concat(s.cast("string"), F.when(s % 10 < 6, ".SH").when(s % 10 < 9, ".SZ").otherwise(".BJ")),
        "pred": ((s * 7919 + day * 104729) % 1009).cast("double") / 1009.0,
    })
    return b.withColumns({
        "circ_mv": F.col("total_mv") * 0.8,
        "is_limit_up": F.coalesce(F.col("close") >= F.col("up_limit"), F.lit(False)),
        "is_limit_down": F.coalesce(F.col("close") <= F.col("down_limit"), F.lit(False)),
    })


def panel(spark, d, key: str) -> DataFrame:
    """Monthly panel of ``lineitem`` by one key column."""
    return (table(spark, d, "lineitem")
            .groupBy(F.trunc("l_shipdate", "MM").alias("trade_date"), F.col(key).alias("symbol"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
                 F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("turnover"),
                 F.avg("l_discount").alias("disc"), F.count(F.lit(1)).alias("n")))


def panel_part(spark, d) -> DataFrame:
    return panel(spark, d, "l_partkey")


def panel_supplier(spark, d) -> DataFrame:
    return panel(spark, d, "l_suppkey")


def ship_daily(spark, d) -> DataFrame:
    """Supplier bars by ship date: long per-symbol histories."""
    li = table(spark, d, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (li.groupBy(F.to_date("l_shipdate").alias("trade_date"), F.col("l_suppkey").alias("symbol"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(unit).alias("high"),
                 F.min(unit).alias("low"), F.sum("l_quantity").alias("vol"),
                 F.sum("l_extendedprice").alias("amount")))


def industry_part(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_type").alias("industry"))


def industry_supplier(spark, d) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("industry")))


def factors(spark, d) -> DataFrame:
    """Monthly part panel with three raw factors, industry and the next observed return."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    p = panel_part(spark, d).join(industry_part(spark, d), "symbol", "left")
    return p.withColumns({
        "f_size": F.log("amount"), "f_value": 1.0 / F.col("close"), "f_turn": -F.col("turnover"),
        "next_ret": F.lead("close").over(w) / F.col("close") - 1.0,
    })


def pit_events(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("available_date"),
                    F.trunc("o_orderdate", "MM").alias("report_period"), F.col("o_orderkey").alias("seq"),
                    F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("roe"),
                    F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") / 1000.0).alias("growth"))


def membership(spark, d) -> DataFrame:
    """Validity intervals per supplier and class."""
    return (table(spark, d, "lineitem")
            .groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("industry"))
            .agg(F.to_date(F.min("l_shipdate")).alias("in_date"), F.to_date(F.max("l_shipdate")).alias("out_date")))


def industry_spells(spark, d) -> DataFrame:
    """Non-overlapping classes per supplier: one class per year, the last one still open."""
    y = (table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("y"))
         .agg(F.count(F.lit(1)).alias("n")))
    last = Window.partitionBy("symbol")
    return y.withColumn("top", F.max("y").over(last)).select(
        "symbol", F.make_date("y", F.lit(1), F.lit(1)).alias("in_date"),
        F.when(F.col("y") < F.col("top"), F.make_date(F.col("y") + 1, F.lit(1), F.lit(1))).alias("out_date"),
        F.concat(F.lit("class_"), ((F.col("symbol") + F.col("y")) % 5).cast("string")).alias("industry"))


def intraday(spark, d) -> DataFrame:
    """Six-hour bars per symbol and day (four slots make a session); every 23rd symbol has a bad bar."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"),
        (F.to_date("ts").cast("timestamp") + F.expr("make_dt_interval(0, int(floor(hour(ts) / 6)) * 6)")).alias("trade_time"),
        tick_order().alias("k"), (20.0 + 0.02 * F.col("value")).alias("p"), "value")
    b = e.groupBy("symbol", "trade_date", "trade_time").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"), F.sum("value").alias("amount"))
    bad = (F.col("symbol") % 23 == 0) & (F.hour("trade_time") == 12)
    return b.withColumn("high", F.when(bad, 0.0).otherwise(F.col("high")))


def series(spark, d) -> DataFrame:
    """Daily return series, one per event type."""
    s = (table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("trade_date"))
         .agg(((F.avg("value") - 49.0) / 1000.0).alias("ret")))
    return s


def hot_list(spark, d) -> DataFrame:
    """Concept list text per ranked row: the month's orders by price, concepts from the parts of all its lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, d, "part")
    o = table(spark, d, "orders")
    names = li.join(part, li.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.concat(F.regexp_replace("p_name", " ", ", "), F.lit(", "), F.col("p_type")))).alias("names"))  # the lines of one order
    return (o.join(names, o.o_orderkey == names.l_orderkey)
            .select(F.trunc("o_orderdate", "MM").alias("trade_date"), F.col("o_orderkey").alias("symbol"),
                    F.col("o_totalprice").alias("hot"),
                    F.concat(F.lit("["), F.array_join("names", ", "), F.lit("]")).alias("concepts")))


# --- the same views for the SQL side -------------------------------------------------------

_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "bars_daily": ((), """
        SELECT user_id AS symbol, CAST(ts AS DATE) AS trade_date,
               first(20.0::DOUBLE + 0.02::DOUBLE * value ORDER BY ts, event_id) AS open,
               max(20.0::DOUBLE + 0.02::DOUBLE * value) AS high, min(20.0::DOUBLE + 0.02::DOUBLE * value) AS low,
               last(20.0::DOUBLE + 0.02::DOUBLE * value ORDER BY ts, event_id) AS close,
               sum(value) AS amount, count(*) AS n
        FROM events GROUP BY 1, 2"""),
    "daily": (("bars_daily",), """
        SELECT *, total_mv * 0.8::DOUBLE AS circ_mv, coalesce(close >= up_limit, false) AS is_limit_up,
               coalesce(close <= down_limit, false) AS is_limit_down
        FROM (SELECT *, (close / pre_close - 1.0::DOUBLE) * 100.0::DOUBLE AS pct_chg,
               0.5::DOUBLE + n * 0.25::DOUBLE + (symbol % 5) * 0.1::DOUBLE AS turnover_rate,
               close * (1000.0::DOUBLE + 37.0::DOUBLE * (symbol % 101)) AS total_mv,
               pre_close * (1.0::DOUBLE + band / 100.0::DOUBLE) AS up_limit,
               pre_close * (1.0::DOUBLE - band / 100.0::DOUBLE) AS down_limit,
               (symbol + d) % 29 = 0 AS is_suspended, symbol % 17 = 0 AS is_st,
               CAST(40 + d + symbol % 60 AS INTEGER) AS listed_days,
               CASE symbol % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'growth' ELSE 'star' END AS board,
               'ind_' || (symbol % 7) AS industry, 1.0::DOUBLE + d * 0.001::DOUBLE AS adj_factor,
               symbol || CASE WHEN symbol % 10 < 6 THEN '.SH' WHEN symbol % 10 < 9 THEN '.SZ' ELSE '.BJ' END AS ts_code,
               CAST((symbol * 7919 + d * 104729) % 1009 AS DOUBLE) / 1009.0::DOUBLE AS pred
        FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pre_close,
                     date_diff('day', DATE '2024-01-01', trade_date) AS d,
                     CASE symbol % 4 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 20.0::DOUBLE WHEN 2 THEN 5.0::DOUBLE
                          ELSE 30.0::DOUBLE END AS band
              FROM bars_daily))"""),
    "panel_part": ((), """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, l_partkey AS symbol,
               sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_extendedprice) AS amount,
               sum(l_quantity) AS turnover, avg(l_discount) AS disc, count(*) AS n
        FROM lineitem GROUP BY 1, 2"""),
    "panel_supplier": ((), """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, l_suppkey AS symbol,
               sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_extendedprice) AS amount,
               sum(l_quantity) AS turnover, avg(l_discount) AS disc, count(*) AS n
        FROM lineitem GROUP BY 1, 2"""),
    "ship_daily": ((), """
        SELECT CAST(l_shipdate AS DATE) AS trade_date, l_suppkey AS symbol,
               sum(l_extendedprice) / sum(l_quantity) AS close, max(l_extendedprice / l_quantity) AS high,
               min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS vol, sum(l_extendedprice) AS amount
        FROM lineitem GROUP BY 1, 2"""),
    "industry_part": ((), "SELECT p_partkey AS symbol, p_type AS industry FROM part"),
    "industry_supplier": ((), """
        SELECT s_suppkey AS symbol, r_name AS industry FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "factors": (("panel_part", "industry_part"), """
        SELECT p.*, industry, ln(amount) AS f_size, 1.0::DOUBLE / close AS f_value, -turnover AS f_turn,
               lead(close) OVER (PARTITION BY p.symbol ORDER BY trade_date) / close - 1.0::DOUBLE AS next_ret
        FROM panel_part p LEFT JOIN industry_part i ON p.symbol = i.symbol"""),
    "pit_events": ((), """
        SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS available_date,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS report_period, o_orderkey AS seq,
               CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS roe,
               CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 1000.0::DOUBLE END AS growth
        FROM orders"""),
    "membership": ((), """
        SELECT l_suppkey AS symbol, l_returnflag AS industry, CAST(min(l_shipdate) AS DATE) AS in_date,
               CAST(max(l_shipdate) AS DATE) AS out_date
        FROM lineitem GROUP BY 1, 2"""),
    "industry_spells": ((), """
        SELECT symbol, make_date(y, 1, 1) AS in_date,
               CASE WHEN y < max(y) OVER (PARTITION BY symbol) THEN make_date(y + 1, 1, 1) END AS out_date,
               'class_' || ((symbol + y) % 5) AS industry
        FROM (SELECT DISTINCT l_suppkey AS symbol, year(l_shipdate) AS y FROM lineitem)"""),
    "intraday": ((), """
        SELECT symbol, trade_date, trade_time, open, CASE WHEN symbol % 23 = 0 AND hour(trade_time) = 12 THEN 0.0::DOUBLE ELSE high END AS high,
               low, close, amount
        FROM (SELECT user_id AS symbol, CAST(ts AS DATE) AS trade_date,
               CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_hours(CAST(floor(hour(ts) / 6.0) AS INTEGER) * 6) AS trade_time,
               first(20.0::DOUBLE + 0.02::DOUBLE * value ORDER BY ts, event_id) AS open,
               max(20.0::DOUBLE + 0.02::DOUBLE * value) AS high, min(20.0::DOUBLE + 0.02::DOUBLE * value) AS low,
               last(20.0::DOUBLE + 0.02::DOUBLE * value ORDER BY ts, event_id) AS close, sum(value) AS amount
              FROM events GROUP BY 1, 2, 3)"""),
    "series": ((), """
        SELECT event_type AS series, CAST(ts AS DATE) AS trade_date, (avg(value) - 49.0::DOUBLE) / 1000.0::DOUBLE AS ret
        FROM events GROUP BY 1, 2"""),
    "hot_list": ((), """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date, o_orderkey AS symbol, o_totalprice AS hot, '[' || names || ']' AS concepts
        FROM orders JOIN (SELECT l_orderkey, string_agg(n, ', ' ORDER BY n) AS names FROM
            (SELECT l_orderkey, replace(p_name, ' ', ', ') || ', ' || p_type AS n FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1) ON o_orderkey = l_orderkey"""),
}


def add_view(name: str, deps: tuple[str, ...], sql: str) -> None:
    """Register a further SQL view used by several oracle queries."""
    _SQL[name] = (deps, sql)


def oracle(sql: str, *views: str) -> str:
    """Prefix a query with the views it uses (dependencies first)."""
    order: list[str] = []

    def visit(v: str) -> None:
        for dep in _SQL[v][0]:
            visit(dep)
        if v not in order:
            order.append(v)

    for v in views:
        visit(v)
    text = sql.strip()
    ctes = [f"{v} AS ({_SQL[v][1].strip()})" for v in order]
    if text[:5].upper() == "WITH ":
        ctes.append(text[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + text
