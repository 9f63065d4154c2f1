"""Scans of market tables in their on-disk layouts.

Layouts: ``trade_date=YYYYMMDD/`` folders, one file per symbol, ``vintage=`` folders, single files.
Every scan is one ``spark.read`` with the columns and the date window in the plan, so pruning and
pushdown reach the files.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import compact_date, flag, strip_suffix, to_number
from ..operators.keys import keep_one

DATE, SYM = "trade_date", "symbol"
KEYS = [DATE, SYM]


def date_window(df: DataFrame, start: str | None = None, end: str | None = None, date: str = DATE,
                keep_undated: bool = False) -> DataFrame:
    """Inclusive optional bounds, to the end of the last day of a timestamp; rows without a date stay only on request."""
    cond = F.lit(True)
    if start:
        cond = cond & (F.col(date) >= F.lit(start).cast("date"))
    if end:
        cond = cond & (F.col(date) < F.date_add(F.lit(end).cast("date"), 1))
    return df.where(cond | F.col(date).isNull()) if keep_undated else df.where(cond)


def partition_window(spark: SparkSession, root: str, columns: list[str], start: str | None = None,
                     end: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of the dated folders inside the window, one per key; folders without a date are kept.

    The folder value stays a number in the filter, which prunes folders before any file is opened.
    """
    raw = spark.read.parquet(root)
    key = F.col(DATE).cast("int")
    cond = F.lit(True)
    if start:
        cond = cond & (key >= int(start.replace("-", "")))
    if end:
        cond = cond & (key <= int(end.replace("-", "")))
    order = order or []
    rows = raw.where(cond | F.col(DATE).isNull()).select(DATE, SYM, *columns, *[o for o in order if o not in columns])
    rows = rows.withColumn(DATE, compact_date(F.col(DATE)))
    return keep_one(rows, KEYS, order or columns).select(*KEYS, *columns)


def with_folder_date(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose files carry no date: taken from the folder name as a DATE column."""
    return spark.read.parquet(root).withColumn(DATE, compact_date(F.col(DATE)))


def month_end_rows(df: DataFrame, date: str = DATE, drop_current_after: str | None = None) -> DataFrame:
    """Rows of the last date of every month; the month of ``drop_current_after`` is out when incomplete."""
    ends = df.groupBy(F.trunc(date, "MM").alias("_m")).agg(F.max(date).alias(date))
    if drop_current_after:
        today = F.lit(drop_current_after).cast("date")
        ends = ends.where(~((F.col("_m") == F.trunc(today, "MM")) & (F.last_day(today) != today)))
    return df.join(ends.select(date), date, "left_semi")


def folder_values(spark: SparkSession, root: str, name: str) -> list[str]:
    """Values of the ``name=value`` folders right below ``root``, ascending, from one listing; no file is touched."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    return sorted(n.partition("=")[2] for n in names if n.startswith(f"{name}="))


def folders(spark: SparkSession, root: str, name: str, values: list[str]) -> DataFrame:
    """Rows of the named folders; the others are neither listed nor opened."""
    return spark.read.option("basePath", root).parquet(*[f"{root.rstrip('/')}/{name}={v}" for v in values])


def month_end_folders(spark: SparkSession, root: str, drop_current_after: str | None = None) -> DataFrame:
    """Rows of the last ``trade_date=YYYYMMDD`` folder of every month; the month of ``drop_current_after`` is out when incomplete.

    Folder names are the calendar, so the choice is made before anything is read. Raises if no folder is left.
    """
    last = {v[:6]: v for v in folder_values(spark, root, DATE)}
    if drop_current_after:
        today = dt.date.fromisoformat(drop_current_after)
        if (today + dt.timedelta(days=1)).month == today.month:
            last.pop(f"{today:%Y%m}", None)
    if not last:
        raise ValueError(f"no month-end folder under {root}")
    return folders(spark, root, DATE, sorted(last.values())).withColumn(DATE, compact_date(F.col(DATE)))


def symbol_files(spark: SparkSession, folder: str, start: str, end: str, order: list[str]) -> DataFrame:
    """A folder of per-symbol files: date window, last row per key."""
    return keep_one(date_window(spark.read.parquet(folder), start, end), KEYS, order, keep="last")


def latest_vintage(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest ``vintage=`` folder, found by one listing; a folder without vintages is the older layout and read whole."""
    names = [v for v in folder_values(spark, root, "vintage") if not v.startswith("__")]
    newest = max(names, key=lambda v: (int(v), v) if v.isdigit() else (0, v), default=None)
    return folders(spark, root, "vintage", [newest]) if newest else spark.read.parquet(root)


def latest_announcement(df: DataFrame, end: str | None = None) -> DataFrame:
    """Latest announcement per (symbol, report period); unknown announcement dates stay and win."""
    known = df if end is None else df.where(F.col("ann_date").isNull() | (F.col("ann_date") <= F.lit(end).cast("date")))
    rest = [c for c in df.columns if c not in ("symbol", "end_date", "ann_date")]
    order: list[str | Column] = [F.coalesce(F.col("ann_date"), F.lit("9999-12-31").cast("date")), *rest]
    latest = keep_one(known, ["symbol", "end_date"], order, keep="last")
    return latest.withColumn("symbol", strip_suffix("symbol"))


def present_columns(df: DataFrame, wanted: list[str], start: str | None = None, end: str | None = None,
                    order: list[str] | None = None) -> DataFrame:
    """The wanted columns that exist, inside the window, one row per key."""
    cols = [c for c in wanted if c in df.columns]
    return keep_one(date_window(df, start, end).select(*KEYS, *cols), KEYS, order or cols)


def tolerant_columns(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Select the given fields with their types; a missing field is null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])


def limit_events(df: DataFrame, text: list[str], up: str, down: str) -> DataFrame:
    """Limit-up / limit-down flags from free text columns, one row per key (either event counts)."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text]))
    return (df.select(*KEYS, joined.alias("_t")).groupBy(*KEYS)
            .agg(F.max(F.col("_t").contains(up)).alias("is_limit_up"),
                 F.max(F.col("_t").contains(down)).alias("is_limit_down")))


def market_balances(df: DataFrame, balances: list[str], changes: list[str]) -> DataFrame:
    """Sum balances over exchanges per date; ``*_yoy`` columns are one-row changes despite the name."""
    w = Window.orderBy(DATE)  # one row per date
    total = df.groupBy(DATE).agg(*[F.sum(c).alias(c) for c in balances])
    return total.withColumns({f"{c}_yoy": F.try_divide(F.col(c), F.lag(c).over(w)) - 1.0 for c in changes})


def industry_membership(members: DataFrame, names: DataFrame) -> DataFrame:
    """Membership intervals with the class name looked up by code, else the row's own name."""
    look = names.where(F.col("level") == "L1").groupBy("index_code").agg(F.min("industry_name").alias("_name"))
    out = members.join(look, "index_code", "left").withColumn("industry_l1", F.coalesce("_name", "own_name"))
    return out.where(F.col(SYM).isNotNull() & F.col("industry_l1").isNotNull()).select(
        SYM, "in_date", "out_date", "industry_l1")


def formation_rows(df: DataFrame, dates: DataFrame, order: list[str]) -> DataFrame:
    """Rows on formation dates only, one per key."""
    return keep_one(df.join(dates.select(DATE), DATE, "left_semi"), KEYS, order)


def positive_activity(df: DataFrame, dates: DataFrame, value_columns: list[str]) -> DataFrame:
    """Distinct keys on formation dates where any listed value is above zero (text counts as zero)."""
    top = F.greatest(*[F.coalesce(to_number(F.col(c)), F.lit(0.0)) for c in value_columns], F.lit(0.0))
    return df.join(dates.select(DATE), DATE, "left_semi").where(top > 0).select(*KEYS).distinct()


def return_series(parts: list[DataFrame]) -> DataFrame:
    """Long (series, trade_date, ret); a date repeated across files of one series keeps the first file."""
    tagged = [p.select("series", DATE, "ret", F.lit(i).alias("_file")) for i, p in enumerate(parts)]
    return keep_one(reduce(DataFrame.unionByName, tagged), ["series", DATE], ["_file"]).drop("_file")


def named_series_csv(spark: SparkSession, folder: str, pattern: str, start: str, end: str) -> DataFrame:
    """Every ``factor_<name>_daily`` folder of CSV files; the name comes from the path."""
    raw = spark.read.csv(f"{folder}/factor_*_daily", schema="trade_date date, ret double", header=True)
    named = raw.select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("factor"), DATE, "ret")
    return date_window(named, start, end)


def listing_first_date(df: DataFrame) -> DataFrame:
    """Coerce prices, drop unparsable rows, and attach each symbol's first date."""
    num = [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    rows = df.withColumns({c: to_number(F.col(c)) for c in num}).where(F.col("close").isNotNull())
    first = rows.groupBy(SYM).agg(F.min(DATE).alias("first_date"))
    return rows.join(first, SYM)


def latest_positions(positions: DataFrame, names: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of the newest entry date with name and the newest known industry of each symbol."""
    newest = positions.agg(F.max("entry_date").alias("entry_date"))
    held = positions.join(newest, "entry_date", "left_semi")
    ind = (history.where(F.col("industry").isNotNull()).groupBy(SYM)
           .agg(F.max_by("industry", DATE).alias("industry")))
    return held.join(names, SYM, "left").join(ind, SYM, "left")


def candidate_universe(rows: DataFrame, order: list[str]) -> DataFrame:
    """Trimmed, non-blank candidates; the first occurrence wins; all selected."""
    t = rows.withColumn(SYM, F.trim(SYM)).where(F.col(SYM) != "")
    return keep_one(t, KEYS, order).select(*KEYS, F.lit(1).alias("selected"))


def membership_changes(df: DataFrame, order: list[str]) -> DataFrame:
    """Trim text, parse compact dates (''/'None' are null), end one day before ``out_date``, keep the last copy."""
    blank = lambda c: F.when(~F.trim(c).isin("", "None"), F.trim(c))
    d = df.withColumns({
        "symbol": F.trim("symbol"), "industry_code": F.trim("industry_code"),
        "effective_date": compact_date(blank(F.col("in_date"))),
        "end_date": F.date_sub(compact_date(blank(F.col("out_date"))), 1)}).drop("in_date", "out_date")
    d = d.where(F.col("effective_date").isNotNull())
    return keep_one(d, ["symbol", "effective_date", "end_date", "industry_code"], order, keep="last")


def instruments(df: DataFrame) -> DataFrame:
    """Instrument master with list / delist dates parsed from compact text."""
    return df.withColumns({"list_date": compact_date("list_date"), "delist_date": compact_date("delist_date")})


def selected_universe(spark: SparkSession, path: str) -> DataFrame:
    """Universe CSV rows with selected = 1."""
    schema = "trade_date date, symbol bigint, selected int"
    return spark.read.csv(path, schema=schema, header=True).where("selected = 1").select(*KEYS)


def required(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks columns {missing}")
    return df


def benchmark_universe(df: DataFrame, markets: list[str], start: str, end: str) -> DataFrame:
    """Benchmark universe: required columns, market and date filter, missing flags false, unknown band."""
    from ..functions.expr import market_suffix

    required(df, ["trade_date", "ts_code", "execution_eligible", "limit_band"], "benchmark universe")
    d = date_window(df, start, end).where(market_suffix("ts_code").isin(*markets))
    return d.select(F.col(DATE).alias("signal_date"), "ts_code", flag("execution_eligible").alias("execution_eligible"),
                    F.coalesce("limit_band", F.lit("unknown")).alias("limit_band"))
