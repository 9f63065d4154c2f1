"""Verification of stored results: tie-outs, identities, integrity and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .ordering import quantiles

DATE, SYM = "trade_date", "symbol"


def tie_out(observed: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Common rows and the largest absolute difference."""
    j = observed.select(*keys, F.col(value).alias("_o")).join(expected.select(*keys, F.col(value).alias("_e")), keys)
    return j.agg(F.count(F.lit(1)).alias("common"), F.max(F.abs(F.col("_o") - F.col("_e"))).alias("max_difference")).withColumn(
        "passed", (F.col("common") > 0) & (F.col("max_difference") <= tolerance))


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Row keys on one side only, and per numeric column the largest difference (null beside a value counts as infinite)."""
    nums = [c for c, t in left.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    j = left.select(*keys, F.lit(1).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in nums]).join(
        right.select(*keys, F.lit(1).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in nums]), keys, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    gap = lambda c: F.when(both & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")),
                           F.coalesce(F.abs(F.col(f"_l_{c}") - F.col(f"_r_{c}")), F.lit(float("inf")))).otherwise(0.0)
    row = j.agg(F.sum(F.col("_r").isNull().cast("bigint")).alias("left_only"), F.sum(F.col("_l").isNull().cast("bigint")).alias("right_only"),
                *[F.max(gap(c)).alias(c) for c in nums])
    return row.unpivot(["left_only", "right_only"], nums, "column", "max_difference").withColumn(
        "equal", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("max_difference") <= tolerance))


def score_integrity(scores: DataFrame, variants: int, rows: int, hms: tuple[int, int, int], zone: str = "Asia/Shanghai") -> DataFrame:
    """Same keys in every variant, a fixed row count per variant and date, one availability time of day."""
    keys = scores.groupBy(DATE, SYM).agg(F.count_distinct("variant").alias("v")).agg(F.sum((F.col("v") != variants).cast("bigint"))).scalar()
    per = scores.groupBy("variant", DATE).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("variant_dates"), F.sum((F.col("n") != rows).cast("bigint")).alias("wrong_size_dates"))
    t = F.from_utc_timestamp("available_at", zone)
    off = (F.hour(t) != hms[0]) | (F.minute(t) != hms[1]) | (F.second(t) != hms[2])
    when = scores.agg(F.sum(off.cast("bigint"))).scalar()
    return per.select(keys.alias("keys_not_shared"), "variant_dates", "wrong_size_dates", when.alias("wrong_time_rows"))


def delta_report(rows: DataFrame, base: str, metrics: list[str], reported: DataFrame, checked: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Mean paired difference of every variant from ``base`` over common dates, beside the reported one.

    ``reported`` has variant and the ``checked`` metrics; a delta that nobody reported does not match.
    """
    b = rows.where(F.col("variant") == base).select(DATE, *[F.col(m).alias(f"_{m}") for m in metrics])
    d = rows.where(F.col("variant") != base).join(b, DATE).groupBy("variant").agg(
        F.count(F.lit(1)).alias("dates"), *[F.avg(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics])
    d = d.join(reported.select("variant", *[F.col(m).alias(f"reported_{m}") for m in checked]), "variant", "left")
    return d.withColumns({f"{m}_matches": F.coalesce(F.abs(F.col(f"delta_{m}") - F.col(f"reported_{m}")) <= tolerance, F.lit(False)) for m in checked})


def ledger_identities(ledger: DataFrame, orders: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """cash + positions = NAV, gross − cost = NAV change, order cost = notional × bps: largest gap of each."""
    part = {"cash_plus_positions": F.abs(F.col("cash") + F.col("positions") - F.col("nav")), "gross_minus_cost": F.abs(F.col("gross") - F.col("cost") - F.col("nav"))}
    cost = orders.agg(F.max(F.abs(F.col("cost") - F.col("notional") * F.col("bps") / 10000.0))).scalar()
    names = [*part, "order_cost"]
    return ledger.agg(*[F.max(v).alias(k) for k, v in part.items()]).withColumn("order_cost", cost).unpivot([], names, "identity", "gap").withColumn("passed", F.col("gap") <= tolerance)


def reconcile_labels(executed: DataFrame, labels: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Executed against label returns per variant: clean rows must agree, blocked ones are reported apart."""
    j = executed.join(labels.select(DATE, SYM, F.col("label_return")), [DATE, SYM], "left")
    gap = F.abs(F.col("executed_return") - F.col("label_return"))
    clean = ~F.col("blocked") & F.col("label_return").isNotNull()
    n = lambda c: F.sum(c.cast("bigint"))
    return j.groupBy("variant").agg(
        F.count(F.lit(1)).alias("rows"), n(clean).alias("clean_rows"), n(F.col("blocked")).alias("blocked_rows"), n(F.col("label_return").isNull()).alias("missing_labels"),
        n(clean & (gap > tolerance)).alias("clean_mismatches"), F.max(F.when(clean, gap)).alias("max_clean_gap"))


def quality_report(panel: DataFrame, value: str, max_move: float = 0.5) -> DataFrame:
    """Duplicates, dates, median names, coverage, non-positive prices and jumps in one row."""
    w = Window.partitionBy(SYM).orderBy(DATE)
    move = F.abs(F.col("close") / F.lag("close").over(w) - 1.0) > max_move
    base = panel.withColumn("_jump", F.coalesce(move, F.lit(False))).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("_jump").cast("bigint")).alias("large_moves"), F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"),
        F.sum((F.col("close") <= 0).cast("bigint")).alias("nonpositive_prices"))
    keys = panel.groupBy(DATE, SYM).agg(F.count(F.lit(1)).alias("c"))
    names = keys.groupBy(DATE).agg(F.count(F.lit(1)).alias("n"))  # one row per date
    return base.withColumns({"duplicate_rows": keys.agg(F.sum(F.col("c") - 1)).scalar(), "dates": names.agg(F.count(F.lit(1))).scalar(),
                             "median_names": names.agg(F.percentile("n", F.lit(0.5))).scalar()})


def coverage_row(df: DataFrame, label: str) -> DataFrame:
    """Rows, symbols, dates and date range of a source."""
    return df.agg(F.lit(label).alias("source"), F.count(F.lit(1)).alias("rows"), F.count_distinct(SYM).alias("symbols"), F.count_distinct(DATE).alias("dates"),
                  F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"))


def adjustment_bridge(df: DataFrame, boundary: str, price: str, reported: str) -> DataFrame:
    """Per symbol, the change from the last row before to the first row after a boundary against the reported change."""
    day = F.lit(boundary).cast("date")
    before, after = F.col(DATE) < day, F.col(DATE) >= day
    g = df.groupBy(SYM).agg(
        F.max_by(F.when(before, F.col(price)), F.when(before, F.col(DATE))).alias("_b"), F.min_by(F.when(after, F.col(price)), F.when(after, F.col(DATE))).alias("_a"),
        F.min_by(F.when(after, F.col(reported)), F.when(after, F.col(DATE))).alias("_r"))
    err = F.abs((F.col("_a") / F.col("_b") - 1.0) * 100.0 - F.col("_r"))
    g = staged(g.where("_a is not null and _b is not null and _r is not null").select(F.lit(1).alias("_k"), err.alias("error")))
    q = quantiles(g, ["_k"], "error", {"median_error": 0.5, "p99_error": 0.99}).drop("n")
    return g.groupBy("_k").agg(F.count(F.lit(1)).alias("symbols"), F.max("error").alias("max_error")).join(q, "_k").drop("_k")


def event_evidence(df: DataFrame, kind: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(SYM).alias("symbols"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
                  F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("types"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat a key, null being a key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("double").alias("observed"))


def join_rate(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: share of the left rows whose key the right side has; null without left rows. Both sides are counted by key before they meet."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    j = a.join(right.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return j.agg(F.try_divide(F.sum(F.when(F.col("_hit") == 1, F.col("c")).otherwise(0)), F.sum("c")).cast("double").alias("observed"))


def date_coverage(df: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: distinct dates of ``df`` against those expected; zero where none is."""
    n = df.agg(F.count_distinct(DATE)).scalar()
    return expected.agg(F.coalesce(F.try_divide(n, F.count_distinct(DATE)), F.lit(0.0)).cast("double").alias("observed"))


def interval_agreement(rows: DataFrame, flag: str, intervals: DataFrame) -> DataFrame:
    """One row: precision and recall of validity intervals (symbol, in_date, out_date; both ends count, null is open) as a rebuilt ``flag``.

    A sweep over each symbol's dates: intervals open and close in a running count, so overlapping ones are one union and no
    row meets an interval. An interval that ends before it starts, or has no start, covers nothing. A missing flag is false; a rate is null
    where nothing is covered (precision) or flagged (recall).
    """
    spans = intervals.where("in_date is not null and (out_date is null or out_date >= in_date)")
    edges = spans.select(SYM, F.col("in_date").alias("_d"), F.lit(1).alias("_step")).unionByName(spans.where("out_date is not null").select(SYM, F.date_add("out_date", 1).alias("_d"), F.lit(-1).alias("_step")))
    edges = edges.groupBy(SYM, "_d").agg(F.sum("_step").alias("_step")).withColumns({"_n": F.lit(0), "_f": F.lit(0)})
    seen = rows.groupBy(SYM, F.col(DATE).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).alias("_f")).withColumn("_step", F.lit(0))
    w = Window.partitionBy(SYM).orderBy("_d").rangeBetween(Window.unboundedPreceding, 0)  # at most two rows a date
    d = edges.unionByName(seen).withColumn("_in", F.sum("_step").over(w) > 0)
    both = F.sum(F.when(F.col("_in"), F.col("_f")).otherwise(0))
    return d.agg(F.try_divide(both, F.sum(F.when(F.col("_in"), F.col("_n")).otherwise(0))).alias("precision"), F.try_divide(both, F.sum("_f")).alias("recall"))
