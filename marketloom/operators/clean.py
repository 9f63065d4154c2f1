"""Clean history: bridges, overlays, eligibility and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import flag, to_number
from .keys import keep_one

DATE, SYM = "trade_date", "symbol"
KEYS = [DATE, SYM]


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))


def tradable_flags(df: DataFrame) -> DataFrame:
    """Buy and sell permission; a missing suspension or special-treatment flag blocks."""
    open_ = (F.coalesce(F.col("close"), F.lit(0.0)) > 0) & ~flag("is_suspended", True)
    return df.withColumns({
        "buy_tradable": open_ & ~flag("is_st", True) & ~flag("is_limit_up"),
        "sell_tradable": open_ & ~flag("is_limit_down")})


def price_limit_flags(df: DataFrame) -> DataFrame:
    """Tradable on positive amount, limit flags with missing as false, return as a fraction."""
    return df.select(*KEYS, (F.coalesce("amount", F.lit(0.0)) > 0).alias("tradable"), flag("is_limit_up").alias("limit_up"),
                     flag("is_limit_down").alias("limit_down"), (F.col("pct_chg") / 100.0).alias("ret"))


def clip_turnover(df: DataFrame, value: str = "turnover_rate", lo: float = 0.01, hi: float = 100.0, order: list[str] | None = None) -> DataFrame:
    """Turnover as a number inside its bounds, the last row of each key in ``order``; rows without a number or symbol leave."""
    df = keep_one(df, KEYS, order, keep="last") if order else df
    x = to_number(F.col(value))
    return df.withColumn(value, F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))).where(
        F.col(value).isNotNull() & F.col(SYM).isNotNull())


def overlay_suspensions(bars: DataFrame, events: DataFrame) -> DataFrame:
    """OR explicit suspension events onto the bars; ``newly_flagged`` marks what they change."""
    e = events.select(*KEYS).distinct().withColumn("_event", F.lit(True))
    d = bars.join(e, KEYS, "left")
    was = flag("is_suspended")
    return d.withColumns({"newly_flagged": flag("_event") & ~was, "is_suspended": was | flag("_event")}).drop("_event")


def suspension_audit(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of events with and without a price row."""
    e = events.select(*KEYS).distinct()
    d = e.join(bars.select(*KEYS, F.lit(True).alias("_bar")), KEYS, "left")
    return d.agg(F.count(F.lit(1)).alias("events"), count_if(F.col("_bar")).alias("with_price"),
                 count_if(F.col("_bar").isNull()).alias("without_price"))


def clean_bridge(bars: DataFrame, basics: DataFrame, factors: DataFrame, limits: DataFrame, instruments: DataFrame) -> DataFrame:
    """Bars with basics, adjustment factor, limits and listing age; unmatched parts stay null."""
    d = (bars.join(basics, KEYS, "left").join(factors, KEYS, "left").join(limits, KEYS, "left")
         .join(instruments.select(SYM, "list_date"), SYM, "left"))
    first = F.min(DATE).over(Window.partitionBy(SYM))
    d = d.withColumns({
        "tr_close": F.col("close") * F.col("adj_factor"),
        "is_limit_up": F.coalesce(F.col("close") >= F.col("up_limit"), F.lit(False)),
        "is_limit_down": F.coalesce(F.col("close") <= F.col("down_limit"), F.lit(False)),
        "listed_days": F.datediff(DATE, F.least(F.col("list_date"), first))})
    return d.drop("list_date")


def assemble_history(early: DataFrame, late: DataFrame, start: str, end: str) -> DataFrame:
    """Early and late rows with the total-return close filled from close × factor."""
    d = early.unionByName(late, allowMissingColumns=True)
    d = d.where(F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return d.withColumn("tr_close", F.coalesce(F.col("close") * F.col("adj_factor"), F.col("tr_close")))


def eligible_panel(scores: DataFrame, facts: DataFrame, min_listed: int, min_amount: float) -> DataFrame:
    """Formation eligibility; a missing age, amount or flag excludes the row."""
    d = scores.join(facts, KEYS, "left")
    return d.where((F.col("listed_days") >= min_listed) & (F.col("median_amount") >= min_amount) & (F.col("close") > 0)
                   & ~flag("is_suspended", True) & ~flag("is_st", True))


def formation_universe(factors: DataFrame, bars: DataFrame, universe: DataFrame, st: DataFrame) -> DataFrame:
    """Factor rows in the universe with listing age, amount and ST marker."""
    return (factors.join(universe.select(*KEYS).distinct(), KEYS)
            .join(bars.select(*KEYS, "listed_days", "amount"), KEYS, "left")
            .join(st.select(*KEYS).distinct().withColumn("_st", F.lit(True)), KEYS, "left")
            .withColumn("is_st", flag("_st")).drop("_st"))


def formation_eligible(joined: DataFrame, min_listed: int) -> DataFrame:
    return joined.where((F.coalesce("listed_days", F.lit(-1)) >= min_listed) & (F.coalesce("amount", F.lit(0.0)) > 0)
                        & ~F.col("is_st"))


def formation_exclusions(joined: DataFrame, min_listed: int) -> DataFrame:
    """Exclusion counts of the formation gate."""
    return joined.agg(
        F.count(F.lit(1)).alias("factor_rows_in_universe"),
        count_if(F.coalesce("listed_days", F.lit(-1)) < min_listed).alias("excluded_immature"),
        count_if(F.col("is_st")).alias("excluded_st"),
        count_if(F.coalesce("amount", F.lit(0.0)) <= 0).alias("excluded_not_trading"))


def covered_columns(df: DataFrame, columns: list[str], minimum: float = 0.8) -> list[str]:
    """Columns whose non-null share reaches the minimum: one aggregate row decides."""
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] >= minimum]


def match_rate(left: DataFrame, right: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of left rows with a partner."""
    d = left.join(right.select(*keys).distinct().withColumn("_hit", F.lit(1.0)), keys, "left")
    return d.agg(F.lit(label).alias("join"), F.count(F.lit(1)).alias("rows"), F.avg(F.coalesce("_hit", F.lit(0.0))).alias("rate"))


def common_dates(long: DataFrame, group: list[str], profile: str) -> DataFrame:
    """Rows on dates where every profile of the group has a value."""
    total = long.groupBy(*group).agg(F.countDistinct(profile).alias("_all"))
    per = long.groupBy(*group, DATE).agg(F.countDistinct(profile).alias("_here"))
    keep = per.join(total, group).where("_here = _all").select(*group, DATE)
    return long.join(keep, [*group, DATE], "left_semi")
