"""Date-level return series: market proxies, calendars effects, streaks, trailing and rolling results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DATE = "trade_date"


def ordered():
    """Date-level tables only: one row per session."""
    return Window.orderBy(DATE)


def market_proxy(df: DataFrame, pct: str = "pct_chg") -> DataFrame:
    """Equal-weight mean return per date."""
    return df.where(F.col(pct).isNotNull()).groupBy(DATE).agg((F.avg(pct) / 100.0).alias("ret"))


def worst_days(market: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest returns with the following return, the weekday, and how many of them share the year or the weekday."""
    d = market.withColumns({"next_ret": F.lead("ret").over(ordered()), "weekday": F.date_format(DATE, "EEEE"), "_year": F.year(DATE)})
    share = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))  # noqa: E731  (over n rows)
    return d.orderBy("ret", DATE).limit(n).withColumns({"in_year": share("_year"), "on_weekday": share("weekday")}).drop("_year")


def weekday_effect(market: DataFrame) -> DataFrame:
    return market.groupBy(F.date_format(DATE, "EEEE").alias("weekday")).agg(
        F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.count(F.lit(1)).alias("days"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def streak_next(market: DataFrame, length: int = 3, floor: float = 0.0) -> DataFrame:
    """Next-day return after ``length`` days above ``floor``, beside the unconditional one."""
    hot = F.col("ret") > floor
    for k in range(1, length):
        hot = hot & (F.lag("ret", k).over(ordered()) > floor)
    d = market.withColumns({"_next": F.lead("ret").over(ordered()), "_hot": F.coalesce(hot, F.lit(False))}).where("_next is not null")
    after = F.when(F.col("_hot"), F.col("_next"))
    win = lambda c: F.avg((c > 0).cast("double"))
    return d.agg(F.count(after).alias("events"), F.avg(after).alias("mean_after"), win(after).alias("win_after"),
                 F.avg("_next").alias("mean_all"), win(F.col("_next")).alias("win_all"))


def trailing(long: DataFrame, spans: tuple[int, ...] = (5, 21, 126, 252)) -> DataFrame:
    """Compounded return of the last n rows of every series, and of its last calendar year."""
    w = Window.partitionBy("series").orderBy(F.col(DATE).desc())
    d = long.withColumns({"_k": F.row_number().over(w), "_y": F.max(F.year(DATE)).over(Window.partitionBy("series"))})
    growth = lambda cond: F.product(F.when(cond, 1.0 + F.col("ret")).otherwise(1.0)) - 1.0
    return d.groupBy("series").agg(*[F.when(F.max("_k") >= n, growth(F.col("_k") <= n)).alias(f"last_{n}") for n in spans],
                                   growth(F.year(DATE) == F.col("_y")).alias("ytd"))


def rolling_compound(long: DataFrame, n: int, out: str = "window_ret") -> DataFrame:
    """Compounded return over the last ``n`` rows of every series, full windows only."""
    w = Window.partitionBy("series").orderBy(DATE).rowsBetween(1 - n, 0)
    return long.withColumn(out, F.when(F.count("ret").over(w) >= n, F.product(1.0 + F.col("ret")).over(w) - 1.0))


def rolling_odds(long: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """Samples, negative share and odds (positive / negative) of rolling compounded returns."""
    parts = []
    for n in spans:
        d = rolling_compound(long, n).where("window_ret is not null")
        neg = F.sum((F.col("window_ret") < 0).cast("bigint"))
        total = F.count(F.lit(1))
        parts.append(d.groupBy("series").agg(F.lit(n).alias("window"), total.alias("samples"), neg.alias("negative"),
                                             (neg / total).alias("negative_share"), F.try_divide(total - neg, neg).alias("odds")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def runs(long: DataFrame, flag: str) -> DataFrame:
    """Maximal runs of consecutive rows where ``flag`` holds: start, end, length."""
    w = Window.partitionBy("series").orderBy(DATE)
    d = long.withColumn("_i", F.row_number().over(w)).where(F.col(flag))
    d = d.withColumn("_g", F.col("_i") - F.row_number().over(w))
    return d.groupBy("series", "_g").agg(F.min(DATE).alias("start"), F.max(DATE).alias("end"), F.count(F.lit(1)).alias("length")).drop("_g")


def failure_segments(long: DataFrame, n: int) -> DataFrame:
    """Runs of negative rolling n-row returns."""
    d = rolling_compound(long, n).withColumn("_neg", F.coalesce(F.col("window_ret") < 0, F.lit(False)))
    return runs(d, "_neg")


def longest_underwater(long: DataFrame) -> DataFrame:
    """Longest run of rows below the running peak of the NAV."""
    from ..functions.stats import drawdown
    d = drawdown(long, ["series"], DATE, "ret").withColumn("_under", F.col("drawdown") < 0)
    longest = runs(d, "_under").groupBy("series").agg(F.max("length").alias("longest"))
    return long.select("series").distinct().join(longest, "series", "left").fillna(0, ["longest"])


def inverse_vol_allocation(wide: DataFrame, a: str, b: str, window: int = 252, minimum: int = 126, cap: float = 0.3) -> DataFrame:
    """Inverse-volatility split of two sleeves, the first capped; equal volatility before ``minimum`` rows."""
    w = ordered().rowsBetween(1 - window, 0)
    seen = F.count(F.lit(1)).over(w)
    vol = lambda c: F.when(seen >= minimum, F.stddev_samp(c).over(w)).otherwise(1.0)
    d = wide.withColumns({"_va": vol(a), "_vb": vol(b)})
    raw = F.when((F.col("_va") > 0) & (F.col("_vb") > 0), (1.0 / F.col("_va")) / (1.0 / F.col("_va") + 1.0 / F.col("_vb"))).otherwise(0.5)
    first = F.least(raw, F.lit(cap))
    return d.select(DATE, first.alias(a), (1.0 - first).alias(b))


def period_returns(long: DataFrame, unit: str) -> DataFrame:
    """Compounded return per series and calendar period."""
    return long.groupBy("series", F.trunc(DATE, unit).alias("period")).agg((F.product(1.0 + F.col("ret")) - 1.0).alias("period_return"))
