"""Trading calendars: date-level tables, one row per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DATE = "trade_date"


def sessions(df: DataFrame, date: str = DATE) -> DataFrame:
    """Distinct sessions with a dense index and both neighbours."""
    w = Window.orderBy(DATE)  # one row per session
    return (df.select(F.col(date).alias(DATE)).distinct()
            .withColumn("session", F.row_number().over(w))
            .withColumn("next_date", F.lead(DATE).over(w))
            .withColumn("prev_date", F.lag(DATE).over(w)))


def month_ends(df: DataFrame, date: str = DATE) -> DataFrame:
    """Last session of every calendar month."""
    return df.groupBy(F.trunc(date, "MM").alias("month")).agg(F.max(date).alias(DATE))


def rebalance_dates(dates: DataFrame, frequency: str, date: str = DATE) -> DataFrame:
    """Signal dates of a schedule; the last two sessions are out, the first eligible is always in."""
    w = Window.orderBy(F.col(date).desc())
    cal = dates.select(date).distinct().withColumn("_back", F.row_number().over(w))
    eligible = cal.where("_back > 2").select(date)
    if frequency == "daily":
        return eligible
    if frequency == "initial":
        return eligible.agg(F.min(date).alias(date))
    unit = {"weekly": "week", "monthly": "month"}[frequency]
    last = eligible.groupBy(F.date_trunc(unit, date).alias("_p")).agg(F.max(date).alias(date)).select(date)
    return last.union(eligible.agg(F.min(date).alias(date))).distinct()


def next_session(dates: DataFrame, calendar: DataFrame, date: str, out: str, strict: bool = True) -> DataFrame:
    """First session after (or on, when not strict) each date, on or off the calendar.

    Union plus a backward running minimum over distinct dates: no range join.
    """
    asked = dates.select(F.col(date).cast("date").alias("_d")).where("_d is not null").distinct()
    both = (asked.withColumn("_s", F.lit(None).cast("date"))
            .unionByName(calendar.select(F.col(DATE).alias("_d"), F.col(DATE).alias("_s")).distinct()))
    per_date = both.groupBy("_d").agg(F.max("_s").alias("_s"))
    frame = Window.orderBy(F.col("_d").desc()).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    found = per_date.withColumn(out, F.min("_s").over(frame)).select(F.col("_d").alias(date), out)
    return dates.join(found, date, "left")


def last_session_before(dates: DataFrame, marks: DataFrame, out: str, strict: bool = True) -> DataFrame:
    """Latest mark strictly before (or on) each date; both sides are date-level tables."""
    both = (dates.select(F.col(DATE).alias("_d")).distinct().withColumn("_m", F.lit(None).cast("date"))
            .unionByName(marks.select(F.col(DATE).alias("_d"), F.col(DATE).alias("_m")).distinct()))
    per_date = both.groupBy("_d").agg(F.max("_m").alias("_m"))
    frame = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    found = per_date.withColumn(out, F.max("_m").over(frame)).select(F.col("_d").alias(DATE), out)
    return dates.join(found, DATE, "left")


def holding_periods(signals: DataFrame, calendar: DataFrame, date: str = DATE) -> DataFrame:
    """Entry is the session after a signal, exit the session after the next one (else the last session)."""
    w = Window.orderBy("signal_date")
    s = next_session(signals.select(F.col(date).alias("signal_date")).distinct(), calendar, "signal_date", "entry_date")
    s = s.where("entry_date is not null").withColumn("_exit", F.lead("entry_date").over(w))
    last = calendar.agg(F.max(DATE)).scalar()
    return (s.select("signal_date", "entry_date", F.coalesce(F.col("_exit"), last).alias("exit_date"))
            .where("exit_date > entry_date"))
