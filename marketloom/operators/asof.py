"""As-of and interval joins.

Backward as-of is a union with a running aggregate per symbol. Events are first reduced to one
row per symbol and date, so a symbol's partition is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DATE, SYM = "trade_date", "symbol"


def latest_pit_fields(events: DataFrame, formation: DataFrame, fields: list[str], priority: list[str],
                      available: str = "available_date", seq: str = "seq") -> DataFrame:
    """Per field, the non-null value of highest priority among events available on or before the date.

    Equal priorities keep the first seen (lowest ``seq``).
    """
    best = {f: F.max(F.when(F.col(f).isNotNull(), F.struct(
        *[F.col(p).alias(f"p{i}") for i, p in enumerate(priority)], (-F.col(seq)).alias("s"), F.col(f).alias("v")))) for f in fields}
    per_day = events.groupBy(SYM, F.col(available).alias(DATE)).agg(*[a.alias(f) for f, a in best.items()])
    asked = formation.select(SYM, DATE).distinct()
    both = per_day.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(SYM).orderBy(DATE).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.select(SYM, DATE, "_ask", *[F.max(f).over(w).alias(f) for f in fields]).where("_ask")
    return formation.join(run.select(SYM, DATE, *[F.col(f"{f}.v").alias(f) for f in fields]), [SYM, DATE], "left")


def latest_row_asof(facts: DataFrame, panel: DataFrame, columns: list[str], available: str, order: list[str] | None = None) -> DataFrame:
    """Statement values announced on or before each panel date (the newest non-null of each column).

    Of several statements on one day the last in ``order`` counts (report period, sequence), then the larger value.
    """
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order or [])], F.col(c).alias("v"))))["v"]
    per_day = facts.groupBy(SYM, F.col(available).alias(DATE)).agg(*[newest(c).alias(c) for c in columns])
    both = (per_day.withColumn("_ask", F.lit(False))
            .unionByName(panel.select(SYM, DATE).distinct().withColumn("_ask", F.lit(True)), allowMissingColumns=True))
    w = Window.partitionBy(SYM).orderBy(DATE).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    day = both.groupBy(SYM, DATE).agg(F.max("_ask").alias("_ask"), *[F.max(c).alias(c) for c in columns])
    run = day.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).where("_ask").drop("_ask")
    return panel.join(run, [SYM, DATE], "left")


def interval_value(panel: DataFrame, spells: DataFrame, value: str, start: str = "in_date", end: str = "out_date") -> DataFrame:
    """Attach the value whose [start, end) holds the date; an open end is active; unmatched stays null."""
    s = spells.select(F.col(SYM).alias("_sym"), start, end, value)
    on = ((F.col(SYM) == F.col("_sym")) & (F.col(DATE) >= F.col(start))
          & (F.col(end).isNull() | (F.col(DATE) < F.col(end))))
    return panel.join(s, on, "left").drop("_sym", start, end)


def expand_intervals(spells: DataFrame, dates: DataFrame, start: str, end: str) -> DataFrame:
    """Closed intervals onto formation dates: months of an interval, an equi join on month, then the exact bounds."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(F.col(end), "MM"), F.expr("interval 1 month"))
    m = spells.where(F.col(start) <= F.col(end)).withColumn("_m", F.explode(months))
    cal = dates.select(DATE, F.trunc(DATE, "MM").alias("_m"))
    return m.join(cal, "_m").where(F.col(DATE).between(F.col(start), F.col(end))).select(DATE, SYM).distinct()


def forward_pair_return(dates: DataFrame, prices: DataFrame, price: str, limit: float = 0.5) -> DataFrame:
    """price(t+2) / price(t+1) − 1 along the list of dates; non-positive prices and outliers leave."""
    w = Window.orderBy(DATE)  # the date list
    steps = dates.select(DATE).distinct().withColumns({"d1": F.lead(DATE, 1).over(w), "d2": F.lead(DATE, 2).over(w)})
    p1 = prices.where(F.col(price) > 0).select(SYM, F.col(DATE).alias("d1"), F.col(price).alias("_p1"))
    p2 = prices.where(F.col(price) > 0).select(SYM, F.col(DATE).alias("d2"), F.col(price).alias("_p2"))
    out = steps.join(p1, "d1").join(p2, ["d2", SYM]).withColumn("label", F.col("_p2") / F.col("_p1") - 1.0)
    return out.where(F.abs("label") <= limit).select(DATE, SYM, "label")
