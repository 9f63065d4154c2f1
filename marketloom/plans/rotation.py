"""Rotation between a few assets: momentum, schedule, targets, periods and daily reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import fail_where
from ..operators.keys import keep_one

DATE, SYM = "trade_date", "symbol"


def ordered():
    """Date-level tables only: one row per session."""
    return Window.orderBy(DATE)


def common_panel(prices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adjusted open and close on the dates where every symbol of the panel has both; ``by`` names several panels' keys."""
    by = by or []
    p = prices.withColumns({"adj_open": F.col("open") * F.col("adj_factor"), "adj_close": F.col("close") * F.col("adj_factor")})
    p = fail_where(p, (F.col("adj_open") <= 0) | (F.col("adj_close") <= 0), "adj_open", "adjusted prices must be positive")
    p = keep_one(p.where("adj_open is not null and adj_close is not null").select(*by, DATE, SYM, "adj_open", "adj_close"), [*by, DATE, SYM], ["adj_open"], "last")
    total = p.groupBy(*by).agg(F.countDistinct(SYM).alias("_all"))
    full = p.groupBy(*by, DATE).agg(F.count(F.lit(1)).alias("_all")).join(total, [*by, "_all"], "left_semi")
    return p.join(full.select(*by, DATE), [*by, DATE], "left_semi")


def momentum(wide: DataFrame, first: str, second: str, lookback: int) -> DataFrame:
    """Lookback return of two assets; the stronger one, the first on a tie."""
    m = {f"{n}_momentum": F.col(c) / F.lag(c, lookback).over(ordered()) - 1.0 for n, c in (("first", first), ("second", second))}
    d = wide.withColumns(m).where("first_momentum is not null and second_momentum is not null")
    stronger = F.when(F.col("second_momentum") > F.col("first_momentum"), second).otherwise(first)
    return d.select(DATE, "first_momentum", "second_momentum", stronger.alias("stronger"))


def targets(signals: DataFrame, kind: str, core: str, pair: tuple[str, str], core_weight: float, by: list[str]) -> DataFrame:
    """Weights per signal date: 'single' (the core alone), 'balanced' (core and both), 'core_satellite' (core and the stronger)."""
    sat = 1.0 - core_weight
    leg = lambda s, w: F.struct((s if not isinstance(s, str) else F.lit(s)).alias(SYM), F.lit(float(w)).alias("weight"))
    legs = {"single": [leg(core, 1.0)], "balanced": [leg(core, core_weight), leg(pair[0], sat / 2), leg(pair[1], sat / 2)],
            "core_satellite": [leg(core, core_weight), leg(F.col("stronger"), sat)]}[kind]
    picked = {"single": F.lit(core), "balanced": F.lit("balanced"), "core_satellite": F.col("stronger")}[kind]
    d = signals.withColumns({"_l": F.explode(F.array(*legs)), "selected_leg": picked})
    return d.select(*by, DATE, F.col(f"_l.{SYM}").alias(SYM), F.col("_l.weight").alias("weight"), "selected_leg").where("weight > 0")


def signal_periods(signals: DataFrame, calendar: DataFrame, by: list[str]) -> DataFrame:
    """Entry on the session after each signal, exit on the session after the next one (else the last session)."""
    from ..operators.calendar import sessions
    cal = sessions(calendar)
    last = cal.agg(F.max(DATE)).scalar()
    d = signals.select(*by, DATE).join(cal.select(DATE, F.col("next_date").alias("entry_date")), DATE)
    w = Window.partitionBy(*by).orderBy(DATE)
    d = d.withColumn("exit_date", F.coalesce(F.lead("entry_date").over(w), last))
    return d.where("entry_date < exit_date").select(*by, DATE, "entry_date", "exit_date")


def period_backtest(target: DataFrame, periods: DataFrame, prices: DataFrame, cost_bps: float, by: list[str]) -> DataFrame:
    """Per period: gross = Σ w·(exit / entry − 1), turnover = Σ|Δw|, fee = turnover × cost, net = gross − fee."""
    from ..operators.portfolio import weight_turnover
    px = lambda d: prices.select(F.col(DATE).alias(d), SYM, F.col("price").alias(f"_{d}"))
    h = target.join(periods, [*by, DATE]).join(px("entry_date"), ["entry_date", SYM]).join(px("exit_date"), ["exit_date", SYM])
    g = h.groupBy(*by, DATE, "entry_date", "exit_date").agg(F.sum(F.col("weight") * (F.col("_exit_date") / F.col("_entry_date") - 1.0)).alias("gross_return"))
    held = target.join(periods.select(*by, DATE), [*by, DATE], "left_semi")
    t = weight_turnover(held.select(*by, DATE, SYM, "weight"), by).withColumnRenamed("traded", "turnover")
    d = g.join(t, [*by, DATE]).withColumn("fee_cost", F.col("turnover") * cost_bps / 10000.0)
    return d.withColumn("net_return", F.col("gross_return") - F.col("fee_cost"))


def daily_reconstruction(result: DataFrame, target: DataFrame, prices: DataFrame, calendar: DataFrame, by: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Daily returns from fixed shares inside each period; the period cost falls on its first day.

    Periods of one strategy do not overlap (each exit is the next entry), so a session belongs to one period.
    """
    from ..operators.calendar import last_session_before
    days = last_session_before(calendar.select(DATE).distinct(), result.select(F.col("entry_date").alias(DATE)).distinct(), "entry_date")
    r = result.select(*by, F.col(DATE).alias("rebalance_date"), "entry_date", "exit_date", "gross_return", "net_return")
    d = r.join(days.where("entry_date is not null"), "entry_date").where(F.col(DATE) <= F.col("exit_date"))
    shares = target.select(*by, F.col(DATE).alias("rebalance_date"), SYM, "weight")
    p0 = prices.select(F.col(DATE).alias("entry_date"), SYM, F.col("price").alias("_p0"))
    v = (d.join(shares, [*by, "rebalance_date"]).join(p0, ["entry_date", SYM]).join(prices.select(DATE, SYM, "price"), [DATE, SYM])
         .groupBy(*by, "rebalance_date", "exit_date", "gross_return", "net_return", DATE).agg(F.sum(F.col("weight") * F.col("price") / F.col("_p0")).alias("_v")))
    w = Window.partitionBy(*by, "rebalance_date").orderBy(DATE)
    v = v.withColumns({"gross_daily": F.col("_v") / F.coalesce(F.lag("_v").over(w), F.lit(1.0)) - 1.0, "_first": F.row_number().over(w) == 1})
    bad = (F.col(DATE) == F.col("exit_date")) & (F.abs(F.col("_v") - 1.0 - F.col("gross_return")) > tolerance)
    v = fail_where(v, bad, "gross_daily", "daily reconstruction does not match the period return")
    factor = (1.0 + F.col("net_return")) / (1.0 + F.col("gross_return"))
    net = F.when(F.col("_first"), (1.0 + F.col("gross_daily")) * factor - 1.0).otherwise(F.col("gross_daily"))
    return v.select(*by, "rebalance_date", DATE, "gross_daily", net.alias("net_daily"))


def summary(result: DataFrame, daily: DataFrame, target: DataFrame, by: list[str], year: int = 252) -> DataFrame:
    """Net metrics, cost drag, leg switches, turnover and fees per strategy."""
    from ..functions.stats import annualised, compound, growth, sharpe
    n = F.count(F.lit(1))
    d = daily.groupBy(*by).agg(n.alias("days"), compound("net_daily").alias("total_return"), annualised(growth("net_daily"), n, year).alias("annual_return"),
                               sharpe("net_daily", 1, year).alias("sharpe"), compound("gross_daily").alias("gross_total_return"))
    p = result.groupBy(*by).agg(n.alias("periods"), F.sum("turnover").alias("turnover_sum"), F.sum("fee_cost").alias("fee_cost_sum"))
    w = Window.partitionBy(*by).orderBy(DATE)
    legs = target.groupBy(*by, DATE).agg(F.min("selected_leg").alias("_l")).withColumn("_c", (F.col("_l") != F.lag("_l").over(w)).cast("bigint"))
    s = legs.groupBy(*by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("switches"))
    return d.join(p, by).join(s, by).withColumn("cost_drag", F.col("gross_total_return") - F.col("total_return"))


def linear_cost_stress(result: DataFrame, base_bps: float, grid: list[float], by: list[str]) -> DataFrame:
    """Fees scaled linearly over a cost grid, on the few period rows."""
    from ..functions.expr import with_scenarios
    from ..functions.stats import compound
    d = with_scenarios(result, ["cost_bps"], [(float(c),) for c in grid]).withColumn("_fee", F.col("fee_cost") * F.col("cost_bps") / base_bps)
    d = d.withColumn("_net", F.col("gross_return") - F.col("_fee"))
    return d.groupBy(*by, "cost_bps").agg(F.count(F.lit(1)).alias("periods"), F.sum("_fee").alias("fee_sum"), compound("_net").alias("total_return"))
