"""Event signals on bars: oscillators, event pairs, filters, entries, exits and marks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import flag, with_scenarios
from .calendar import sessions
from .ordering import quantiles
from .rolling import per_group

DATE, SYM = "trade_date", "symbol"


def by_symbol():
    """Rows of one symbol in session order; the calendar bounds them."""
    return Window.partitionBy(SYM).orderBy(DATE)


def macd(df: DataFrame, price: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """DIF, DEA, bar and cross flags. The recursion needs one symbol's bars in order: pandas over batches of whole
    symbols, whose rows the calendar bounds; symbols run in parallel."""
    fields = {DATE: "date", SYM: dict(df.dtypes)[SYM], price: "double", "dif": "double", "dea": "double", "bar": "double", "golden": "boolean", "dead": "boolean"}

    def run(p: pd.DataFrame, g: np.ndarray) -> pd.DataFrame:
        mean = lambda s, n: s.groupby(g).ewm(span=n, adjust=False, min_periods=n).mean().set_axis(p.index)
        dif = mean(p[price], fast) - mean(p[price], slow)
        dea = mean(dif, signal)
        was, was_dea = dif.groupby(g).shift(1), dea.groupby(g).shift(1)  # comparisons with a missing side are false
        return pd.DataFrame({DATE: p[DATE], SYM: p[SYM], price: p[price], "dif": dif, "dea": dea, "bar": 2.0 * (dif - dea),
                             "golden": (dif > dea) & (was <= was_dea), "dead": (dif < dea) & (was >= was_dea)})

    return per_group(df.select(F.col(DATE).cast("date"), SYM, F.col(price).cast("double")), [SYM], [DATE], run, fields)


def row_index(df: DataFrame) -> DataFrame:
    return df.withColumn("idx", F.row_number().over(by_symbol()))


def event_pairs(df: DataFrame, event: str, max_gap: int = 20) -> DataFrame:
    """Second of two consecutive events of a symbol at most ``max_gap`` of its rows apart."""
    e = row_index(df).where(F.col(event))
    gap = F.col("idx") - F.lag("idx").over(by_symbol())
    return (e.withColumns({"first_date": F.lag(DATE).over(by_symbol()), "gap": gap}).where(F.col("gap") <= max_gap)
            .select(SYM, F.col("first_date"), F.col(DATE), "gap"))


def add_windows(df: DataFrame, turnover: str = "turnover_rate", high: str = "high", low: str = "low", n_turnover: int = 35,
                n_range: int = 126) -> DataFrame:
    """Turnover sum and high / low extremes over full row windows."""
    short, long = by_symbol().rowsBetween(1 - n_turnover, 0), by_symbol().rowsBetween(1 - n_range, 0)
    full = lambda c, w, n, v: F.when(F.count(c).over(w) >= n, v)
    return df.withColumns({
        "turnover_sum": full(turnover, short, n_turnover, F.sum(turnover).over(short)),
        "range_high": full(high, long, n_range, F.max(high).over(long)),
        "range_low": full(low, long, n_range, F.min(low).over(long))})


def filter_flags(conditions: dict[str, Column]) -> dict[str, Column]:
    """Each condition as a flag; unknown is false."""
    return {name: F.coalesce(c, F.lit(False)) for name, c in conditions.items()}


def next_session_entry(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signal-day and next-session bars; entry blocked by suspension, special treatment or a limit-up open."""
    cal = sessions(bars).select(DATE, F.col("next_date").alias("entry_date"))
    today = bars.select(DATE, SYM, "close")
    nxt = bars.select(F.col(DATE).alias("entry_date"), SYM, F.col("open").alias("_open"), F.col("up_limit").alias("_up"),
                      F.col("is_suspended").alias("_susp"), F.col("is_st").alias("_st"))
    d = signals.join(today, [DATE, SYM], "left").join(cal, DATE, "left").join(nxt, ["entry_date", SYM], "left")
    at_limit = F.coalesce(F.col("_open") >= F.col("_up") * 0.999, F.lit(False))
    ok = F.col("_open").isNotNull() & ~flag("_susp", True) & ~flag("_st", True) & ~at_limit
    return d.withColumns({"entry_ok": ok, "entry_price": F.when(ok, F.col("_open"))}).drop("_open", "_up", "_susp", "_st")


def candidate_exits(signals: DataFrame, bars: DataFrame, hold: int | None = None, exit_flag: str = "golden") -> DataFrame:
    """Exit of each signal were it taken alone: after ``hold`` rows, or at the first later flagged row."""
    if hold is not None:
        out = {"exit_date": F.lead(DATE, hold).over(by_symbol()), "exit_price": F.lead("close", hold).over(by_symbol())}
    else:
        later = Window.partitionBy(SYM).orderBy(F.col(DATE).desc()).rowsBetween(Window.unboundedPreceding, -1)  # running, not quadratic
        hit = F.min(F.when(F.col(exit_flag), F.struct(DATE, "close"))).over(later)
        out = {"exit_date": hit[DATE], "exit_price": hit["close"]}
    e = bars.withColumns(out).select(F.col(DATE).alias("entry_date"), SYM, "exit_date", "exit_price")
    return signals.join(e, ["entry_date", SYM])


def nonoverlapping(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per symbol in signal order, skip a signal entering on or before the previous exit; a signal that never
    exits blocks the rest. Greedy by nature, so a loop over the few candidate signals, many symbols a call."""
    c = candidates.where("entry_price > 0").select(*by, SYM, "signal_date", "entry_date", "entry_price", "exit_date", "exit_price")

    def run(p: pd.DataFrame, g: np.ndarray) -> pd.DataFrame:
        keep, now, bound = [], -1, None
        for group, entry, exit_ in zip(g.tolist(), p["entry_date"].tolist(), p["exit_date"].tolist(), strict=True):
            if group != now:
                now, bound = group, None
            free = bound is None or entry > bound
            keep.append(free and exit_ == exit_)
            if free:
                bound = exit_ if exit_ == exit_ else float("inf")
        return p.loc[keep]

    return per_group(c, [*by, SYM], ["signal_date", "entry_date"], run, dict(c.dtypes)).withColumn(
        "gross_return", F.col("exit_price") / F.col("entry_price") - 1.0)


def trade_marks(trades: DataFrame, bars: DataFrame, by: list[str]) -> DataFrame:
    """Mark-to-mark return of every open trade on every bar after entry; the exit day marks at the exit price.

    A trade meets its symbol's bars month by month, not the symbol's whole history.
    """
    b = bars.select(DATE, F.col(SYM).alias("_sym"), F.col("close").alias("_close"), F.trunc(DATE, "MM").alias("_bm"))
    months = F.sequence(F.trunc("entry_date", "MM"), F.trunc("exit_date", "MM"), F.expr("interval 1 month"))
    t = trades.where("entry_date <= exit_date").select(*by, SYM, "entry_date", "entry_price", "exit_date", "exit_price", F.explode(months).alias("_tm"))
    held = t.join(b, (F.col(SYM) == F.col("_sym")) & (F.col("_tm") == F.col("_bm")) & F.col(DATE).between(F.col("entry_date"), F.col("exit_date"))).drop("_tm", "_bm")
    mark = F.when(F.col(DATE) == F.col("exit_date"), F.col("exit_price")).otherwise(F.col("_close"))
    w = Window.partitionBy(*by, SYM, "entry_date").orderBy(DATE)  # one trade's sessions
    d = held.withColumn("mark", mark).withColumn("_prev", F.coalesce(F.lag("mark").over(w), F.col("entry_price")))
    return d.where("_prev > 0 and mark > 0").withColumn("ret", F.col("mark") / F.col("_prev") - 1.0)


def position_curve(trades: DataFrame, bars: DataFrame, policies: list[str], by: list[str] | None = None) -> DataFrame:
    """Daily mean mark return and open positions per exit policy; days without a mark return zero."""
    by = by or ["exit_policy"]
    marks = trade_marks(trades, bars, by).groupBy(*by, DATE).agg(F.avg("ret").alias("_r"))
    flow = (trades.select(*by, F.col("entry_date").alias(DATE), F.lit(1).alias("_n"))
            .unionByName(trades.select(*by, F.col("exit_date").alias(DATE), F.lit(-1).alias("_n")))
            .groupBy(*by, DATE).agg(F.sum("_n").alias("_n")))
    grid = with_scenarios(sessions(bars).select(DATE), by, [(p,) for p in policies])
    w = Window.partitionBy(*by).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    d = grid.join(marks, [*by, DATE], "left").join(flow, [*by, DATE], "left")
    return d.select(*by, DATE, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("n_positions"),
                    F.coalesce("_r", F.lit(0.0)).alias("portfolio_return"))


def trade_metrics(trades: DataFrame, by: list[str], r: str = "net_return") -> DataFrame:
    """Count, win rate, mean and exact median of returns and holding days per policy."""
    base = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((F.col(r) > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_return"),
        F.avg("hold_days").alias("avg_hold_days"))
    for value, name in ((r, "median_return"), ("hold_days", "median_hold_days")):
        base = base.join(quantiles(trades, by, value, {name: 0.5}).drop("n"), by, "left")
    return base


def first_fill(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """First session on or after each order's date on which it can trade; blocked sessions until then.

    Needs tradable / limit_up / limit_down on the bars; buys stop at limit-up, sells at limit-down.
    """
    side = F.explode(F.array(F.struct(F.lit("buy").alias("side"), (F.col("tradable") & ~F.col("limit_up")).alias("ok")),
                             F.struct(F.lit("sell").alias("side"), (F.col("tradable") & ~F.col("limit_down")).alias("ok"))))
    ok = bars.select(SYM, DATE, side.alias("_o")).where("_o.ok").select(SYM, F.col("_o.side").alias("side"), DATE, F.col(DATE).alias("_fill"))
    asked = orders.select(SYM, "side", F.col("execution_date").alias(DATE)).distinct().withColumn("_fill", F.lit(None).cast("date"))
    day = ok.unionByName(asked).groupBy(SYM, "side", DATE).agg(F.max("_fill").alias("_fill"))
    w = Window.partitionBy(SYM, "side").orderBy(F.col(DATE).desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = day.withColumn("fill_date", F.min("_fill").over(w)).select(SYM, "side", F.col(DATE).alias("execution_date"), "fill_date")
    cal = sessions(bars).select(DATE, "session")
    out = orders.join(found, [SYM, "side", "execution_date"], "left")
    out = out.join(cal.select(F.col(DATE).alias("execution_date"), F.col("session").alias("_a")), "execution_date", "left")
    out = out.join(cal.select(F.col(DATE).alias("fill_date"), F.col("session").alias("_b")), "fill_date", "left")
    return out.withColumn("blocked_days", (F.col("_b") - F.col("_a")).cast("bigint")).drop("_a", "_b")
