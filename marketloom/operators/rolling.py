"""Row-frame statistics per symbol.

A frame runs over one symbol's bars: the panel holds one row per session and symbol, so the
length of a partition is the length of the calendar however the raw records are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col
from ..session import importable

DATE, SYM = "trade_date", "symbol"


def frame(n: int, shift: int = 0, by: list[str] | None = None, order: str = DATE):
    return Window.partitionBy(*(by or [SYM])).orderBy(order).rowsBetween(-(n - 1) - shift, -shift)


def rolling(df: DataFrame, value: str, n: int, min_periods: int, aggs: dict[str, Callable[[str], Column]], shift: int = 0,
            by: list[str] | None = None, order: str = DATE) -> DataFrame:
    """Named aggregates over the last ``n`` rows (ending ``shift`` rows ago); null below ``min_periods`` values."""
    w = frame(n, shift, by, order)
    enough = F.count(value).over(w) >= min_periods
    return df.withColumns({name: F.when(enough, fn(value).over(w)) for name, fn in aggs.items()})


def group_numbers(p: pd.DataFrame, by: list[str]) -> np.ndarray:
    """0, 1, ... for each run of equal keys; a null key equals a null key."""
    new = np.zeros(len(p), bool)
    for c in by:
        code = pd.factorize(p[c], use_na_sentinel=False)[0]
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def per_group(df: DataFrame, by: list[str], order: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], fields: dict[str, str]) -> DataFrame:
    """``fn(rows, group numbers)`` over frames of many whole groups in order, a batch of rows at a time.

    One call a batch, not one a group, so its fixed cost is shared. Dates pass as day numbers.
    """
    importable(df.sparkSession)
    dates = [c for c, t in df.dtypes if t == "date"]
    rows = df.repartition(*by).withColumns({c: F.unix_date(c) for c in dates}).sortWithinPartitions(*by, *order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for p in parts:
            p = p if rest is None else pd.concat([rest, p], ignore_index=True)
            if len(p):
                g = group_numbers(p, by)
                last = int(np.searchsorted(g, g[-1]))  # its group may go on in the next batch
                if last:
                    yield fn(p.iloc[:last], g[:last])
                rest = p.iloc[last:].reset_index(drop=True)
        if rest is not None:
            yield fn(rest, np.zeros(len(rest), np.int64))

    out = rows.mapInPandas(run, ", ".join(f"`{c}` {'int' if t == 'date' else t}" for c, t in fields.items()))
    return out.withColumns({c: F.date_from_unix_date(c) for c, t in fields.items() if t == "date"})


def median(value: str) -> Column:
    return F.percentile(value, F.lit(0.5))


def pct_change(value: str | Column, n: int = 1, by: list[str] | None = None, order: str = DATE, pad: bool = False) -> Column:
    """n-row change; with ``pad`` missing values repeat the last known one first."""
    w = Window.partitionBy(*(by or [SYM])).orderBy(order)
    now, then = col(value), F.lag(value, n).over(w)
    if pad:
        now = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        then = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -n))
    return F.try_divide(now, then) - 1.0


def market_lookback(df: DataFrame, calendar: DataFrame, formation: DataFrame, value: str, spans: tuple[int, ...] = (20, 60),
                    coverage: float = 0.75) -> DataFrame:
    """On formation dates: today's value and mean / median / count over the last n MARKET sessions.

    The frame is a range over the dense session index, so a symbol's missing days count as missing.
    """
    import math

    d = df.join(calendar.select(DATE, "session"), DATE)
    cols = {"turnover_1d": F.col(value)}
    for n in spans:
        w = Window.partitionBy(SYM).orderBy("session").rangeBetween(1 - n, 0)
        seen = F.count(value).over(w)
        ok = seen >= math.ceil(n * coverage)
        cols |= {f"turnover_mean_{n}d": F.when(ok, F.avg(value).over(w)), f"turnover_median_{n}d": F.when(ok, median(value).over(w)),
                 f"turnover_observations_{n}d": seen}
    return d.withColumns(cols).join(formation.select(DATE), DATE, "left_semi").select(DATE, SYM, *cols)
