"""Technical and score-history features per symbol (row frames over one symbol's sessions)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bias_corrected_kurtosis, bias_corrected_skew
from .ordering import ranked
from .rolling import DATE, SYM, frame, per_group
from .xsection import with_stats



def by_symbol():
    """Rows of one symbol in session order; the calendar bounds them."""
    return Window.partitionBy(SYM).orderBy(DATE)


def earlier(x: np.ndarray, k: int, idx: np.ndarray) -> np.ndarray:
    """The value ``k`` rows before, NaN outside the symbol."""
    out = np.full(len(x), np.nan)
    out[k:] = x[: len(x) - k]
    out[idx <= k] = np.nan
    return out


def spaced(x: np.ndarray, n: int, g: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """``x`` with ``n`` - 1 times ``gap`` before each symbol, so that a slice is all rows' k-th earlier value; and the rows' places."""
    at = np.arange(len(x)) + (n - 1) * (g + 1)
    out = np.full(at[-1] + 1 if len(x) else 0, gap)
    out[at] = x
    return out, at


def window_moments(x: np.ndarray, n: int, g: np.ndarray, top: int) -> list[np.ndarray]:
    """Count, mean and the sums of the powers 2 .. ``top`` of the deviations from it over the last ``n`` rows; NaN is missing."""
    v, at = spaced(x, n, g, np.nan)
    size = len(v) - n + 1
    seen = ~np.isnan(v)
    upto = np.concatenate([[0], np.cumsum(seen)])
    count = (upto[n:] - upto[:-n]).astype(float)
    known, present = np.where(seen, v, 0.0), seen.astype(float)
    total = np.zeros(size)
    for k in range(n):
        total += known[k : k + size]
    mean = np.where(count > 0, total / np.maximum(count, 1), np.nan)
    centre = np.nan_to_num(mean)
    sums = [np.zeros(size) for _ in range(2, top + 1)]
    for k in range(n) if sums else ():
        d = known[k : k + size] - centre
        d *= present[k : k + size]
        power = d
        for s in sums:
            power = power * d
            s += power
    return [a[at - (n - 1)] for a in (count, mean, *sums)]


def age_of_extreme(x: np.ndarray, n: int, g: np.ndarray) -> np.ndarray:
    """Rows since the maximum of the last ``n``, the earliest of equal ones."""
    v, at = spaced(x, n, g, np.nan)
    size = len(v) - n + 1
    best, age = np.full(size, np.nan), np.zeros(size)
    for k in range(n):  # from the oldest
        now = v[k : k + size]
        take = (now == now) & ~(now <= best)  # the first one always
        np.copyto(best, now, where=take)
        np.copyto(age, n - 1 - k, where=take)
    return age[at - (n - 1)]


BARS = ["open", "close", "high", "low", "vol"]
STATS = ["_l12", "_l18", "_l20", "_l120", "_sd120", "_skew60", "_kurt60", "_tr20", "_vol5", "_vol20", "_up", "_down", "_sd5", "_mean5"]


def window_stats(p: pd.DataFrame, g: np.ndarray, min_rows: int) -> pd.DataFrame:
    """Statistics of the row windows for many whole symbols at once: one array operation for each row of a window."""
    start = np.searchsorted(g, g)
    idx = np.arange(len(g)) - start + 1
    close, high, low, vol = (p[c].to_numpy(float) for c in BARS[1:])
    before = earlier(close, 1, idx)
    with np.errstate(all="ignore"):
        ret = np.where(before != 0, close / before - 1.0, np.nan)
        reach = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        out = {f"_l{n}": earlier(close, n, idx) for n in (12, 18, 20, 120)}
        n, _, s2 = window_moments(ret, 120, g, 2)
        out["_sd120"] = np.where(n > 1, np.sqrt(s2 / (n - 1)), np.nan)
        n, _, s2, s3, s4 = window_moments(ret, 60, g, 4)
        spread = (n > 0) & (s2 > 0)
        out["_skew60"] = np.where(spread, np.sqrt(n) * s3 / np.sqrt(s2 * s2 * s2), np.nan)
        out["_kurt60"] = np.where(spread, n * s4 / (s2 * s2) - 3.0, np.nan)
        out["_tr20"] = window_moments(reach, 20, g, 1)[1]
        out["_vol5"], out["_vol20"] = window_moments(vol, 5, g, 1)[1], window_moments(vol, 20, g, 1)[1]
        out["_up"] = age_of_extreme(np.nan_to_num(high, nan=-np.inf), 25, g)
        out["_down"] = age_of_extreme(-np.nan_to_num(low, nan=-np.inf), 25, g)
        n, mean, s2 = window_moments(close, 5, g, 2)
        out["_sd5"], out["_mean5"] = np.where(n > 1, np.sqrt(s2 / (n - 1)), np.nan), mean
    return pd.DataFrame({**{c: p[c].to_numpy() for c in (DATE, SYM, *BARS)}, "idx": idx, **out})[idx >= min_rows]


def indicators(df: DataFrame, min_rows: int = 60, year: int = 252) -> DataFrame:
    """Rate of change, long return and volatility, higher moments, ATR, volume ratio, Aroon, dispersion."""
    kinds = dict(df.dtypes)
    bars = df.select(DATE, SYM, *[F.col(c).cast("double").alias(c) for c in BARS])
    d = per_group(bars, [SYM], [DATE], lambda p, g: window_stats(p, g, min_rows), {DATE: kinds[DATE], SYM: kinds[SYM], **dict.fromkeys(BARS, "double"), "idx": "int", **dict.fromkeys(STATS, "double")})
    full = lambda n, v: F.when(F.col("idx") > n, v).otherwise(0.0)  # noqa: E731  (the first row has no return)
    n60 = F.lit(60.0)
    back = lambda n: F.coalesce(F.col("close") / F.col(f"_l{n}") - 1.0, F.lit(0.0))
    feats = {f"roc_{n}": back(n) for n in (12, 18, 20)}
    feats |= {
        "cumret_120": back(120),  # the product of 120 returns telescopes
        "vol_120": full(120, F.col("_sd120") * F.sqrt(F.lit(float(year)))),
        "skew_60": full(60, bias_corrected_skew(n60, F.col("_skew60"))), "kurt_60": full(60, bias_corrected_kurtosis(n60, F.col("_kurt60"))),
        "atr_ratio": F.col("_tr20") / F.col("close"), "vol_ratio": F.col("_vol5") / F.col("_vol20"),
        "aroon_up": (25.0 - F.col("_up")) / 25.0 * 100.0, "aroon_down": (25.0 - F.col("_down")) / 25.0 * 100.0,
        "dispersion_5": F.col("_sd5") / F.col("_mean5"), "high_low": F.when(F.col("low") > 0, F.col("high") / F.col("low")).otherwise(1.0),
        "close_open": F.when(F.col("open") > 0, F.col("close") / F.col("open")).otherwise(1.0)}
    return d.select(DATE, SYM, *[c.alias(name) for name, c in feats.items()])


def score_history(df: DataFrame, score: str, first_dates: DataFrame | None = None) -> DataFrame:
    """Lags, means, changes and dispersion of an entity's score history, and its place in the day's cross-section."""
    if first_dates is not None:
        df = df.join(first_dates, SYM, "left").where(F.col("first_date").isNull() | (F.col(DATE) >= F.col("first_date"))).drop("first_date")
    s = F.col(score)
    seen = F.row_number().over(by_symbol())
    lag = lambda n: F.lag(score, n).over(by_symbol())
    mean = lambda n: F.when(seen >= n, F.avg(score).over(frame(n))).otherwise(s)
    sd = lambda n: F.when(seen >= n, F.stddev_pop(score).over(frame(n))).otherwise(0.0)
    d = df.select(DATE, SYM, score).withColumns({
        "c_lag1": F.coalesce(lag(1), F.lit(0.0)), "c_lag2": F.coalesce(lag(2), F.lit(0.0)), "c_ma3": mean(3), "c_ma5": mean(5), "c_ma10": mean(10),
        "c_chg1": s - F.coalesce(lag(1), F.lit(0.0)), "c_chg3": F.coalesce(s - lag(3), F.lit(0.0)), "c_chg5": F.coalesce(s - lag(5), F.lit(0.0)),
        "c_vol5": sd(5), "c_vol10": sd(10)})
    d = with_stats(d, [DATE], _m=F.avg(score), _s=F.stddev_pop(score), c_sum=F.sum(score), c_count=F.count(score), c_breadth=F.count_distinct(SYM))
    d = ranked(d, [DATE], score, "_r_")
    return d.withColumns({"c_zscore": F.when(F.col("_s") > 0, (s - F.col("_m")) / F.col("_s")).otherwise(0.0),
                          "c_rank_pct": (F.col("_r_min") - 1) / F.col("_r_n")}).drop("_m", "_s", "_r_avg", "_r_min", "_r_n")
