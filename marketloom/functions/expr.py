"""Column expressions shared by the operators."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Market suffixes, price-limit regimes in percent.
EXCHANGE_SUFFIXES = ("SH", "SZ", "BJ")
LIMIT_BANDS_PCT = (5.0, 10.0, 20.0, 30.0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: str | Column) -> Column:
    return F.when(F.isnan(col(c)), None).otherwise(col(c))


def safe_divide(num: str | Column, den: str | Column) -> Column:
    """num / den, null when the denominator is null or zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def to_number(c: str | Column) -> Column:
    """Coerce to double; anything unparsable becomes null."""
    return null_if_nan(F.expr(f"try_cast({c} as double)")) if isinstance(c, str) else null_if_nan(c.try_cast("double"))


def clip(c: str | Column, lo: float | Column, hi: float | Column) -> Column:
    """Bound a value, keeping null null (least/greatest skip nulls by themselves)."""
    x = col(c)
    lo, hi = (b if isinstance(b, Column) else F.lit(b) for b in (lo, hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def compact_date(c: str | Column) -> Column:
    """Date from ISO or compact text (first ten characters); null when it does not parse."""
    text = F.regexp_replace(F.substring(F.trim(col(c).cast("string")), 1, 10), "-", "")
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def strip_suffix(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "\\.(" + "|".join(EXCHANGE_SUFFIXES) + ")", "")


def market_suffix(c: str | Column) -> Column:
    return F.upper(F.substring_index(col(c), ".", -1))


def flag(c: str | Column, missing: bool = False) -> Column:
    """Boolean flag with an explicit value for missing."""
    return F.coalesce(col(c).cast("boolean"), F.lit(missing))


def limit_pct_raw(pre_close: str | Column, up_limit: str | Column) -> Column:
    return (safe_divide(up_limit, pre_close) - 1.0) * 100.0


def limit_band(pre_close: str | Column, up_limit: str | Column) -> Column:
    """Nearest known price-limit regime within one percentage point, else 'unknown'."""
    raw = limit_pct_raw(pre_close, up_limit)
    nearest = F.array_min(F.array(*[
        F.struct(F.abs(raw - b).alias("gap"), F.lit(f"{b:02.0f}pct").alias("name")) for b in LIMIT_BANDS_PCT
    ]))
    known = (col(pre_close) > 0) & (col(up_limit) > 0) & (nearest["gap"] <= 1.0)
    return F.when(known, nearest["name"]).otherwise(F.lit("unknown"))


def policy_name(take_profit: float | None) -> str:
    return "close" if take_profit is None else f"tp_{take_profit:.2%}".replace(".", "p")


def literal_rows(names: list[str], rows: list[tuple]) -> Column:
    """A fixed scenario list as an array of structs; explode it instead of cross joining."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, r, strict=True)]) for r in rows])


def with_scenarios(df, names: list[str], rows: list[tuple]):
    """Every row once per scenario (a narrow map, no join)."""
    return (df.withColumn("_scenario", F.explode(literal_rows(names, rows)))
            .select(*df.columns, *[F.col(f"_scenario.{k}").alias(k) for k in names]))


def add_all(cols: list[Column]) -> Column:
    return functools.reduce(operator.add, cols)


def all_of(cols: list[Column]) -> Column:
    return functools.reduce(operator.and_, cols)


def any_of(cols: list[Column]) -> Column:
    return functools.reduce(operator.or_, cols)


def fail_where(df, bad: Column, column: str, message: str):
    """Raise inside the job when ``bad`` holds on a row; the check rides on ``column``, so no extra pass is run."""
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit(message)).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def candle_features(open_="open", high="high", low="low", close="close", pre_close="pre_close",
                    amount="amount", pct_chg="pct_chg", total_mv="total_mv", turnover="turnover_rate") -> dict[str, Column]:
    """Shape, size and pressure features of one bar."""
    o, h, low_, c = col(open_), col(high), col(low), col(close)
    base = F.when(col(pre_close) > 0, col(pre_close)).otherwise(c)
    log_cap = F.log1p(F.greatest(col(total_mv), F.lit(0.0)))
    log_amount = F.log1p(F.greatest(col(amount), F.lit(0.0)))
    return {
        "daily_range": safe_divide(h - low_, base),
        "upper_shadow": safe_divide(h - F.greatest(o, c), base),
        "lower_shadow": safe_divide(F.least(o, c) - low_, base),
        "body_return": safe_divide(c, o) - 1.0,
        "close_pos": safe_divide(c - low_, h - low_),
        "gap_open": safe_divide(o, pre_close) - 1.0,
        "log_mcap": log_cap,
        "amount_log": log_amount,
        "mcap_turnover_interaction": log_cap * col(turnover),
        "small_high_turnover": -log_cap * col(turnover),
        "signed_amount_pressure": col(pct_chg) / 100.0 * log_amount,
    }
