"""Aggregate expressions over return series and cross-sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import add_all, col, safe_divide

YEAR = 252


def compound(r: str | Column) -> Column:
    """Compounded return of a group."""
    return F.product(1.0 + col(r)) - 1.0


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs, null for a constant side.

    From the covariance: ``corr`` divides by zero for a constant side before any condition on it is looked at.
    """
    pair = col(x).isNotNull() & col(y).isNotNull()
    px, py = F.when(pair, col(x).cast("double")), F.when(pair, col(y).cast("double"))
    varies = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    return F.when(varies, safe_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py)))


def growth(r: str | Column) -> Column:
    """Final value of one unit over a group."""
    return F.product(1.0 + col(r))


def annualised(final: Column, periods: Column, per_year: int = YEAR) -> Column:
    """Geometric annual return from the final value of one unit; null once capital is lost."""
    return F.when(final > 0.0, F.pow(final, F.lit(float(per_year)) / periods) - 1.0)


def sharpe(r: str | Column, ddof: int = 1, per_year: int = YEAR) -> Column:
    sd = F.stddev_samp(col(r)) if ddof else F.stddev_pop(col(r))
    return F.when(sd > 0, F.avg(col(r)) / sd * F.sqrt(F.lit(float(per_year))))


def nav(df: DataFrame, by: list[str], order: str, r: str, name: str = "nav") -> DataFrame:
    """Cumulative product per series; series are date-level tables, one row per date."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.product(1.0 + F.coalesce(col(r), F.lit(0.0))).over(w))


def drawdown(df: DataFrame, by: list[str], order: str, r: str) -> DataFrame:
    """Add nav, peak and drawdown per series."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (nav(df, by, order, r)
            .withColumn("peak", F.max("nav").over(w))
            .withColumn("drawdown", F.col("nav") / F.col("peak") - 1.0))


def hac_inputs(df: DataFrame, by: list[str], order: str, r: str, lags: int = 5) -> DataFrame:
    """Centre a series and add its lagged products, ready for :func:`hac_t`."""
    whole, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    out = df.where(col(r).isNotNull()).withColumn("_c", col(r) - F.avg(r).over(whole))
    for k in range(1, lags + 1):
        out = out.withColumn(f"_c{k}", F.col("_c") * F.lag("_c", k).over(ordered))
    return out


def hac_t(r: str, lags: int = 5) -> Column:
    """Newey-West t of the mean with Bartlett weights, over :func:`hac_inputs` rows."""
    n = F.count(F.col(r)).cast("double")
    lagged = [2.0 * (1.0 - k / (lags + 1.0)) * F.coalesce(F.sum(f"_c{k}"), F.lit(0.0)) / n for k in range(1, lags + 1)]
    variance = (F.sum(F.col("_c") * F.col("_c")) / n + add_all(lagged)) / n
    return F.when((F.count(F.col(r)) >= 2) & (variance > 0), F.avg(r) / F.sqrt(variance))


def newey_west(df: DataFrame, by: list[str], order: str, r: str, lags: int = 5, name: str = "hac_t") -> DataFrame:
    return hac_inputs(df, by, order, r, lags).groupBy(*by).agg(hac_t(r, lags).alias(name))


def welch_t(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Welch t statistic from two groups' counts, means and sample variances."""
    return safe_divide(m1 - m2, F.sqrt(v1 / n1 + v2 / n2))


def bias_corrected_skew(n: Column, g1: Column) -> Column:
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def bias_corrected_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n > 3, ((n + 1.0) * g2 + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)))
