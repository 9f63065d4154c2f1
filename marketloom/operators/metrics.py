"""Metrics of return series (long tables: series, trade_date, ret), attribution and gates."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import literal_rows
from ..functions.stats import annualised, compound, drawdown, growth, safe_corr, sharpe
from .ordering import ranked
from .series import longest_underwater

DATE = "trade_date"


def series_metrics(long: DataFrame, by: list[str], year: int = 252) -> DataFrame:
    """Days, cumulative, geometric annual, volatility, Sharpe (sample std), drawdown; in percent."""
    d = drawdown(long.where(F.col("ret").isNotNull()), by, DATE, "ret")
    n, total = F.count(F.lit(1)), compound("ret")
    return d.groupBy(*by).agg(
        n.alias("days"), (total * 100.0).alias("cumulative_return"), (annualised(growth("ret"), n, year) * 100.0).alias("geometric_annual_return"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(float(year))) * 100.0).alias("annual_volatility"), sharpe("ret", 1, year).alias("sharpe"),
        (F.min("drawdown") * 100.0).alias("max_drawdown"))


def return_stats(long: DataFrame, year: int = 252) -> DataFrame:
    """The same family as fractions, with first and last date and the longest underwater run."""
    d = drawdown(long.where(F.col("ret").isNotNull()), ["series"], DATE, "ret")
    n, total = F.count(F.lit(1)), compound("ret")
    s = d.groupBy("series").agg(
        F.min(DATE).alias("start"), F.max(DATE).alias("end"), n.alias("days"), total.alias("total_return"), annualised(growth("ret"), n, year).alias("annual_return"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(float(year)))).alias("annual_volatility"), sharpe("ret", 1, year).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))
    return s.join(longest_underwater(long), "series").withColumnRenamed("longest", "longest_underwater")


def active_stats(long: DataFrame, benchmark: DataFrame, year: int = 252) -> DataFrame:
    """Excess, tracking error, information ratio and relative NAV on common dates."""
    b = benchmark.select(DATE, F.col("ret").alias("_b"))
    d = long.join(b, DATE).withColumn("_x", F.col("ret") - F.col("_b"))
    return d.groupBy("series").agg(
        F.count(F.lit(1)).alias("days"), (F.avg("_x") * year).alias("annual_excess"), (F.stddev_samp("_x") * F.sqrt(F.lit(float(year)))).alias("tracking_error"),
        sharpe("_x", 1, year).alias("information_ratio"), ((1.0 + compound("ret")) / (1.0 + compound("_b")) - 1.0).alias("relative_nav"))


def relative_metrics(long: DataFrame, benchmark: DataFrame, year: int = 252) -> DataFrame:
    """Beta, annual alpha (zero risk-free rate) and tracking error against a benchmark."""
    d = long.join(benchmark.select(DATE, F.col("ret").alias("_b")), DATE)
    return d.groupBy("series").agg(
        F.regr_slope("ret", "_b").alias("beta"), (F.regr_intercept("ret", "_b") * year).alias("annual_alpha"),
        (F.stddev_samp(F.col("ret") - F.col("_b")) * F.sqrt(F.lit(float(year)))).alias("tracking_error"))


def positive_year_ratio(long: DataFrame, by: list[str]) -> DataFrame:
    y = long.groupBy(*by, F.year(DATE).alias("_y")).agg(compound("ret").alias("_r"))
    return y.groupBy(*by).agg(F.avg((F.col("_r") > 0).cast("double")).alias("positive_year_ratio"))


def yearly(long: DataFrame, by: list[str]) -> DataFrame:
    """Compounded return per calendar year, with a mark on years that do not span January to December."""
    return long.groupBy(*by, F.year(DATE).alias("year")).agg(
        compound("ret").alias("period_return"), F.count(F.lit(1)).alias("days"),
        ((F.month(F.min(DATE)) > 1) | (F.month(F.max(DATE)) < 12)).alias("is_partial_year"))


def monotonicity(buckets: DataFrame, by: list[str], n: int, value: str = "value") -> DataFrame:
    """Spearman of bucket results with 1..n and the number of improving steps; null when a bucket is missing."""
    w = Window.partitionBy(*by).orderBy("bucket")
    d = ranked(buckets, by, value, "_r_").withColumn("_up", (F.col(value) > F.lag(value).over(w)).cast("bigint"))
    full = F.count(value) == n
    return d.groupBy(*by).agg(F.when(full, safe_corr("bucket", "_r_avg")).alias("monotonicity"),
                              F.when(full, F.coalesce(F.sum("_up"), F.lit(0))).otherwise(0).alias("improving_steps"))


def pairwise_correlation(long: DataFrame) -> DataFrame:
    """Correlation of every pair of series on common dates."""
    a = long.select(F.col("series").alias("left"), DATE, F.col("ret").alias("_a"))
    b = long.select(F.col("series").alias("right"), DATE, F.col("ret").alias("_b"))
    return a.join(b, DATE).where(F.col("left") < F.col("right")).groupBy("left", "right").agg(
        F.count(F.lit(1)).alias("days"), safe_corr("_a", "_b").alias("correlation"))


def ols(wide: DataFrame, y: str, xs: list[str], by: list[str], min_rows: int) -> DataFrame:
    """Least squares with intercept per group: long table of betas, plus intercept and R².

    One aggregate forms the means and covariances of each group; the small systems, one row per
    group, are solved in Arrow batches. Rows of the panel never leave the JVM.
    """
    cols = [*xs, y]
    full = wide.dropna(subset=cols)
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    m = full.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.array(*[F.avg(c) for c in cols]).alias("_mean"),
        F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).alias("_cov")).where(F.col("rows") >= min_rows)
    kinds = dict(wide.dtypes)
    schema = ", ".join([f"{b} {kinds[b]}" for b in by] + ["rows bigint", "intercept double", "r_squared double", "factor string", "beta double"])
    k = len(xs)

    def solve(batches):
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                c = np.zeros((k + 1, k + 1))
                for (i, j), v in zip(pairs, rec["_cov"], strict=True):
                    c[i, j] = c[j, i] = v
                mean = np.asarray(rec["_mean"])
                beta = np.linalg.lstsq(c[:k, :k], c[:k, k], rcond=None)[0]
                r2 = float(beta @ c[:k, k] / c[k, k]) if c[k, k] > 0 else 0.0
                out += [{**{b: rec[b] for b in by}, "rows": rec["rows"], "intercept": float(mean[k] - beta @ mean[:k]), "r_squared": r2,
                         "factor": f, "beta": float(v)} for f, v in zip(xs, beta, strict=True)]
            yield pd.DataFrame(out, columns=[*by, "rows", "intercept", "r_squared", "factor", "beta"])

    return m.mapInPandas(solve, schema)


def attribution(wide: DataFrame, strategy: str, factors: list[str], by: list[str], min_rows: int = 20, year: int = 252) -> DataFrame:
    """OLS attribution with each factor's compounded return and contribution, and the strategy's returns."""
    fit = ols(wide, strategy, factors, by, min_rows)
    full = wide.dropna(subset=[strategy, *factors])
    n, total = F.count(F.lit(1)), compound(strategy)
    s = full.groupBy(*by).agg(total.alias("period_return"), (F.pow(1.0 + F.avg(strategy), F.lit(year)) - 1.0).alias("annual_return"),
                              annualised(growth(strategy), n, year).alias("geometric_annual_return"))
    f = full.unpivot(by, factors, "factor", "_r").groupBy(*by, "factor").agg(compound("_r").alias("factor_return"))
    out = f.join(s, by) if by else f.withColumns({c: s.select(c).scalar() for c in s.columns})
    return fit.join(out, [*by, "factor"]).withColumns({
        "annual_alpha": F.pow(1.0 + F.col("intercept"), F.lit(year)) - 1.0, "contribution": F.col("beta") * F.col("factor_return")})


def gate(metrics: DataFrame, checks: list[tuple[str, str, float]]) -> DataFrame:
    """Named checks over one row of metrics: (column, '<=' / '>=' / '==', bound)."""
    row = metrics.select(*[F.col(c).cast("double").alias(c) for c, _, _ in checks])
    long = row.unpivot([], [c for c, _, _ in checks], "check", "observed")
    rules = F.explode(F.filter(literal_rows(["check", "op", "bound"], checks), lambda r: r["check"] == F.col("check")))
    d = long.withColumn("_r", rules).select("check", "observed", F.col("_r.op").alias("op"), F.col("_r.bound").alias("bound"))
    ok = F.when(F.col("op") == "<=", F.col("observed") <= F.col("bound")).when(F.col("op") == ">=", F.col("observed") >= F.col("bound")).otherwise(F.col("observed") == F.col("bound"))
    return d.withColumn("passed", F.coalesce(ok, F.lit(False)))


def sign(c: str) -> Column:
    return F.when(F.abs(c) < 1e-12, 0).otherwise(F.signum(c).cast("int"))


def pivot_profiles(comparison: DataFrame, profiles: list[str], metric: str) -> DataFrame:
    """Factor rows, one column per profile, and the last-minus-first difference."""
    w = comparison.groupBy("factor").pivot("profile", profiles).agg(F.first(metric))
    return w.withColumn("difference", F.col(profiles[-1]) - F.col(profiles[0]))


def promotion_gate(comparison: DataFrame, stress: DataFrame, max_worsening: float = 10.0, min_coverage: float = 0.8) -> DataFrame:
    """Per factor: coverage, sign agreement, drawdown worsening and sign under stressed costs; the last column needs all factors."""
    profiles = ["raw", "gross", "net"]
    p = comparison.groupBy("factor").pivot("profile", profiles).agg(
        F.first("geometric_annual_return").alias("ret"), F.first("max_drawdown").alias("dd"), F.first("days").alias("days"))
    d = p.join(stress.select("factor", F.col("geometric_annual_return").alias("stress_ret")), "factor", "left")
    top = Window.partitionBy()  # one row per factor
    d = d.withColumn("coverage_ratio", F.col("net_days") / F.max("raw_days").over(top))
    r, g, n, s = (sign(c) for c in ("raw_ret", "gross_ret", "net_ret", "stress_ret"))
    checks = {"coverage_pass": F.col("coverage_ratio") >= min_coverage, "direction_pass": (r == g) & (g == n) & (r != 0),
              "drawdown_pass": F.col("raw_dd") - F.col("net_dd") <= max_worsening, "cost_pass": (g == n) & (n == s) & (g != 0)}
    d = d.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    d = d.withColumn("factor_pass", F.col("coverage_pass") & F.col("direction_pass") & F.col("drawdown_pass") & F.col("cost_pass"))
    return d.withColumn("promote", F.min("factor_pass").over(top))
