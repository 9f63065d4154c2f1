"""Cross-sectional operators: every statistic is per date (or per date and class).

A group's statistics come from an aggregate joined back on the key: partial sums leave the map side, and the
statistics table has one row per group, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import add_all, clip, safe_divide
from ..functions.stats import safe_corr
from ..session import staged
from .keys import join_null_safe
from .ordering import ranked, ranked_many, with_quantiles

DATE = "trade_date"


def with_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Group aggregates on every row; a null key is a group of its own.

    The statistics are written first: their size then decides the join before the rows are shuffled.
    """
    return join_null_safe(df, staged(df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])), by, "left")


def winsorize(df: DataFrame, value: str, by: list[str] | None = None, low: float = 0.01, high: float = 0.99,
              out: str | None = None) -> DataFrame:
    """Clip to the group's quantiles."""
    d = with_quantiles(df, by or [DATE], value, {"_ql": low, "_qh": high})
    return d.withColumn(out or value, clip(value, F.col("_ql"), F.col("_qh"))).drop("_ql", "_qh")


def demean(df: DataFrame, value: str, by: list[str], out: str | None = None) -> DataFrame:
    return with_stats(df, by, _m=F.avg(value)).withColumn(out or value, F.col(value) - F.col("_m")).drop("_m")


def zscore(df: DataFrame, value: str, by: list[str] | None = None, ddof: int = 1, out: str | None = None,
           constant: float | None = None) -> DataFrame:
    """(x − mean) / std per group; a constant group gives ``constant``."""
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    d = with_stats(df, by or [DATE], _m=F.avg(value), _s=sd)
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(
        F.lit(constant).cast("double"))
    return d.withColumn(out or value, z).drop("_m", "_s")


def industry_zscore(df: DataFrame, value: str, industry: str = "industry", out: str | None = None, by: list[str] | None = None,
                    low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Winsorise by date, demean inside (date, industry), z-score by date.

    Demeaned values average to zero on a date, and their squares add up from the industries' moments, so one aggregate by
    (date, industry) serves both steps. The winsorised panel is written once, as both sides of the join read it.
    """
    by, out = by or [DATE], out or f"{value}_z"
    d = staged(winsorize(df, value, by, low, high, out))
    inside = d.groupBy(*by, industry).agg(F.count(out).alias("_k"), F.avg(out).alias("_m"), F.var_pop(out).alias("_v"))
    inside = staged(inside)  # its written size decides the join before the panel is shuffled
    spread = inside.groupBy(*by).agg(F.sum(F.col("_k") * F.col("_v")).alias("_ss"), F.sum("_k").alias("_n"))
    d = join_null_safe(join_null_safe(d, inside.drop("_k", "_v"), [*by, industry], "left"), staged(spread), by, "left")
    z = F.when((F.col("_n") > 1) & (F.col("_ss") > 0), (F.col(out) - F.col("_m")) / F.sqrt(F.col("_ss") / (F.col("_n") - 1)))
    return d.withColumn(out, z).drop("_m", "_ss", "_n")


def robust_standardize(df: DataFrame, value: str, by: list[str] | None = None, out: str | None = None) -> DataFrame:
    """(x − median) / MAD per date; zero MAD and missing values give 0."""
    by, out = by or [DATE], out or f"{value}_robust"
    d = with_quantiles(df, by, value, {"_med": 0.5}).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    d = with_quantiles(staged(d), by, "_dev", {"_mad": 0.5})
    return d.withColumn(out, F.coalesce(safe_divide(F.col(value) - F.col("_med"), "_mad"), F.lit(0.0))).drop(
        "_med", "_mad", "_dev")


def pct_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str | None = None,
             centre: float = 0.0) -> DataFrame:
    """Average-tie percentile rank in (0, 1], minus ``centre``."""
    by, out = by or [DATE], out or f"cs_{value}"
    d = ranked(df, by, value, "_r_")
    return d.withColumn(out, F.col("_r_avg") / F.col("_r_n") - F.lit(centre)).drop("_r_avg", "_r_min", "_r_n")


def thirds(rank: str, labels: tuple[str, str, str]) -> Column:
    """Right-closed thirds of a percentile rank."""
    r = F.col(rank)
    return F.when(r <= 1.0 / 3.0, labels[0]).when(r <= 2.0 / 3.0, labels[1]).when(r <= 1.0, labels[2])


def qcut(df: DataFrame, value: str, n: int = 5, by: list[str] | None = None, min_per_bucket: int = 10) -> DataFrame:
    """Add ``bucket`` (0-based, right-closed between linear quantile edges), ``rows`` and ``valid``.

    A group is valid with enough rows and exactly ``n`` filled buckets over distinct edges.
    """
    by = by or [DATE]
    v = F.col(value)
    d = with_quantiles(df.where(v.isNotNull()), by, value, {f"_e{i}": i / n for i in range(n)}, "rows")
    d = d.withColumn("bucket", add_all([(F.col(f"_e{i}") < v).cast("int") for i in range(1, n)]))
    d = d.withColumn("_split", F.col("_e0") < F.col("_e1")).drop(*[f"_e{i}" for i in range(n)])
    seen = {f"_f{i}": F.max((F.col("bucket") == i).cast("int")) for i in range(n)}
    filled = staged(d.groupBy(*by).agg(*[c.alias(name) for name, c in seen.items()]))
    d = join_null_safe(d, filled, by, "left")
    ok = (F.col("rows") >= n * min_per_bucket) & (add_all([F.col(c) for c in seen]) == n) & F.col("_split")
    return d.withColumn("valid", ok).drop(*seen, "_split")


TOLERANCE = 1e-10  # share of a control's variance under which the controls before it explain all of it


def least_squares(moments: DataFrame, k: int) -> DataFrame:
    """Adds _b0 .. _b(k-1), least squares slopes from centred moments _c<i>_<j> (i <= j < k) and _c<i>_y of each row.

    Controls are eliminated one after another. One that is constant, or that the earlier ones explain, gets slope 0: the
    residuals are the same as of any least squares solution.
    """
    d = moments
    for j in range(k):
        d = d.withColumn(f"_p{j}", F.when((F.col(f"_c{j}_{j}") > 0) & (F.col(f"_c{j}_{j}") > TOLERANCE * F.col(f"_v{j}")), 1.0 / F.col(f"_c{j}_{j}")).otherwise(0.0)) if j else d.withColumns(
            {**{f"_v{i}": F.col(f"_c{i}_{i}") for i in range(k)}, "_p0": F.when(F.col("_c0_0") > 0, 1.0 / F.col("_c0_0")).otherwise(0.0)})
        rest = range(j + 1, k)
        less = {f"_c{i}_{m}": F.col(f"_c{i}_{m}") - F.col(f"_c{j}_{i}") * F.col(f"_p{j}") * F.col(f"_c{j}_{m}") for i in rest for m in [*range(i, k), "y"]}
        d = d.withColumns(less) if less else d
    for j in reversed(range(k)):
        known = add_all([F.col(f"_c{j}_{m}") * F.col(f"_b{m}") for m in range(j + 1, k)]) if j < k - 1 else F.lit(0.0)
        d = d.withColumn(f"_b{j}", F.col(f"_p{j}") * (F.col(f"_c{j}_y") - known))
    return d


def residualize(df: DataFrame, value: str, controls: tuple[str, ...], by: list[str] | None = None,
                min_rows: int = 30, out: str | None = None) -> DataFrame:
    """Residual of ``value`` on an intercept and any number of controls per date, then z-scored.

    Centred moments of one aggregate per date, solved there and joined back. Collinear and constant controls are allowed
    (see ``least_squares``). Rows with a null in a column used, and dates with fewer than ``min_rows`` others, get null.
    """
    by, out, k = by or [DATE], out or f"{value}_neutral", len(controls)
    cols = {"y": value, **{str(i): c for i, c in enumerate(controls)}}
    full = F.lit(True)
    for c in cols.values():
        full = full & F.col(c).isNotNull()
    part = df.withColumns({f"_x{i}": F.when(full, F.col(c).cast("double")) for i, c in cols.items()})
    cov = [F.covar_pop(f"_x{i}", f"_x{m}").alias(f"_c{i}_{m}") for i in range(k) for m in [*range(i, k), "y"]]
    moments = part.groupBy(*by).agg(F.count("_xy").alias("_n"), *[F.avg(f"_x{i}").alias(f"_m{i}") for i in cols], *cov)
    solved = least_squares(moments, k) if k else moments
    solved = solved.select(*by, "_n", *[f"_m{i}" for i in cols], *[f"_b{i}" for i in range(k)])
    d = join_null_safe(part, staged(solved), by, "left")
    resid = F.col("_xy") - F.col("_my")
    for i in range(k):
        resid = resid - F.col(f"_b{i}") * (F.col(f"_x{i}") - F.col(f"_m{i}"))
    d = d.withColumn(out, F.when(F.col("_n") >= min_rows, resid)).select(*df.columns, out)
    return zscore(staged(d), out, by)


def daily_ic(df: DataFrame, score: str, target: str, by: list[str] | None = None, min_obs: int = 20) -> DataFrame:
    """Pearson and Spearman correlation per group over complete pairs."""
    by = by or [DATE]
    pairs = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(*by, score, target)
    d = ranked_many(pairs, by, {score: "_s_", target: "_t_"})
    return (d.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("obs"), safe_corr(score, target).alias("pearson_ic"),
                 safe_corr("_s_avg", "_t_avg").alias("rank_ic"))
            .where(F.col("obs") >= min_obs))


def ic_summary(ic: DataFrame, by: list[str]) -> DataFrame:
    """Days, mean rank IC, rank IC over its population std, mean Pearson IC."""
    sd = F.stddev_pop("rank_ic")
    return ic.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.avg("rank_ic").alias("rank_ic_mean"),
        F.when((F.count("rank_ic") > 1) & (sd > 0), F.avg("rank_ic") / sd).alias("rank_ic_ir"),
        F.avg("pearson_ic").alias("pearson_ic_mean"))


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "factor", value: str = "score") -> DataFrame:
    """Wide factor columns to rows."""
    return df.unpivot(keys, columns, name, value)
