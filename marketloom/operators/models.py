"""Weights, linear models and walk-forward evaluation.

Linear fits need only sums of products. One aggregate per date forms them; any training window is then
a sum over date rows, and the small systems, one row per window, are solved in Arrow batches.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add_all
from .execution import top_rows
from .xsection import DATE, daily_ic, pct_rank, robust_standardize, with_stats, zscore

SYM = "symbol"


def date_equal_weights(df: DataFrame, out: str = "weight") -> DataFrame:
    """1 / rows on the date, scaled to mean one (so the scale is rows / dates)."""
    counts = df.groupBy(DATE).agg(F.count(F.lit(1)).alias("_n"))
    scale = counts.agg(F.sum("_n") / F.count(F.lit(1))).scalar()
    return with_stats(df, [DATE], _n=F.count(F.lit(1))).withColumn(out, scale / F.col("_n")).drop("_n")


def date_moments(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """Row count, sums and sums of products per date (and group) over complete rows."""
    cols = [*xs, y]
    pairs = list(combinations_with_replacement(cols, 2))
    return df.dropna(subset=cols).groupBy(*(by or []), DATE).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(cols)],
        *[F.sum(F.col(a) * F.col(b)).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)])


def fit_windows(moments: DataFrame, windows: DataFrame, xs: list[str], alpha: float, min_rows: int, by: list[str] | None = None) -> DataFrame:
    """Centred ridge per window: coefficients ``b_<x>`` and ``intercept``.

    ``windows``: window, train_start, train_end (inclusive). Date rows meet the windows by an expansion of
    each window into its months, so the join is an equi join.
    """
    by = by or []
    k = len(xs)
    pairs = list(combinations_with_replacement(range(k + 1), 2))
    months = F.sequence(F.trunc("train_start", "MM"), F.trunc("train_end", "MM"), F.expr("interval 1 month"))
    w = windows.select("window", "train_start", "train_end", F.explode(months).alias("_m"))
    m = moments.withColumn("_m", F.trunc(DATE, "MM")).join(w, "_m").where(F.col(DATE).between(F.col("train_start"), F.col("train_end")))
    s = m.groupBy(*by, "window").agg(
        F.sum("_n").alias("rows"), F.array(*[F.sum(f"_s{i}") for i in range(k + 1)]).alias("_s"),
        F.array(*[F.sum(f"_p{i}") for i in range(len(pairs))]).alias("_p")).where(F.col("rows") >= min_rows)
    kinds = dict(s.dtypes)
    names = [*by, "window", "rows", "intercept", *[f"b_{x}" for x in xs]]
    schema = ", ".join([f"{b} {kinds[b]}" for b in [*by, "window"]] + ["rows bigint"] + [f"{c} double" for c in names[len(by) + 2:]])

    def solve(batches):
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                n, sums = rec["rows"], np.asarray(rec["_s"])
                c = np.zeros((k + 1, k + 1))
                for (i, j), v in zip(pairs, rec["_p"], strict=True):
                    c[i, j] = c[j, i] = v - sums[i] * sums[j] / n
                beta = np.linalg.solve(c[:k, :k] + alpha * np.eye(k), c[:k, k])
                out.append([*[rec[b] for b in by], rec["window"], n, float((sums[k] - beta @ sums[:k]) / n), *[float(v) for v in beta]])
            yield pd.DataFrame(out, columns=names)

    return s.mapInPandas(solve, schema)


def predict(df: DataFrame, fits: DataFrame, xs: list[str], keys: list[str], out: str = "pred") -> DataFrame:
    """Linear prediction of rows tagged with their window; rows of an unfitted window leave."""
    score = F.col("intercept") + add_all([F.col(f"b_{x}") * F.col(x) for x in xs])
    return df.join(fits, keys).withColumn(out, score).drop("intercept", "rows", *[f"b_{x}" for x in xs])


def folds(dates: DataFrame, train: int, purge: int, test: int, step: int) -> DataFrame:
    """Fold table over the dense date index: train, a purged gap, then the test span."""
    w = Window.orderBy(DATE)  # one row per date
    d = dates.select(DATE).distinct().withColumn("_i", F.row_number().over(w) - 1)
    n = F.max("_i").over(Window.partitionBy()) + 1
    d = d.withColumns({"_n": n, "train_end": F.lead(DATE, train - 1).over(w), "test_start": F.lead(DATE, train + purge).over(w),
                       "_last": F.max(DATE).over(Window.partitionBy()), "_e": F.lead(DATE, train + purge + test - 1).over(w)})
    d = d.where((F.col("_i") % step == 0) & (F.col("_i") + train + test <= F.col("_n")) & F.col("test_start").isNotNull())
    return d.select((F.col("_i") / step).cast("int").alias("window"), F.col(DATE).alias("train_start"), "train_end", "test_start", F.coalesce("_e", "_last").alias("test_end"))


def month_windows(dates: DataFrame, train_months: int, valid_months: int, step_months: int) -> DataFrame:
    """Month-stepped (train, validation) windows from the first month of the data."""
    b = dates.agg(F.trunc(F.min(DATE), "MM").alias("_a"), F.trunc(F.max(DATE), "MM").alias("_z"))
    starts = F.sequence(F.add_months("_a", train_months), F.add_months("_z", 1 - valid_months), F.make_ym_interval(F.lit(0), F.lit(step_months)))
    fits = F.add_months("_a", train_months) <= F.add_months("_z", 1 - valid_months)
    d = b.where(fits).select(F.posexplode(starts).alias("window", "test_start"))
    return d.select("window", F.add_months("test_start", -train_months).alias("train_start"), F.date_sub("test_start", 1).alias("train_end"), "test_start",
                    F.date_sub(F.add_months("test_start", valid_months), 1).alias("test_end"))


def in_window(df: DataFrame, windows: DataFrame, start: str = "test_start", end: str = "test_end") -> DataFrame:
    """Rows of every window's span (spans of different windows may overlap); equi join on month, then exact bounds."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    w = windows.select("window", start, end, F.explode(months).alias("_m"))
    return df.withColumn("_m", F.trunc(DATE, "MM")).join(w, "_m").where(F.col(DATE).between(F.col(start), F.col(end))).drop("_m", start, end)


def walk_forward(df: DataFrame, fold: DataFrame, y: str, xs: list[str], alpha: float, top_k: int, min_rows: int = 50) -> tuple[DataFrame, DataFrame]:
    """(daily rank IC, daily top-K mean outcome) over the test spans, with fits from the date moments.

    Rows without a feature or an outcome are neither fitted nor scored.
    """
    fits = fit_windows(date_moments(df, y, xs), fold, xs, alpha, min_rows)
    test = predict(in_window(df.dropna(subset=[*xs, y]), fold), fits, xs, ["window"])
    ic = daily_ic(test, "pred", y, ["window", DATE], 5).where("rank_ic is not null")
    top = top_rows(test, "pred", top_k, ["window", DATE]).groupBy("window", DATE).agg(F.count(F.lit(1)).alias("names"), F.avg(y).alias("ret"))
    return ic, top.where(F.col("names") >= top_k)


def standardized(df: DataFrame, xs: list[str], method: str) -> DataFrame:
    """Features transformed per date: none, zscore, robust or rank."""
    for x in xs if method != "none" else []:
        if method == "zscore":
            df = zscore(df, x)
        elif method == "robust":
            df = robust_standardize(df, x, out=x)
        else:
            df = pct_rank(df, x, out=x)
    return df


def window_ic(df: DataFrame, windows: DataFrame, y: str, xs: list[str], alpha: float, min_rows: int) -> DataFrame:
    """Mean daily rank IC of each window's validation span; rows without a feature are neither fitted nor scored."""
    fits = fit_windows(date_moments(df, y, xs), windows, xs, alpha, min_rows)
    test = predict(in_window(df.dropna(subset=xs), windows), fits, xs, ["window"])
    ic = daily_ic(test, "pred", y, ["window", DATE], 2).where("rank_ic is not null")
    return ic.groupBy("window").agg(F.avg("rank_ic").alias("ic"), F.count(F.lit(1)).alias("dates"))


def gbt_scores(train: DataFrame, test: DataFrame, y: str, xs: list[str], trees: int = 160, depth: int = 3, rate: float = 0.045, seed: int = 7) -> tuple[DataFrame, dict[str, float]]:
    """Boosted trees with date-equal weights: every test row scored, and feature importance. A missing feature counts as 0."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    inputs = [f"_in_{x}" for x in xs]
    filled = lambda d: d.withColumns({i: F.coalesce(F.nanvl(F.col(x).cast("double"), F.lit(0.0)), F.lit(0.0)) for i, x in zip(inputs, xs, strict=True)})
    pack = VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="error")
    rows = pack.transform(filled(date_equal_weights(train.where(F.col(y).isNotNull()))))
    model = GBTRegressor(featuresCol="_x", labelCol=y, weightCol="weight", predictionCol="pred", maxIter=trees, maxDepth=depth, stepSize=rate,
                         seed=seed, cacheNodeIds=False).fit(rows)
    return model.transform(pack.transform(filled(test))).drop("_x", *inputs), dict(zip(xs, (float(v) for v in model.featureImportances.toArray()), strict=True))
