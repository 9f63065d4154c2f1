"""Price-only style replica: factors, leg scores, universe, positions and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add_all, flag
from ..operators.ordering import ranked
from ..operators.rolling import frame, pct_change
from ..operators.xsection import DATE, with_stats

SYM = "symbol"
KEYS = [DATE, SYM]
FACTORS = ("resvol", "beta", "size", "liquidity", "mom20", "mom120", "industry_mom", "vol_convergence")


def factors(prices: DataFrame, min_obs: int = 40, window: int = 60, long: int = 120) -> DataFrame:
    """Eight factors from close, amount and industry; each needs ``min_obs`` rows (momentum its full span).

    resvol: std of returns beyond beta × market; beta: rolling slope on the equal-weight market;
    vol_convergence: short over long volatility.
    """
    w = Window.partitionBy(SYM).orderBy(DATE)
    d = prices.withColumn("_r", pct_change("close"))
    d = with_stats(d, [DATE], _mkt=F.avg("_r")).withColumns({"_n": F.row_number().over(w)})
    f, short = frame(window), frame(20)
    # Every frame is asked for once; the factors are made of these.
    d = d.withColumns({"_vm": F.var_samp("_mkt").over(f), "_cv": F.covar_samp("_r", "_mkt").over(f), "_vr": F.var_samp("_r").over(f),
                       "_short": F.stddev_samp("_r").over(short), "_amount": F.avg("amount").over(short), "mom20": pct_change("close", 20), "mom120": pct_change("close", long)})
    beta = F.when(F.col("_vm") > 0, F.col("_cv") / F.col("_vm"))
    ready = F.col("_n") > min_obs
    d = d.withColumns({
        "beta": F.when(ready, beta), "resvol": F.when(ready, F.sqrt(F.greatest(F.lit(0.0), F.col("_vr") - beta * F.col("_cv")))),
        "size": F.log("close"), "liquidity": F.log("_amount"),
        "vol_convergence": F.when(ready & (F.col("_vr") > 0), F.col("_short") / F.sqrt("_vr"))})
    d = with_stats(d, [DATE, "industry"], industry_mom=F.avg("mom20"))
    return d.select(*KEYS, "industry", *FACTORS)


def leg_score(df: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """Weighted mean of percentile ranks in [0, 1]; a negative weight uses the reversed rank, a missing factor is neutral."""
    d, parts = df, []
    for c, w in weights.items():
        d = ranked(d, [DATE], c, f"_{c}_")
        rank = F.col(f"_{c}_avg") / F.col(f"_{c}_n")
        parts.append(abs(w) * F.coalesce(rank if w > 0 else 1.0 - rank, F.lit(0.5)))
    total = sum(abs(w) for w in weights.values())
    return d.withColumn(out, add_all(parts) / total).select(*df.columns, out)


def universe(prices: DataFrame, instruments: DataFrame, min_history: int = 120) -> DataFrame:
    """Rows with enough own history that are not under special treatment."""
    n = F.row_number().over(Window.partitionBy(SYM).orderBy(DATE))
    d = prices.withColumn("_n", n).join(instruments.select(SYM, "is_st"), SYM, "left")
    return d.where((F.col("_n") >= min_history) & ~flag("is_st")).select(*KEYS)


def positions(signals: DataFrame, quotas: dict[str, int], b_slots: int, slot: float = 0.01, cap: float = 0.02) -> DataFrame:
    """Theme quotas by score A, the best B names by score B; a name in both adds up to the cap."""
    quota = F.coalesce(*[F.when(F.col("theme") == t, q) for t, q in quotas.items()])
    wa = Window.partitionBy(DATE, "theme").orderBy(F.col("score_a").desc_nulls_last(), SYM)
    wb = Window.partitionBy(DATE).orderBy(F.col("score_b").desc_nulls_last(), SYM)
    top = max(quotas.values())
    a = (signals.where(F.col("theme").isin(*quotas) & F.col("score_a").isNotNull()).withColumn("_k", F.row_number().over(wa))
         .where(F.col("_k") <= top).where(F.col("_k") <= quota))
    b = signals.where(F.col("score_b").isNotNull()).withColumn("_k", F.row_number().over(wb)).where(F.col("_k") <= b_slots)
    both = a.select(*KEYS, F.lit("A").alias("leg")).unionByName(b.select(*KEYS, F.lit("B").alias("leg")))
    return both.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set("leg")), "+").alias("leg"), F.least(F.count(F.lit(1)) * slot, F.lit(cap)).alias("weight"))


def position_changes(pos: DataFrame) -> DataFrame:
    """new / stay / exit of every name between consecutive dates."""
    from ..operators.portfolio import dense_index
    d = pos.select(*KEYS, "weight").join(dense_index(pos), DATE)
    now = d.select("idx", SYM, F.col("weight").alias("weight_now"))
    before = d.select((F.col("idx") + 1).alias("idx"), SYM, F.col("weight").alias("weight_before"))
    j = now.join(before, ["idx", SYM], "full")
    action = F.when(F.col("weight_before").isNull(), "new").when(F.col("weight_now").isNull(), "exit").otherwise("stay")
    return j.withColumn("action", action).where("idx > 1").join(dense_index(pos), "idx").select(DATE, SYM, "action", "weight_before", "weight_now")


def exposure(pos: DataFrame) -> DataFrame:
    """Counts and weight per date and leg."""
    n = lambda c: F.sum(c.cast("bigint"))
    leg = F.col("leg")
    return pos.groupBy(DATE).agg(
        F.count(F.lit(1)).alias("total_stocks"), n(leg.contains("A")).alias("a_leg_count"), n(leg.contains("B")).alias("b_leg_count"),
        n(leg == "A+B").alias("overlap_count"), F.sum("weight").alias("total_weight"))


def theme_lookup(df: DataFrame, exact: dict[str, str], contains: dict[str, str], industry: str = "industry", tag: str = "tag") -> DataFrame:
    """Theme by exact industry, else by a fragment of it, else by tag; unknown stays null. The lists are fixed constants."""
    tries = [F.when(F.col(industry) == k, v) for k, v in exact.items()]
    tries += [F.when(F.col(industry).contains(k), v) for k, v in contains.items()]
    tries += [F.when(F.col(tag) == k, v) for k, v in exact.items()]
    return df.withColumn("theme", F.coalesce(*tries))
