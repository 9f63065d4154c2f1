"""Next-session execution: gates, exit policies, frozen top-K books and their matched benchmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, fail_where, flag, policy_name, safe_divide, with_scenarios
from ..functions.stats import annualised, compound, growth, hac_inputs, hac_t, newey_west, sharpe
from .calendar import DATE, sessions

SYM = "symbol"


def by_symbol():
    """Rows of one symbol in session order; the calendar bounds them."""
    return Window.partitionBy(SYM).orderBy(DATE)


def lead_columns(df: DataFrame, columns: dict[str, str], n: int = 1) -> DataFrame:
    """Value of each column on the symbol's n-th next row: {source: new name}."""
    return df.withColumns({new: F.lead(c, n).over(by_symbol()) for c, new in columns.items()})


def with_market_next_date(df: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Market-wide next session of every date (the calendar has one row per session)."""
    cal = sessions(df) if calendar is None else calendar
    return df.join(cal.select(DATE, F.col("next_date").alias("market_next_date")), DATE, "left")


def execution_fields(df: DataFrame, block_limit_up: bool = True) -> DataFrame:
    """Entry gates and next-session outcomes from the ``exec_next_*`` columns."""
    nopen, nup = F.col("exec_next_open"), F.col("exec_next_up_limit")
    same = F.coalesce(F.col("exec_next_trade_date") == F.col("market_next_date"), F.lit(False))
    positive = lambda c: F.coalesce(col(c) > 0, F.lit(False))
    limit_known = positive(nopen) & positive(nup) & F.coalesce((nup / nopen).between(0.5, 1.5), F.lit(False))
    at_limit = limit_known & F.coalesce(nopen >= nup * 0.999, F.lit(False))
    observable = (F.col("market_next_date").isNotNull() & same & positive("next_adj_open") & positive(nopen)
                  & ~flag("exec_next_is_suspended") & ~flag("exec_next_is_st"))
    eligible = observable & limit_known & ~at_limit if block_limit_up else observable
    outcome = positive("next_adj_high") & positive("next_adj_close") & positive("exec_next_amount")
    return df.withColumns({
        "entry_date": F.col("market_next_date"), "entry_price": F.col("next_adj_open"),
        "same_next_session": same, "blocked_not_next_session": ~same, "entry_limit_available": limit_known,
        "blocked_limit_up_open": at_limit, "execution_eligible": eligible, "outcome_available": outcome,
        "evaluation_eligible": eligible & outcome, "next_amount_cny": F.col("exec_next_amount") * 1000.0,
        "open_to_high": safe_divide("next_adj_high", "next_adj_open") - 1.0,
        "open_to_close": safe_divide("next_adj_close", "next_adj_open") - 1.0,
    })


def filter_signal_rows(df: DataFrame, min_listed: int = 60) -> DataFrame:
    """Tradable at the signal close; missing flags are false, a missing age is zero."""
    return df.where((F.col("amount") > 0) & (F.col("total_mv") > 0) & (F.col("turnover_rate") > 0)
                    & ~flag("is_suspended") & ~flag("is_st")
                    & (F.coalesce("listed_days", F.lit(0)) >= min_listed))


def label_available(df: DataFrame, target: str) -> DataFrame:
    t = F.col(target)
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    return df.where(F.col("same_next_session") & F.col("outcome_available") & finite)


def temporal_split(df: DataFrame, cut: str, start: str | None = None, end: str | None = None,
                   label_end: str = "entry_date") -> DataFrame:
    """Mark 'train' (row and label end on or before the cut) and 'test' (after it); purged rows leave. An empty side is an error."""
    t = F.lit(cut).cast("date")
    train = (F.col(DATE) <= t) & (F.col(label_end) <= t)
    test = F.col(DATE) > t
    if start:
        test = test & (F.col(DATE) >= F.lit(start).cast("date"))
    if end:
        test = test & (F.col(DATE) <= F.lit(end).cast("date"))
    out = df.withColumn("split", F.when(train, "train").when(test, "test")).where("split is not null")
    sides = {r.split for r in out.select("split").distinct().collect()}  # two values at most
    if missing := {"train", "test"} - sides:
        raise ValueError(f"temporal split leaves no {' and no '.join(sorted(missing))} rows")
    return out


def chosen_policies(metrics: DataFrame, keys: list[str], frozen: dict | None = None) -> DataFrame:
    """The policy with the greatest Sharpe ratio, ties by key, and beside it the frozen one, which must be in the grid."""
    best = metrics.where("sharpe is not null").orderBy(F.col("sharpe").desc(), *keys).limit(1).withColumn("choice", F.lit("best"))
    if frozen is None:
        return best
    row = metrics.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in frozen.items()])).limit(1)
    if row.isEmpty():
        raise ValueError(f"frozen policy {frozen} is not in the policy grid")
    return best.unionByName(row.withColumn("choice", F.lit("frozen")))


def purge_overlap(df: DataFrame, valid_start: str, horizon: int) -> DataFrame:
    """Training rows whose label window (1.5 × horizon calendar days) ends before validation starts."""
    return df.where(F.date_add(F.col(DATE), int(1.5 * horizon)) < F.lit(valid_start).cast("date"))


def top_rows(df: DataFrame, score: str, k: int, by: list[str] | None = None, rank: str = "raw_rank") -> DataFrame:
    """First ``k`` rows per group by score, ties by symbol. The optimizer limits each map task to k rows per group."""
    w = Window.partitionBy(*(by or [DATE])).orderBy(F.col(score).desc_nulls_last(), F.col(SYM))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def frozen_candidates(df: DataFrame, score: str, top_ks: list[int]) -> DataFrame:
    """Top-K rows per signal date for every K; unfilled names are not replaced."""
    top = top_rows(df, score, max(top_ks))
    return with_scenarios(top, ["top_k"], [(k,) for k in top_ks]).where("raw_rank <= top_k").withColumnRenamed(
        DATE, "signal_date")


def stays(df: DataFrame, dates: DataFrame, date: str, by: list[str]) -> DataFrame:
    """Mark rows whose (group, symbol) was also present on the previous session of ``dates``."""
    idx = dates.select(F.col(DATE).alias(date), "session")
    w = Window.partitionBy(*by, SYM).orderBy("session")
    return df.join(idx, date).withColumn("stayed", F.coalesce(F.lag("session").over(w) == F.col("session") - 1, F.lit(False)))


def candidate_days(selected: DataFrame, dates: DataFrame) -> DataFrame:
    """Per (date, K): fills, fill rate, blocked counts and turnover of the executable set."""
    keys = ["signal_date", "top_k"]
    ok = F.col("execution_eligible")
    day = selected.groupBy(*keys).agg(
        F.min("entry_date").alias("entry_date"), F.count(F.lit(1)).alias("raw_candidates"),
        F.sum(ok.cast("bigint")).alias("filled"), F.max(F.when(ok, F.col("raw_rank"))).alias("max_raw_rank_used"),
        F.sum(F.col("blocked_limit_up_open").cast("bigint")).alias("blocked_limit_up_open_raw"))
    kept = (stays(selected.where(ok).select(*keys, SYM), dates, "signal_date", ["top_k"])
            .groupBy(*keys).agg(F.sum(F.col("stayed").cast("bigint")).alias("kept")))
    w = Window.partitionBy("top_k").orderBy("signal_date")  # one row per date and K
    prev = F.lag("filled").over(w)
    return (day.join(kept, keys, "left").withColumn("fill_rate", F.col("filled") / F.col("top_k"))
            .withColumn("selection_turnover", F.when(prev > 0, 1.0 - F.coalesce("kept", F.lit(0)) / F.col("top_k")).otherwise(1.0))
            .drop("kept"))


def exit_policies(df: DataFrame, take_profits: list[float | None], entry_bps: float, exit_bps: float, cost_bps: float,
                  participation: float) -> DataFrame:
    """One row per trade and policy: target price when the high is above it, else the close."""
    grid = [(policy_name(p), p if p is not None else float("inf")) for p in take_profits]
    t = with_scenarios(df, ["exit_policy", "_tp"], grid)
    target = F.col("entry_price") * (1.0 + F.col("_tp"))
    hit = F.col("next_adj_high") > target
    out = F.when(hit, target).otherwise(F.col("next_adj_close"))
    return t.withColumns({
        "hit_take_profit": hit, "exit_price": out, "exit_reason": F.when(hit, "take_profit").otherwise("close"),
        "gross_return": out / F.col("entry_price") - 1.0,
        "net_return": net_return(F.col("entry_price"), out, entry_bps, exit_bps, cost_bps),
        "capacity_cny": F.col("next_amount_cny") * participation}).drop("_tp")


def net_return(entry: Column, exit_: Column, entry_bps: float, exit_bps: float, cost_bps: float) -> Column:
    """Return after slippage on both sides and the round-trip cost."""
    return (exit_ * (1.0 - exit_bps / 10000.0)) / (entry * (1.0 + entry_bps / 10000.0)) - 1.0 - cost_bps / 10000.0


def date_policy_grid(days: DataFrame, policies: list[str], keep: list[str]) -> DataFrame:
    """Every date with every policy, so that days without a fill stay as cash."""
    return with_scenarios(days.select(*keep), ["exit_policy"], [(p,) for p in policies])


def daily_portfolio_returns(trades: DataFrame, days: DataFrame, policies: list[str]) -> DataFrame:
    keys = ["signal_date", "top_k", "exit_policy"]
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("filled"), F.avg("net_return").alias("avg_trade_return"),
        F.avg("gross_return").alias("avg_gross_trade_return"),
        F.avg(F.col("hit_take_profit").cast("double")).alias("hit_take_profit_rate"),
        F.sum("capacity_cny").alias("capacity_cny_at_participation"))
    base = date_policy_grid(days, policies, ["signal_date", "entry_date", "top_k", "fill_rate", "selection_turnover"])
    out = base.join(g, keys, "left")
    w = F.coalesce("filled", F.lit(0)) / F.col("top_k")
    return out.withColumns({
        "filled": F.coalesce("filled", F.lit(0).cast("bigint")),
        "portfolio_return": F.coalesce("avg_trade_return", F.lit(0.0)) * w,
        "gross_portfolio_return": F.coalesce("avg_gross_trade_return", F.lit(0.0)) * w, "cash_weight": 1.0 - w})


def universe_benchmark(universe: DataFrame, trades: DataFrame, policies: list[str]) -> DataFrame:
    """Same-policy outcome of the whole universe: slots are all names, unexecuted ones are cash."""
    slots = universe.groupBy("signal_date").agg(F.count(F.lit(1)).alias("benchmark_slots"))
    done = trades.groupBy("signal_date", "exit_policy").agg(
        F.count(F.lit(1)).alias("benchmark_executed"), F.sum("gross_return").alias("benchmark_gross_return_sum"),
        F.sum("net_return").alias("benchmark_return_sum"))
    out = date_policy_grid(slots, policies, ["signal_date", "benchmark_slots"]).join(done, ["signal_date", "exit_policy"], "left")
    out = out.fillna(0, ["benchmark_executed"]).fillna(0.0, ["benchmark_gross_return_sum", "benchmark_return_sum"])
    return out.withColumns({
        "benchmark_return": F.col("benchmark_return_sum") / F.col("benchmark_slots"),
        "benchmark_invested_weight": F.col("benchmark_executed") / F.col("benchmark_slots"),
        "benchmark_executed_mean_return": F.coalesce(safe_divide("benchmark_return_sum", "benchmark_executed"), F.lit(0.0))})


def attach_benchmark(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Exposure-matched benchmark: executed mean × invested weight; a date without a benchmark fails the job."""
    w = F.col("filled") / F.col("top_k")
    both = daily.join(benchmark, ["signal_date", "exit_policy"], "left")
    both = fail_where(both, F.col("benchmark_executed_mean_return").isNull(), "benchmark_executed_mean_return", "a selection date has no benchmark")
    return both.withColumns({
        "benchmark_exposure_matched_return": F.col("benchmark_executed_mean_return") * w,
        "active_return": F.col("portfolio_return") - F.col("benchmark_executed_mean_return") * w})


def performance_metrics(daily: DataFrame, by: list[str], order: str = "signal_date") -> DataFrame:
    """Return, risk, HAC t, drawdown and matched-benchmark metrics per book (population std throughout)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("_nav", F.product(1.0 + F.col("portfolio_return")).over(w))
    d = d.withColumn("_dd", F.col("_nav") / F.max("_nav").over(w) - 1.0)
    d = hac_inputs(d, by, order, "portfolio_return")
    total = compound("portfolio_return")
    n = F.count(F.lit(1))
    m = d.groupBy(*by).agg(
        n.alias("days"), F.avg("filled").alias("filled_avg"), F.avg("fill_rate").alias("fill_rate_avg"), F.avg("selection_turnover").alias("turnover_avg"),
        F.percentile("capacity_cny_at_participation", F.lit(0.5)).alias("capacity_median"), F.avg("portfolio_return").alias("daily_return_mean"),
        F.percentile("portfolio_return", F.lit(0.5)).alias("daily_return_median"),
        F.avg((F.col("portfolio_return") > 0).cast("double")).alias("daily_win_rate"),
        F.stddev_pop("portfolio_return").alias("daily_vol"), (F.stddev_pop("portfolio_return") * F.sqrt(F.lit(252.0))).alias("ann_vol"),
        sharpe("benchmark_return", 0).alias("benchmark_sharpe"), annualised(growth("portfolio_return"), n).alias("ann_return"),
        sharpe("portfolio_return", 0).alias("sharpe"), hac_t("portfolio_return").alias("hac_mean_t_5"),
        total.alias("total_return"), compound("gross_portfolio_return").alias("gross_total_return"),
        compound("benchmark_return").alias("benchmark_total_return"),
        F.avg("active_return").alias("active_return_mean"), sharpe("active_return", 0).alias("active_sharpe"),
        ((1.0 + total) / (1.0 + compound("benchmark_exposure_matched_return")) - 1.0).alias("relative_nav"),
        F.min("_dd").alias("max_drawdown"))
    for r, name in (("benchmark_return", "benchmark_hac_t_5"), ("active_return", "active_hac_t_5")):
        m = m.join(newey_west(daily, by, order, r, name=name), by, "left")
    return m


def stressed_daily(trades: DataFrame, days: DataFrame, policies: list[str], bps: list[float]) -> DataFrame:
    """Portfolio return per cost level, re-priced from gross: sums are shared, the levels are applied after."""
    g = trades.groupBy("signal_date", "top_k", "exit_policy").agg(
        F.count(F.lit(1)).alias("filled"), F.avg("gross_return").alias("_g"))
    base = date_policy_grid(days, policies, ["signal_date", "top_k"]).join(g, ["signal_date", "top_k", "exit_policy"], "left")
    d = with_scenarios(base, ["drag_bps"], [(float(b),) for b in bps])
    return d.withColumn("filled", F.coalesce("filled", F.lit(0).cast("bigint"))).withColumn(
        "portfolio_return", F.coalesce(F.col("_g") - F.col("drag_bps") / 10000.0, F.lit(0.0)) * F.col("filled") / F.col("top_k")).drop("_g")


def cost_stress(daily: DataFrame, benchmark: DataFrame, by: list[str], order: str = "signal_date") -> DataFrame:
    """Selected, benchmark and active metrics per cost level."""
    b = benchmark.select("signal_date", "exit_policy", "benchmark_slots", "benchmark_executed", "benchmark_gross_return_sum")
    d = daily.join(b, ["signal_date", "exit_policy"], "left")
    d = fail_where(d, F.col("benchmark_slots").isNull(), "benchmark_slots", "a selection date has no benchmark")
    bsum = F.col("benchmark_gross_return_sum") - F.col("drag_bps") / 10000.0 * F.col("benchmark_executed")
    matched = F.coalesce(safe_divide(bsum, "benchmark_executed"), F.lit(0.0)) * F.col("filled") / F.col("top_k")
    d = d.withColumns({"_bench": bsum / F.col("benchmark_slots"), "_matched": matched})
    d = d.withColumn("_active", F.col("portfolio_return") - F.col("_matched"))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.avg("portfolio_return").alias("selected_return_mean"),
        sharpe("portfolio_return", 0).alias("selected_sharpe"), compound("portfolio_return").alias("selected_total_return"),
        F.avg("_bench").alias("benchmark_return_mean"), F.avg("_active").alias("active_return_mean"),
        sharpe("_active", 0).alias("active_sharpe"),
        ((1.0 + compound("portfolio_return")) / (1.0 + compound("_matched")) - 1.0).alias("relative_nav"))


def bucket_mix(selected: DataFrame, buckets: list[str]) -> DataFrame:
    """Rows, share of selection and mean outcomes per (top_k, buckets)."""
    g = selected.groupBy("top_k", *buckets).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("open_to_high").alias("open_to_high_mean"),
        F.avg("open_to_close").alias("open_to_close_mean"),
        F.percentile("next_amount_cny", F.lit(0.5)).alias("median_next_amount_cny"))
    return g.withColumn("selection_share", F.col("rows") / F.sum("rows").over(Window.partitionBy("top_k")))


def band_mix(df: DataFrame, band: str, date: str, scope: str) -> DataFrame:
    """Daily weight per band, averaged over all dates (absent = 0), and its median when present."""
    day = df.groupBy(date, band).agg(F.count(F.lit(1)).alias("band_rows"))
    day = day.withColumn("w", F.col("band_rows") / F.sum("band_rows").over(Window.partitionBy(date)))
    dates = df.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    total = {"_rows": dates.agg(F.sum("n")).scalar(), "total_dates": dates.agg(F.count(F.lit(1))).scalar()}
    s = day.groupBy(band).agg(F.sum("band_rows").alias("rows"), F.count(F.lit(1)).alias("dates_present"), F.sum("w").alias("_w"),
                              F.percentile("w", F.lit(0.5)).alias("daily_weight_median_when_present"))
    return s.withColumns(total).select(
        F.lit(scope).alias("scope"), band, "rows", "dates_present", "total_dates", (F.col("rows") / F.col("_rows")).alias("row_share"),
        (F.col("_w") / F.col("total_dates")).alias("daily_weight_mean"), "daily_weight_median_when_present")
