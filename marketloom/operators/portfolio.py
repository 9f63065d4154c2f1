"""Portfolio formation, holdings and turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add_all, fail_where, safe_divide

DATE, SYM = "trade_date", "symbol"


def composite_score(df: DataFrame, signs: dict[str, float], out: str = "score") -> DataFrame:
    """Signed sum of standardised columns; a missing one counts as zero."""
    return df.withColumn(out, add_all([F.lit(s) * F.coalesce(F.col(c), F.lit(0.0)) for c, s in signs.items()]))


def mean_of_available(columns: list[str]) -> Column:
    """Mean of the non-null columns of a row."""
    total = add_all([F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    return safe_divide(total, add_all([F.col(c).isNotNull().cast("int") for c in columns]))


def topk_days(df: DataFrame, score: str, top_ks: list[int], target: str, adv: str, participation: float, means: tuple[str, ...] = (), hits: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """Per (date, K): names, turnover against the previous set, mean outcomes, hit rates in percent steps, and capacity."""
    from ..functions.expr import with_scenarios
    from .calendar import sessions
    from .execution import stays, top_rows

    top = with_scenarios(top_rows(df, score, max(top_ks)), ["top_k"], [(k,) for k in top_ks]).where("raw_rank <= top_k")
    marked = stays(top, sessions(df), DATE, ["top_k"])
    day = marked.groupBy(DATE, "top_k").agg(
        F.count(F.lit(1)).alias("names"), F.sum(F.col("stayed").cast("bigint")).alias("_kept"), F.avg(target).alias("target_mean"),
        *[F.avg(F.coalesce(F.col(target) >= h / 100, F.lit(False)).cast("double")).alias(f"hit_{h}pct") for h in hits], *[F.avg(c).alias(f"{c}_mean") for c in means],
        F.percentile(adv, F.lit(0.5)).alias("median_adv"), F.percentile(adv, F.lit(0.25)).alias("p25_adv"),
        (F.sum(adv) * participation).alias("capacity"), F.min("session").alias("_s"))
    turnover = F.when(F.col("_s") == 1, 1.0).otherwise(1.0 - F.col("_kept") / F.col("names"))
    return day.withColumn("turnover", turnover).drop("_kept", "_s")


def topk_summary(days: DataFrame) -> DataFrame:
    """Per K over dates: days, means of names, turnover, outcomes and hit rates, medians of volume and capacity."""
    medians = ["median_adv", "p25_adv", "capacity"]  # one value per date
    means = [c for c in days.columns if c not in (DATE, "top_k", *medians)]
    return days.groupBy("top_k").agg(
        F.count_distinct(DATE).alias("days"), *[F.avg(c).alias(c if c.endswith("_mean") or c.startswith("hit_") else f"avg_{c}") for c in means],
        *[F.percentile(c, F.lit(0.5)).alias(c) for c in medians])


def dense_index(df: DataFrame, date: str = DATE) -> DataFrame:
    """Dense index over the distinct dates of a table, and a mark on the last one (date-level)."""
    w = Window.orderBy(date)
    return df.select(date).distinct().withColumns({"idx": F.row_number().over(w), "is_last": F.lead(date).over(w).isNull()})


def set_turnover(members: DataFrame, by: list[str] | None = None, date: str = DATE) -> DataFrame:
    """|entered| + |left| between consecutive rebalances, with both set sizes."""
    by = by or []
    m = members.select(*by, date, SYM).distinct().join(dense_index(members, date), date)
    w = Window.partitionBy(*by, SYM).orderBy("idx")
    d = m.withColumns({"_new": ~F.coalesce(F.lag("idx").over(w) == F.col("idx") - 1, F.lit(False)),
                       "_leaves": ~F.coalesce(F.lead("idx").over(w) == F.col("idx") + 1, F.lit(False))})
    entered = d.groupBy(*by, "idx").agg(F.count(F.lit(1)).alias("names"), F.sum(F.col("_new").cast("bigint")).alias("entered"))
    left = (d.where(F.col("_leaves") & ~F.col("is_last")).groupBy(*by, (F.col("idx") + 1).alias("idx"))
            .agg(F.count(F.lit(1)).alias("exited")))
    out = entered.join(left, [*by, "idx"], "full").fillna(0, ["names", "entered", "exited"])
    return out.join(dense_index(members, date).drop("is_last"), "idx")


def pit_top_n(universe: DataFrame, bars: DataFrame, n: int, min_listed: int, metric: str = "liq_metric") -> DataFrame:
    """Listed long enough and trading, ranked by metric then symbol; a date with fewer than ``n`` names is an error."""
    from ..functions.expr import flag
    ok = bars.where((F.col("listed_days") >= min_listed) & ~flag("is_suspended")).select(DATE, SYM)
    w = Window.partitionBy(DATE).orderBy(F.col(metric).desc(), F.col(SYM))
    top = universe.join(ok, [DATE, SYM]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    size = F.count(F.lit(1)).over(Window.partitionBy(DATE))  # at most n rows per date
    return fail_where(top.withColumn("_n", size), F.col("_n") < n, "rank", f"fewer than {n} eligible names on some date").drop("_n")


def kth_largest_filter(df: DataFrame, value: str, k: int, min_rows: int) -> DataFrame:
    """Rows at or above the date's k-th largest value (ties kept), or of symbols with a long history.

    The k-th largest is a top-k with map-side limits, joined back as one number per date.
    """
    w = Window.partitionBy(DATE).orderBy(F.col(value).desc())
    kth = (df.select(DATE, value).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
           .groupBy(DATE).agg(F.min(value).alias("_kth")))
    long = df.groupBy(SYM).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(kth, DATE, "left").join(long, SYM)
    return d.where((F.col(value) >= F.col("_kth")) | (F.col("_n") >= min_rows)).drop("_kth", "_n")


def sample_per_date(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """At most ``n`` rows per date, chosen by a seeded hash of the key (repeatable; map-side limited)."""
    w = Window.partitionBy(DATE).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def position_exposure_to(targets: DataFrame, scores: DataFrame, weight: str, score: str) -> DataFrame:
    """Weighted mean score, names and largest weight per date."""
    d = targets.join(scores, [DATE, SYM], "left")
    return d.groupBy(DATE).agg(
        (F.sum(F.col(weight) * F.col(score)) / F.sum(F.when(F.col(score).isNotNull(), F.col(weight)))).alias("score"),
        F.count(F.lit(1)).alias("names"), F.max(weight).alias("max_weight"))


def union_keys(parts: list[DataFrame]) -> DataFrame:
    """Distinct keys of several activity sources."""
    out = parts[0].select(DATE, SYM)
    for p in parts[1:]:
        out = out.union(p.select(DATE, SYM))
    return out.distinct()


def qualified_activity(parts: list[DataFrame], qualified: DataFrame) -> DataFrame:
    """Keys active in any source that are also qualified."""
    return union_keys(parts).join(qualified.select(DATE, SYM), [DATE, SYM], "left_semi")


def attach_full(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left join that must find a unique value for every row."""
    from .keys import assert_unique
    out = left.join(assert_unique(right.select(key, value), [key], value), key, "left")
    return fail_where(out, F.col(value).isNull(), value, f"{value} does not cover every row")


def equal_weight_top(df: DataFrame, score: str, k: int, by: list[str] | None = None) -> DataFrame:
    """Top ``k`` names per date (and group) at equal weight."""
    from .execution import top_rows
    groups = [DATE, *(by or [])]
    top = top_rows(df, score, k, groups)
    return top.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*groups)))


def equal_weight_benchmark(bars: DataFrame, start: str) -> DataFrame:
    """Mean one-row return of unsuspended rows per date; the return is taken after the filter."""
    from .rolling import pct_change
    d = bars.where((F.col(DATE) >= F.lit(start).cast("date")) & ~F.col("is_suspended"))
    return d.withColumn("_r", pct_change("close")).groupBy(DATE).agg(F.avg("_r").alias("benchmark_return"))


def curve_metrics(curve: DataFrame, by: list[str]) -> DataFrame:
    """Return, risk and drawdown of a position curve beside its benchmark (population std)."""
    from ..functions.stats import annualised, compound, drawdown, growth, sharpe
    d = drawdown(curve, by, DATE, "portfolio_return")
    total, n = compound("portfolio_return"), F.count(F.lit(1))
    return d.groupBy(*by).agg(
        n.alias("days"), F.avg("n_positions").alias("n_positions_avg"), total.alias("total_return"), annualised(growth("portfolio_return"), n).alias("ann_return"),
        (F.stddev_pop("portfolio_return") * F.sqrt(F.lit(252.0))).alias("ann_vol"), sharpe("portfolio_return", 0).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col("portfolio_return") > 0).cast("double")).alias("win_rate_days"),
        compound("benchmark_return").alias("benchmark_total_return"),
        ((1.0 + total) / (1.0 + compound("benchmark_return")) - 1.0).alias("excess_total_return"))


def formation_targets(bucketed: DataFrame, calendar: DataFrame, n: int = 5, short_allowed: DataFrame | None = None) -> DataFrame:
    """Top bucket long, bottom bucket short (optionally only allowed names), equal weight, effective next session."""
    from .calendar import next_session
    long = bucketed.where(F.col("valid") & (F.col("bucket") == n - 1)).select(DATE, SYM, F.lit("long").alias("side"))
    short = bucketed.where(F.col("valid") & (F.col("bucket") == 0)).select(DATE, SYM, F.lit("short").alias("side"))
    if short_allowed is not None:
        short = short.join(short_allowed.select(DATE, SYM), [DATE, SYM], "left_semi")
    both = long.unionByName(short)
    sizes = both.groupBy(DATE, "side").agg(F.count(F.lit(1)).alias("_n"))
    two = sizes.groupBy(DATE).agg(F.count(F.lit(1)).alias("_sides")).where("_sides = 2").select(DATE)
    when = next_session(two, calendar, DATE, "execution_date").where("execution_date is not null")
    return both.join(sizes, [DATE, "side"]).join(when, DATE).select(DATE, "execution_date", SYM, "side", (1.0 / F.col("_n")).alias("weight"))


def active_dates(formations: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions in (formation, next formation] of valid formations; the last formation is open and left out."""
    from .calendar import last_session_before
    marks = formations.select(F.col("formation_date").alias(DATE))
    d = last_session_before(calendar.select(DATE).distinct(), marks, "formation_date")
    last = formations.agg(F.max("formation_date").alias("formation_date"))
    return (d.where("formation_date is not null").join(formations.where("valid").select("formation_date"), "formation_date", "left_semi")
            .join(last, "formation_date", "left_anti").select("formation_date", DATE))


def weight_turnover(targets: DataFrame, by: list[str], weight: str = "weight", dates: DataFrame | None = None) -> DataFrame:
    """Σ|w − previous w| per rebalance and group, from one lagged pass over each symbol's own rebalances.

    ``dates`` are all rebalance dates, those with an empty book too: on these everything is sold.
    """
    idx = dense_index(targets if dates is None else dates)
    d = targets.join(idx, DATE)
    w = Window.partitionBy(*by, SYM).orderBy("idx")
    prev = F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag(weight).over(w)).otherwise(0.0)
    leaves = ~F.coalesce(F.lead("idx").over(w) == F.col("idx") + 1, F.lit(False))
    d = d.withColumns({"_move": F.abs(F.col(weight) - prev), "_leaves": leaves})
    kept = d.select(*by, "idx", "_move")
    gone = d.where(F.col("_leaves") & ~F.col("is_last")).select(*by, (F.col("idx") + 1).alias("idx"), F.col(weight).alias("_move"))
    return kept.unionByName(gone).groupBy(*by, "idx").agg(F.sum("_move").alias("traded")).join(idx, "idx").drop("idx", "is_last")


def cost_adjusted_spread(legs: DataFrame, cost_bps: list[float], terminals: list[float], dates: DataFrame | None = None) -> DataFrame:
    """Long − short − traded × cost for every cost and terminal-return scenario; a name without a next return takes the terminal one.

    ``dates`` are all formation dates. One without legs (an invalid formation) has an empty book: it earns nothing and
    pays for selling the book before. Sums are formed once per date and side; the scenarios multiply only those few rows.
    """
    from ..functions.expr import with_scenarios
    n = F.count(F.lit(1))
    side = legs.groupBy(DATE, "side").agg(F.coalesce(F.sum("next_ret"), F.lit(0.0)).alias("_s"), (n - F.count("next_ret")).alias("_miss"), n.alias("_n"))
    weights = legs.join(side.select(DATE, "side", "_n"), [DATE, "side"]).select(DATE, SYM, "side", (1.0 / F.col("_n")).alias("weight"))
    d = weight_turnover(weights, ["side"], dates=dates).join(side, [DATE, "side"], "left")
    grid = with_scenarios(d, ["cost_bps", "terminal"], [(float(c), float(t)) for c in cost_bps for t in terminals])
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    g = grid.groupBy(DATE, "cost_bps", "terminal").agg(
        F.sum(sign * F.coalesce((F.col("_s") + F.col("_miss") * F.col("terminal")) / F.col("_n"), F.lit(0.0))).alias("gross"), F.sum("traded").alias("traded"))
    return g.withColumn("net", F.col("gross") - F.col("traded") * F.col("cost_bps") / 10000.0)


def fill_ratios(targets: DataFrame, bars: DataFrame, days: int, participation: float, target: float, unit: float = 1000.0) -> DataFrame:
    """Executable notional of each position over its symbol's next ``days`` rows against the target, at most 1.

    The next rows are a forward frame over each symbol's bars; positions join the bar at or after their date.
    """
    w = Window.partitionBy(SYM).orderBy(DATE)
    both = (bars.select(SYM, DATE, "amount", F.lit(0).alias("_ask"))
            .unionByName(targets.select(SYM, DATE, F.lit(None).cast("double").alias("amount"), F.lit(1).alias("_ask"))))
    d = both.groupBy(SYM, DATE).agg(F.max("amount").alias("amount"), F.max("_ask").alias("_ask"))
    d = d.withColumn("_bar", F.sum(F.col("amount").isNotNull().cast("int")).over(w))
    ahead = Window.partitionBy(SYM).orderBy("_bar").rangeBetween(1, days)
    mean = F.avg("amount").over(ahead)
    f = d.withColumn("_exec", mean * participation * days * unit).where("_ask = 1")
    return f.select(DATE, SYM, F.coalesce(F.least(F.lit(1.0), F.col("_exec") / target), F.lit(0.0)).alias("fill"))


def fill_summary(fills: DataFrame) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return fills.agg(F.count(F.lit(1)).alias("positions"), F.avg("fill").alias("avg_fill"), share(F.col("fill") >= 1).alias("full_fill"),
                     share(F.col("fill") < 0.5).alias("below_half"), F.percentile("fill", F.lit(0.5)).alias("median_fill"))


def liquidity_depth(df: DataFrame, top_ns: list[int], k: int, notional: float, participation: float, days: int) -> DataFrame:
    """Amount of the k-th name inside each top-N universe, its median over dates, impact and feasibility."""
    from ..functions.expr import with_scenarios
    from .execution import top_rows
    top = with_scenarios(top_rows(df.select(DATE, SYM, "amount"), "amount", max(top_ns), rank="_k"), ["top_n"], [(n,) for n in top_ns]).where("_k <= top_n")
    kth = F.max(F.when(F.col("_k") <= k, F.struct("_k", "amount")))["amount"]
    day = top.groupBy("top_n", DATE).agg(kth.alias("kth"), F.percentile("amount", F.lit(0.5)).alias("med"))
    each = notional / k
    mid = lambda c: F.percentile(c, F.lit(0.5))
    out = day.groupBy("top_n").agg(mid("kth").alias("kth_amount"), mid("med").alias("median_amount"), mid(each / F.col("kth")).alias("impact"))
    return out.withColumn("feasible", F.col("kth_amount") * participation * days >= each)


def selection_stats(df: DataFrame, by: list[str], ok: str) -> DataFrame:
    """Daily selection counts and feasibility rates averaged per group."""
    day = df.groupBy(*by, DATE).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(ok).cast("double")).alias("_f"))
    return day.groupBy(*by).agg(F.avg("_n").alias("mean_selected"), F.avg("_f").alias("feasibility_rate"))
