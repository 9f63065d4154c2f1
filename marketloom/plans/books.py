"""Portfolio books: fixed-share quantile portfolios, long-only top-K, scored variants, indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add_all, fail_where
from ..functions.stats import annualised, compound, growth, nav, sharpe
from ..operators.calendar import last_session_before, next_session
from ..operators.execution import top_rows
from ..operators.ordering import ranked
from ..session import staged
from ..operators.portfolio import DATE, SYM, dense_index, equal_weight_top, set_turnover, weight_turnover
from ..operators.series import rolling_odds

KEYS = [DATE, SYM]


def fixed_share_returns(holdings: DataFrame, returns: DataFrame, calendar: DataFrame, by: list[str], cost_bps: float = 0.0) -> DataFrame:
    """Daily returns of target weights bought at each formation and left to drift until the next one.

    Value since formation = Σ weight × cumulative growth, so no state passes from day to day. A missing
    return is zero. ``holdings``: groups, trade_date (formation), symbol, weight. The traded weight times the
    cost is taken on the first day of a period.
    """
    h = holdings.select(*by, F.col(DATE).alias("formation_date"), SYM, "weight")
    marks = h.select(F.col("formation_date").alias(DATE)).distinct()
    days = last_session_before(calendar.select(DATE).distinct(), marks, "formation_date").where("formation_date is not null")
    held = h.join(days, "formation_date").join(returns.select(*KEYS, "ret"), KEYS, "left")
    w = Window.partitionBy(*by, SYM, "formation_date").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)  # one holding period
    growth = held.withColumn("_g", F.product(1.0 + F.coalesce("ret", F.lit(0.0))).over(w))
    value = growth.groupBy(*by, "formation_date", DATE).agg((F.sum(F.col("weight") * F.col("_g")) / F.sum("weight")).alias("_v"))
    p = Window.partitionBy(*by, "formation_date").orderBy(DATE)
    out = value.withColumn("ret", F.col("_v") / F.coalesce(F.lag("_v").over(p), F.lit(1.0)) - 1.0)
    if cost_bps:
        traded = weight_turnover(holdings.select(*by, DATE, SYM, "weight"), by).withColumnRenamed(DATE, "formation_date")
        cost = F.when(F.row_number().over(p) == 1, F.col("traded") * cost_bps / 10000.0).otherwise(0.0)
        out = out.join(traded, [*by, "formation_date"]).withColumn("ret", (1.0 + F.col("ret")) * (1.0 - cost) - 1.0)
    return out.select(*by, DATE, "ret")


def quantile_portfolios(bucketed: DataFrame, returns: DataFrame, calendar: DataFrame, n: int = 5) -> DataFrame:
    """Long table (trade_date, leg, ret): buckets q1..qn, universe, long, short, long_short, long_excess."""
    valid = bucketed.where("valid")
    leg = F.explode(F.array(F.concat(F.lit("q"), (F.col("bucket") + 1).cast("string")), F.lit("universe")))
    h = valid.select(*KEYS, leg.alias("leg"))
    h = h.join(h.groupBy(DATE, "leg").agg((1.0 / F.count(F.lit(1))).alias("weight")), [DATE, "leg"])
    daily = fixed_share_returns(h, returns, calendar, ["leg"])
    w = daily.groupBy(DATE).pivot("leg", [*[f"q{i}" for i in range(1, n + 1)], "universe"]).agg(F.first("ret"))
    top, low = F.col(f"q{n}"), F.col("q1")
    w = w.withColumns({"long": top, "short": low, "long_short": top - low, "long_excess": top - F.col("universe")})
    return w.unpivot([DATE], [c for c in w.columns if c != DATE], "leg", "ret")


def shared_quantile_portfolios(bucketed: DataFrame, returns: DataFrame, formation: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """``quantile_portfolios`` of several books over the same names: (by, trade_date, leg, ret).

    A name's growth since a formation is the same in every book, so it is computed once; the books of a name are one list with
    an entry each, and their values are summed on the map side. A book is held until the next formation date, valid or not.
    """
    h = staged(bucketed.where("valid").groupBy(F.col(DATE).alias("formation_date"), SYM).agg(F.collect_list(F.struct(*by, "bucket")).alias("_books")))
    days = last_session_before(returns.select(DATE).distinct(), formation, "formation_date").where("formation_date is not null")
    held = h.select("formation_date", SYM).join(F.broadcast(days), "formation_date").join(returns.select(*KEYS, "ret"), KEYS, "left")
    w = Window.partitionBy("formation_date", SYM).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)  # one holding period
    grown = held.select("formation_date", SYM, DATE, F.product(1.0 + F.coalesce("ret", F.lit(0.0))).over(w).alias("_g"))
    rows = grown.join(h, ["formation_date", SYM]).select("formation_date", DATE, "_g", F.explode("_books").alias("_b")).select("formation_date", DATE, "_g", "_b.*")
    value = {**{f"q{i + 1}": F.avg(F.when(F.col("bucket") == i, F.col("_g"))) for i in range(n)}, "universe": F.avg("_g")}
    v = rows.groupBy(*by, "formation_date", DATE).agg(*[c.alias(name) for name, c in value.items()])
    p = Window.partitionBy(*by, "formation_date").orderBy(DATE)
    v = v.select(*by, DATE, *[(F.col(c) / F.coalesce(F.lag(c).over(p), F.lit(1.0)) - 1.0).alias(c) for c in value])
    top, low = F.col(f"q{n}"), F.col("q1")
    v = v.withColumns({"long": top, "short": low, "long_short": top - low, "long_excess": top - F.col("universe")})
    return v.unpivot([*by, DATE], [c for c in v.columns if c not in (*by, DATE)], "leg", "ret")


def held_with_stuck(top: DataFrame, entry_bars: DataFrame) -> DataFrame:
    """Held names per rebalance: buyable top names, and earlier holdings that cannot be sold.

    held(i) = buyable-top(i) or (held(i−1) and stuck(i)). A run of consecutive stuck rebalances inherits the
    first row's state, so islands per symbol replace the loop. ``top``: idx, symbol; ``entry_bars``: idx,
    symbol, buy_tradable, sell_tradable on the entry date.
    """
    t = top.join(entry_bars.where("buy_tradable"), ["idx", SYM], "left_semi").select("idx", SYM, F.lit(True).alias("_top"), F.lit(False).alias("_stuck"))
    s = entry_bars.where(~F.col("sell_tradable")).select("idx", SYM, F.lit(False).alias("_top"), F.lit(True).alias("_stuck"))
    rows = t.unionByName(s).groupBy("idx", SYM).agg(F.max("_top").alias("_top"), F.max("_stuck").alias("_stuck"))
    w = Window.partitionBy(SYM).orderBy("idx")  # at most one row per rebalance
    joins = F.col("_stuck") & F.coalesce(F.lag("idx").over(w) == F.col("idx") - 1, F.lit(False))
    rows = rows.withColumn("_run", F.sum((~joins).cast("int")).over(w))
    upto = Window.partitionBy(SYM, "_run").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_held", F.max("_top").over(upto)).where("_held").select("idx", SYM, F.col("_top").alias("bought"), F.col("_stuck").alias("stuck"))


def long_only_topk(panel: DataFrame, bars: DataFrame, calendar: DataFrame, score: str, k: int, cost_bps: float) -> DataFrame:
    """Rebalanced equal-weight top-K with next-session execution; the entry day earns nothing but pays the turnover cost.

    ``bars`` carry ret, buy_tradable and sell_tradable.
    """
    cal = calendar.select(DATE).distinct()
    reb = next_session(panel.select(DATE).distinct(), cal, DATE, "entry_date").where("entry_date is not null")
    last = cal.agg(F.max(DATE)).scalar()
    w = Window.orderBy(DATE)  # rebalance dates
    reb = staged(reb.withColumns({"idx": F.row_number().over(w), "_n": F.lead(DATE).over(w)})
                 .select(DATE, "entry_date", "idx", F.coalesce(F.col("_n"), last).alias("end_date")))
    top = staged(top_rows(panel.where(F.col(score).isNotNull()), score, k).join(reb.select(DATE, "idx"), DATE).select("idx", SYM))
    entry = bars.select(F.col(DATE).alias("entry_date"), SYM, "buy_tradable", "sell_tradable").join(reb.select("entry_date", "idx"), "entry_date").drop("entry_date")
    held = staged(held_with_stuck(top, entry))
    prev = held.select((F.col("idx") + 1).alias("idx"), SYM)
    sold = (prev.join(top, ["idx", SYM], "left_anti").join(entry.where("sell_tradable"), ["idx", SYM], "left_semi")
            .groupBy("idx").agg(F.count(F.lit(1)).alias("sold")))
    kept = prev.join(entry.where(~F.col("sell_tradable")), ["idx", SYM], "left_semi").groupBy("idx").agg(F.count(F.lit(1)).alias("stuck"))
    moves = (held.where("bought").groupBy("idx").agg(F.count(F.lit(1)).alias("bought")).join(sold, "idx", "full").join(kept, "idx", "full")
             .fillna(0, ["bought", "sold", "stuck"]))
    span = reb.select(F.col("entry_date").alias(DATE), F.col("idx").alias("_i"))
    days = last_session_before(cal, span.select(DATE), "entry_date").where("entry_date is not null").join(reb.select("entry_date", "idx", "end_date"), "entry_date")
    days = days.where(F.col(DATE) <= F.col("end_date")).select(DATE, "idx")
    earned = staged(held.select("idx", SYM).join(days, "idx").join(bars.select(*KEYS, "ret"), KEYS).groupBy("idx", DATE).agg(F.avg("ret").alias("ret")))
    paid = (moves.join(earned.select("idx").distinct(), "idx", "left_semi").join(reb.select("idx", F.col("entry_date").alias(DATE)), "idx")
            .select(DATE, (-(F.col("bought") + F.col("sold") + F.col("stuck")) / k * cost_bps / 10000.0).alias("ret")))
    return earned.select(DATE, "ret").unionByName(paid).groupBy(DATE).agg(compound("ret").alias("ret"))


def topk_periods(panel: DataFrame, returns: DataFrame, score: str, k: int, cost_bps: float) -> DataFrame:
    """Per formation: compounded mean return of the top-K over (formation, next formation], two-sided cost on half the set turnover."""
    top = top_rows(panel.where(F.col(score).isNotNull()), score, k).select(*KEYS)
    turn = set_turnover(top).select(F.col(DATE).alias("formation_date"), "idx",
                                    F.when(F.col("idx") == 1, 1.0).otherwise((F.col("entered") + F.col("exited")) / (2.0 * k)).alias("turnover"))
    days = last_session_before(returns.select(DATE).distinct(), panel.select(DATE).distinct(), "formation_date").where("formation_date is not null")
    held = top.withColumnRenamed(DATE, "formation_date").join(days, "formation_date").join(returns.select(*KEYS, "ret"), KEYS)
    daily = held.groupBy("formation_date", DATE).agg(F.avg("ret").alias("_r"))
    p = daily.groupBy("formation_date").agg(compound("_r").alias("gross_return")).join(turn, "formation_date")
    return p.withColumn("period_return", (1.0 + F.col("gross_return")) * (1.0 - F.col("turnover") * 2.0 * cost_bps / 10000.0) - 1.0).drop("idx")


def scored_books(panel: DataFrame, variants: list[tuple[str, dict[str, float]]], top_ks: list[int], cost_bps: float, target: str = "next_ret") -> DataFrame:
    """Top-K books of many weightings in one job: (variant, top_k, trade_date, names, turnover, ret).

    Scores are formed in the row; each map task keeps only the best K rows per variant and date before the shuffle.
    """
    cols = sorted({c for _, w in variants for c in w})
    score = lambda w: add_all([F.lit(float(w[c])) * F.coalesce(F.col(c), F.lit(0.0)) for c in cols if c in w])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), score(w).alias("score")) for n, w in variants]))
    s = panel.select(*KEYS, target, each.alias("_v")).select(*KEYS, target, "_v.variant", "_v.score")
    from ..functions.expr import with_scenarios
    top = with_scenarios(top_rows(s, "score", max(top_ks), ["variant", DATE]), ["top_k"], [(k,) for k in top_ks]).where("raw_rank <= top_k")
    by = ["variant", "top_k"]
    r = top.groupBy(*by, DATE).agg(F.count(F.lit(1)).alias("names"), F.avg(target).alias("_g"))
    t = set_turnover(top.select(*by, *KEYS), by).select(*by, DATE, "entered", "exited")
    out = r.join(t, [*by, DATE]).withColumn("turnover", (F.col("entered") + F.col("exited")) / F.col("top_k"))
    return out.withColumn("ret", (1.0 + F.coalesce("_g", F.lit(0.0))) * (1.0 - F.col("turnover") * cost_bps / 10000.0) - 1.0).drop("_g", "entered", "exited")


def rank_books(books: DataFrame, per_year: int, odds_window: int) -> DataFrame:
    """Annual return, Sharpe and rolling odds per variant and K."""
    n = F.count(F.lit(1))
    m = books.groupBy("variant", "top_k").agg(n.alias("periods"), annualised(growth("ret"), n, per_year).alias("ann"), sharpe("ret", 1, per_year).alias("sharpe"), F.avg("turnover").alias("turnover"))
    long = books.select(F.concat_ws("|", "variant", F.col("top_k").cast("string")).alias("series"), DATE, "ret")
    o = rolling_odds(long, (odds_window,)).select(F.substring_index("series", "|", 1).alias("variant"),
                                                  F.substring_index("series", "|", -1).cast("int").alias("top_k"), "odds")
    return m.join(o, ["variant", "top_k"], "left")


def equal_weight_index(membership: DataFrame, bars: DataFrame, top_n: int, max_gap: float = 0.1) -> DataFrame:
    """Equal-weight return of the membership in force (latest rebalance strictly before the date); missing return = 0.

    Raises when a date does not hold exactly ``top_n`` names or a reported return disagrees with its prices.
    """
    m = membership.select(F.col(DATE).alias("rebalance_date"), SYM)
    cal = bars.select(DATE).distinct()
    days = last_session_before(cal, m.select(F.col("rebalance_date").alias(DATE)).distinct(), "rebalance_date").where("rebalance_date is not null")
    held = m.join(days, "rebalance_date").join(bars.select(*KEYS, "pct_chg", "close", "pre_close"), KEYS, "left")
    gap = F.abs(F.col("pct_chg") - (F.col("close") / F.col("pre_close") - 1.0) * 100.0) > max_gap
    d = held.groupBy(DATE).agg((F.avg(F.coalesce("pct_chg", F.lit(0.0))) / 100.0).alias("ret"), F.count_distinct(SYM).alias("names"),
                               F.sum(F.col("pct_chg").isNull().cast("bigint")).alias("missing"), F.max(F.coalesce(gap, F.lit(False))).alias("_gap"))
    d = fail_where(d, (F.col("names") != top_n) | F.col("_gap"), "ret", "membership size or reported returns are inconsistent")
    return d.drop("_gap")


def top_fraction(df: DataFrame, score: str, fraction: float, group: str) -> DataFrame:
    """Top share of every group per date (at least one name), equal weight over the date; ties by symbol.

    The share of a huge group is itself huge, so the cut is an exact rank (see ``ordering``) and only the
    names tied at the cut are ordered by symbol.
    """
    by = [DATE, group]
    d = df.where(F.col(score).isNotNull()).select(*KEYS, group, (-F.col(score)).alias("_v"))
    d = staged(ranked(d, by, "_v", "_r_"))
    ties = (F.col("_r_avg") - F.col("_r_min")) * 2 + 1
    d = d.withColumns({"_k": F.greatest(F.lit(1), F.floor(F.col("_r_n") * fraction)), "_last": F.col("_r_min") + ties - 1})
    sure = d.where(F.col("_last") <= F.col("_k"))
    edge = ranked(d.where((F.col("_r_min") <= F.col("_k")) & (F.col("_last") > F.col("_k"))), by, SYM, "_e_")
    kept = sure.select(*KEYS).unionByName(edge.where(F.col("_e_min") <= F.col("_k") - F.col("_r_min") + 1).select(*KEYS))
    return kept.join(kept.groupBy(DATE).agg((1.0 / F.count(F.lit(1))).alias("weight")), DATE)


def blend(sleeves: dict[str, DataFrame], shares: dict[str, float]) -> DataFrame:
    """Weighted union of sleeves; a name in several sleeves adds up."""
    parts = [df.select(*KEYS, (F.col("weight") * shares[n]).alias("weight")) for n, df in sleeves.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEYS).agg(F.sum("weight").alias("weight"))


def sleeves(panel: DataFrame, scores: list[str], k: int) -> dict[str, DataFrame]:
    return {s: equal_weight_top(panel.where(F.col(s).isNotNull()).select(*KEYS, s), s, k).select(*KEYS, "weight") for s in scores}


def target_turnover(targets: DataFrame, by: list[str]) -> DataFrame:
    """Σ|Δweight| between consecutive rebalances."""
    return weight_turnover(targets, by)


def start_sweep(books: DataFrame, benchmark: DataFrame, cost_bps: float, per_year: int) -> DataFrame:
    """Result of every book from every one of its dates on, beside the benchmark's return over the same dates.

    A path that starts at a date buys all its names there. What follows is shared by all starts, so growth, sums and the
    deepest fall are running aggregates from the last date back: one pass over a book's rows, whatever the number of starts.
    A fall lies between two dates of the path, so it does not depend on the cost of entry. ``benchmark`` has one ``benchmark_ret`` a date.
    """
    by, cost = ["variant", "top_k"], cost_bps / 10000.0
    back = Window.partitionBy(*by).orderBy(F.col(DATE).desc())
    here, later = back.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, -1)
    entry = (1.0 + F.col("ret")) / (1.0 - F.col("turnover") * cost) * (1.0 - F.col("names") / F.col("top_k") * cost) - 1.0
    d = nav(books.join(benchmark.select(DATE, "benchmark_ret"), DATE, "left"), by, DATE, "ret").withColumn("_first", entry)
    d = d.withColumns({"_low": F.try_divide(F.min("nav").over(here), "nav") - 1.0, "periods": F.count(F.lit(1)).over(here)})
    after = lambda agg, x, none: F.coalesce(agg(x).over(later), F.lit(none))
    d = d.withColumns({
        "_growth": (1.0 + F.col("_first")) * after(F.product, 1.0 + F.col("ret"), 1.0), "max_drawdown": F.min("_low").over(here),
        "_mean": (F.col("_first") + after(F.sum, F.col("ret"), 0.0)) / F.col("periods"),
        "_square": F.col("_first") * F.col("_first") + after(F.sum, F.col("ret") * F.col("ret"), 0.0),
        "benchmark_return": F.product(1.0 + F.coalesce("benchmark_ret", F.lit(0.0))).over(here) - 1.0,
    })
    spread = F.try_divide(F.col("_square") - F.col("periods") * F.col("_mean") * F.col("_mean"), F.col("periods") - 1.0)
    return d.select(*by, F.col(DATE).alias("start"), "periods", (F.col("_growth") - 1.0).alias("total_return"),
                    annualised(F.col("_growth"), F.col("periods"), per_year).alias("ann"), "max_drawdown", "benchmark_return",
                    F.when(spread > 1e-16, F.col("_mean") / F.sqrt(spread) * F.sqrt(F.lit(float(per_year)))).alias("sharpe"))


def filled_benchmark(long: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Attach the benchmark level, repeating the last known one where its date is missing, and its return."""
    d = long.select(DATE).distinct().join(benchmark.select(DATE, "level"), DATE, "left")
    w = Window.orderBy(DATE)  # date-level
    d = d.withColumn("_l", F.last("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("benchmark_ret", F.coalesce(F.col("_l") / F.lag("_l").over(w) - 1.0, F.lit(0.0))).select(DATE, "benchmark_ret")
    return long.join(d, DATE)


def rebalance_every(calendar: DataFrame, n: int) -> DataFrame:
    """Every n-th session of a calendar."""
    return dense_index(calendar).where(F.col("idx") % n == 1).select(DATE)
