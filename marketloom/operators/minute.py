"""Minute-path execution audit: all dates and names in one job.

Bars of one (symbol, session) meet in one task; the session grid bounds them. Nothing loops over bars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import all_of, any_of, fail_where, flag, safe_divide, to_number, with_scenarios
from ..functions.stats import compound, sharpe
from .execution import net_return

DATE, SYM = "trade_date", "symbol"


@dataclass(frozen=True)
class Session:
    """Expected stamps: blocks of (first minute of day, bars), ``step`` minutes apart."""

    blocks: tuple[tuple[int, int], ...] = ((570, 121), (781, 120))
    step: int = 1

    @property
    def bars(self) -> int:
        return sum(n for _, n in self.blocks)

    def slot(self, time: str) -> Column:
        """Position of a stamp in the session, null when it is not expected."""
        minute = F.hour(time) * 60 + F.minute(time)
        out, offset = F.lit(None).cast("int"), 0
        for start, n in self.blocks:
            here = (F.second(time) == 0) & (minute >= start) & (minute < start + n * self.step) & ((minute - start) % self.step == 0)
            out = F.when(here, ((minute - start) / self.step + offset).cast("int")).otherwise(out)
            offset += n
        return out


@dataclass(frozen=True)
class Terms:
    """Execution terms of the audit."""

    entry_slot: int = 1
    take_profit: float = 0.08
    strict: bool = True
    entry_bps: float = 5.0
    exit_bps: float = 5.0
    cost_bps: float = 20.0
    participation: float = 0.05
    opening_bars: int = 5


def session_summary(bars: DataFrame, session: Session, terms: Terms) -> DataFrame:
    """One row per (symbol, session): completeness, validity, entry bar, later path, first target hit."""
    num = bars.withColumns({c: to_number(F.col(c)) for c in ("open", "high", "low", "close", "amount")})
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    valid = F.coalesce((o > 0) & (h > 0) & (low > 0) & (c > 0) & (h >= F.greatest(o, c, low)) & (low <= F.least(o, c, h)), F.lit(False))
    day = Window.partitionBy(SYM, DATE)
    d = num.withColumns({"slot": session.slot("trade_time"), "_valid": valid})
    at_entry = F.col("slot") == terms.entry_slot
    d = d.withColumns({"entry_reference": F.max(F.when(at_entry, c)).over(day),
                       "_row": F.row_number().over(day.orderBy("trade_time"))})
    target = F.col("entry_reference") * (1.0 + terms.take_profit)
    later = F.col("slot") > terms.entry_slot
    last = session.bars - 1
    g = d.groupBy(SYM, DATE).agg(
        F.count(F.lit(1)).alias("bar_count"), F.count("slot").alias("in_grid"), F.count_distinct("slot").alias("slots"),
        F.max("entry_reference").alias("entry_reference"), F.max(F.when(at_entry, F.col("amount"))).alias("entry_bar_amount"),
        F.max(F.when(F.col("slot") == last, c)).alias("close_reference"), F.min("_valid").alias("valid"),
        F.max(F.when(later, h)).alias("path_high"), F.max_by(F.when(later, c), F.when(later, F.col("slot"))).alias("path_close"),
        F.min(F.when(later & (h >= target), F.col("trade_time"))).alias("touch_time"),
        F.min(F.when(later & (h > target), F.col("trade_time"))).alias("cross_time"),
        F.max(F.when(F.col("slot") == last, F.col("trade_time"))).alias("close_time"),
        F.sum(F.when(F.col("_row") <= terms.opening_bars, F.coalesce("amount", F.lit(0.0)))).alias("opening_amount"))
    distinct = (F.col("bar_count") == F.col("in_grid")) & (F.col("in_grid") == F.col("slots"))
    ends = F.col("entry_reference").isNotNull() & F.col("close_reference").isNotNull()
    return g.withColumns({"full_session": distinct & (F.col("bar_count") == session.bars),
                          "sparse_session": distinct & (F.col("bar_count") >= 2) & ends}).drop("in_grid", "slots")


def daily_limit(limit: str, reference: str = "entry_reference") -> Column:
    """A daily limit that is plausible beside the reference price, else null."""
    ratio = safe_divide(limit, reference)
    return F.when((F.col(limit) > 0) & (F.col(reference) > 0) & ratio.between(0.5, 1.5), F.col(limit))


def reasons(pairs: list[tuple[Column, str]]) -> Column:
    """Comma-joined names of the conditions that hold."""
    return F.array_join(F.filter(F.array(*[F.when(c, n) for c, n in pairs]), lambda x: x.isNotNull()), ",")


def entry_gates(df: DataFrame) -> DataFrame:
    up = F.col("daily_up_limit")
    d = df.withColumns({"daily_up_limit": daily_limit("exec_next_up_limit"), "daily_down_limit": daily_limit("exec_next_down_limit")})
    return d.withColumns({
        "minute_limit_available": up.isNotNull(), "entry_bar_amount_positive": F.coalesce(F.col("entry_bar_amount") > 0, F.lit(False)),
        "entry_blocked_limit_up": F.coalesce(F.col("entry_reference") >= up * 0.999, F.lit(False))})


def path_outcome(df: DataFrame, terms: Terms, close: str) -> DataFrame:
    """Exit at the target when the later path reaches it, else at the close; gross and net return."""
    target = F.col("entry_reference") * (1.0 + terms.take_profit)
    hit = F.col("cross_time" if terms.strict else "touch_time").isNotNull()
    out = F.when(hit, target).otherwise(F.col(close))
    down = (~hit) & F.col("daily_down_limit").isNotNull()
    return df.withColumns({
        "target_price": target, "target_touched": F.col("touch_time").isNotNull(), "target_crossed": F.col("cross_time").isNotNull(), "hit": hit,
        "exit_reference": out, "exit_time": F.when(hit, F.col("cross_time" if terms.strict else "touch_time")).otherwise(F.col("close_time")),
        "exit_reason": F.when(hit, F.lit("take_profit_cross" if terms.strict else "take_profit_touch")).otherwise(F.lit("close")),
        "gross_return": out / F.col("entry_reference") - 1.0,
        "net_return": net_return(F.col("entry_reference"), out, terms.entry_bps, terms.exit_bps, terms.cost_bps),
        "opening_capacity_cny": F.col("opening_amount") * terms.participation,
        "close_exit_limit_available": down, "close_exit_at_down_limit": down & (out <= F.col("daily_down_limit") * 1.001)})


def audit(candidates: DataFrame, bars: DataFrame, session: Session, terms: Terms, complete: str = "full_session") -> DataFrame:
    """Status and path result of every candidate (signal_date, entry_date, symbol and its daily gates)."""
    want = candidates.where(flag("execution_eligible")).select(SYM, F.col("entry_date").alias(DATE)).distinct()
    path = session_summary(bars.join(want, [SYM, DATE], "left_semi"), session, terms).withColumnRenamed(DATE, "entry_date")
    d = entry_gates(candidates.join(path, [SYM, "entry_date"], "left"))
    d = path_outcome(d, terms, "close_reference")
    blocked = ~F.col("minute_limit_available") | F.col("entry_blocked_limit_up") | ~F.col("entry_bar_amount_positive")
    status = (F.when(~flag("execution_eligible"), "signal_unfilled").when(F.col("bar_count").isNull(), "minute_missing")
              .when(~F.col(complete), "minute_incomplete").when(~F.col("valid"), "minute_invalid").when(blocked, "minute_entry_blocked").otherwise("audited"))
    daily = [(~flag("entry_limit_available"), "daily_missing_or_invalid_open_limit"), (flag("blocked_limit_up_open"), "daily_open_at_limit_up"),
             (flag("blocked_not_next_session"), "not_next_market_session")]
    minute = [(~F.col("minute_limit_available"), "missing_or_invalid_up_limit"), (F.col("entry_blocked_limit_up"), "limit_up_at_entry"),
              (~F.col("entry_bar_amount_positive"), "nonpositive_entry_amount")]
    d = d.withColumn("status", status)
    done, stopped = F.col("status") == "audited", F.col("status").isin("audited", "minute_entry_blocked")
    why = F.when(F.col("status") == "signal_unfilled", F.when(any_of([c for c, _ in daily]), reasons(daily)).otherwise("other_daily_entry_gate")).when(
        F.col("status") == "minute_entry_blocked", reasons(minute))
    path_cols = ["target_price", "target_touched", "target_crossed", "exit_time", "exit_reference", "exit_reason", "gross_return", "net_return",
                 "opening_capacity_cny", "close_exit_limit_available", "close_exit_at_down_limit"]
    return d.withColumn("reasons", why).withColumns(
        {c: F.when(done, F.col(c)) for c in path_cols} | {"entry_reference": F.when(stopped, F.col("entry_reference"))})


def daily_ohlc_diagnostic(df: DataFrame, terms: Terms) -> DataFrame:
    """The same trade on the daily bar."""
    o, target = F.col("exec_next_open"), F.col("exec_next_open") * (1.0 + terms.take_profit)
    hit = F.col("exec_next_high") > target
    out = F.when(hit, target).otherwise(F.col("exec_next_close"))
    return df.withColumns({"daily_ohlc_target_hit": hit, "daily_ohlc_net_return": net_return(o, out, terms.entry_bps, terms.exit_bps, terms.cost_bps)})


def daily_returns(trades: DataFrame, top_k: int) -> DataFrame:
    """Σ net / K per date over audited names; dates without one stay as cash."""
    ok = F.col("status") == "audited"
    on = lambda c: F.when(ok, F.col(c))
    return trades.groupBy("signal_date", "entry_date").agg(
        F.sum(ok.cast("bigint")).alias("audited"), (F.coalesce(F.sum(on("net_return")), F.lit(0.0)) / top_k).alias("portfolio_return"),
        F.avg(F.when(ok, F.col("target_crossed").cast("double"))).alias("target_cross_rate"),
        (1.0 - F.sum(ok.cast("bigint")) / top_k).alias("cash_weight"),
        (F.coalesce(F.sum(on("net_return") - on("daily_ohlc_net_return")), F.lit(0.0)) / top_k).alias("minute_minus_daily"))


def benchmark_detail(candidates: DataFrame, bars: DataFrame, session: Session, terms: Terms, complete: str = "full_session") -> DataFrame:
    """Same-entry outcome of every executable name with a valid, complete session."""
    ex = candidates.where(flag("execution_eligible"))
    want = ex.select(SYM, F.col("entry_date").alias(DATE)).distinct()
    path = session_summary(bars.join(want, [SYM, DATE], "left_semi"), session, terms).withColumnRenamed(DATE, "entry_date")
    d = ex.join(path.where(F.col("valid") & F.col(complete) & F.col("entry_reference").isNotNull() & F.col("path_close").isNotNull()), [SYM, "entry_date"])
    d = path_outcome(entry_gates(d), terms, "path_close")
    allowed = all_of([F.col("minute_limit_available"), F.col("entry_bar_amount_positive"), ~F.col("entry_blocked_limit_up")])
    d = d.withColumn("entry_allowed", allowed)
    return d.withColumns({c: F.when(F.col("entry_allowed"), F.col(c)) for c in ("gross_return", "net_return")} | {
        "target_crossed": F.col("hit") & F.col("entry_allowed"), "close_exit": F.col("entry_allowed") & ~F.col("hit"),
        "close_exit_limit_available": F.col("close_exit_limit_available") & F.col("entry_allowed"),
        "close_exit_at_down_limit": F.col("close_exit_at_down_limit") & F.col("entry_allowed")})


SUMS = ["slots", "executable", "audited", "gross_return_sum", "net_return_sum", "missing_or_incomplete", "limit_unavailable", "nonpositive_amount",
        "blocked_limit_up", "close_exits", "target_fills"]


def benchmark_daily(candidates: DataFrame, detail: DataFrame) -> DataFrame:
    """Per date, and per date and limit band: counts, sums, cash weight. ``limit_band`` is null on the date rows."""
    keys = ["signal_date", "entry_date"]
    facts = ["entry_allowed", "gross_return", "net_return", "minute_limit_available", "entry_bar_amount_positive", "entry_blocked_limit_up", "close_exit", "hit"]
    d = candidates.select(*keys, SYM, "limit_band", flag("execution_eligible").alias("_ex")).join(
        detail.select(*keys, SYM, F.lit(True).alias("_found"), *facts), [*keys, SYM], "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    found, ok = flag("_found"), flag("entry_allowed")
    aggs = [F.count(F.lit(1)).alias("slots"), n(F.col("_ex")).alias("executable"), n(ok).alias("audited"),
            F.coalesce(F.sum("gross_return"), F.lit(0.0)).alias("gross_return_sum"), F.coalesce(F.sum("net_return"), F.lit(0.0)).alias("net_return_sum"),
            n(F.col("_ex") & ~found).alias("missing_or_incomplete"), n(found & ~F.col("minute_limit_available")).alias("limit_unavailable"),
            n(found & ~F.col("entry_bar_amount_positive")).alias("nonpositive_amount"), n(found & F.col("entry_blocked_limit_up")).alias("blocked_limit_up"),
            n(F.col("close_exit")).alias("close_exits"), n(ok & F.col("hit")).alias("target_fills"), F.grouping("limit_band").alias("_broad")]
    sets = [[F.col(k) for k in keys], [F.col(k) for k in (*keys, "limit_band")]]
    g = d.groupingSets(sets, *keys, "limit_band").agg(*aggs)
    return g.withColumns({
        "limit_band": F.when(F.col("_broad") == 0, F.col("limit_band")), "benchmark_return": F.col("net_return_sum") / F.col("slots"),
        "executed_mean_return": F.coalesce(safe_divide("net_return_sum", "audited"), F.lit(0.0)),
        "cash_weight": 1.0 - F.col("audited") / F.col("slots")}).drop("_broad")


def decomposition_gaps(daily: DataFrame) -> DataFrame:
    """Largest gap per measure between the date rows and the sum of their bands."""
    keys = ["signal_date", "entry_date"]
    broad = daily.where("limit_band is null").select(*keys, *SUMS)
    bands = daily.where("limit_band is not null").groupBy(*keys).agg(*[F.sum(c).alias(f"_b_{c}") for c in SUMS])
    j = broad.join(bands, keys, "full")
    row = j.agg(*[F.max(F.coalesce(F.abs(F.col(c) - F.col(f"_b_{c}")), F.lit(float("inf")))).alias(c) for c in SUMS])
    return row.unpivot([], SUMS, "measure", "gap").withColumn("passed", F.col("gap") <= 1e-10)


def attach_band_matched(daily: DataFrame, trades: DataFrame, bands: DataFrame, top_k: int) -> DataFrame:
    """Selected names' band weights × the band's executed mean; weights must rebuild the invested weight."""
    keys = ["signal_date", "entry_date"]
    sel = trades.where("status = 'audited'").groupBy(*keys, "limit_band").agg(F.count(F.lit(1)).alias("_n"))
    w = bands.where("limit_band is not null").join(sel, [*keys, "limit_band"], "left").withColumn("_w", F.coalesce("_n", F.lit(0)) / top_k)
    m = w.groupBy(*keys).agg(F.sum(F.col("executed_mean_return") * F.col("_w")).alias("band_matched_return"), F.sum("_w").alias("band_matched_weight"))
    out = daily.join(m, keys, "left")
    bad = F.col("band_matched_return").isNull() | (F.abs(F.col("band_matched_weight") - (1.0 - F.col("cash_weight"))) > 1e-12)
    out = fail_where(out, bad, "band_matched_return", "limit-band benchmark does not cover or rebuild the invested weight of every date")
    return out.withColumn("within_band_active", F.col("portfolio_return") - F.col("band_matched_return"))


def limit_band_exposure(trades: DataFrame, bands: DataFrame) -> DataFrame:
    """Band share of audited selections beside the benchmark's."""
    s = trades.where("status = 'audited'").groupBy("limit_band").agg(F.count(F.lit(1)).alias("selected"))
    b = bands.where("limit_band is not null").groupBy("limit_band").agg(F.sum("audited").alias("benchmark"))
    d = b.join(s, "limit_band", "full").fillna(0, ["selected", "benchmark"])
    all_ = Window.partitionBy()  # one row per band
    return d.withColumns({"selected_share": F.try_divide("selected", F.sum("selected").over(all_)),
                          "benchmark_share": F.try_divide("benchmark", F.sum("benchmark").over(all_))})


def cost_stress(trades: DataFrame, bands: DataFrame, top_k: int, bps: list[float]) -> DataFrame:
    """Selected, broad and band-matched benchmark per cost level, from gross sums formed once."""
    keys = ["signal_date", "entry_date"]
    ok = F.col("status") == "audited"
    g = trades.groupBy(*keys).agg(F.sum(ok.cast("bigint")).alias("_n"), F.coalesce(F.sum(F.when(ok, F.col("gross_return"))), F.lit(0.0)).alias("_g"))
    b = bands.where("limit_band is null").select(*keys, "slots", F.col("audited").alias("_ba"), F.col("gross_return_sum").alias("_bg"))
    sel = trades.where(ok).groupBy(*keys, "limit_band").agg(F.count(F.lit(1)).alias("_k"))
    m = (bands.where("limit_band is not null").join(sel, [*keys, "limit_band"]).groupBy(*keys)
         .agg(F.sum(F.col("_k") * F.coalesce(safe_divide("gross_return_sum", "audited"), F.lit(0.0))).alias("_mg"),
              F.sum(F.when(F.col("audited") > 0, F.col("_k")).otherwise(0)).alias("_mk")))
    broad = fail_where(g.join(b, keys, "left"), F.col("slots").isNull(), "slots", "a selection date has no benchmark")
    d = with_scenarios(broad.join(m, keys, "left").fillna(0.0, ["_mg"]).fillna(0, ["_mk"]), ["drag_bps"], [(float(x),) for x in bps])
    drag = F.col("drag_bps") / 10000.0
    d = d.withColumns({"_sel": (F.col("_g") - drag * F.col("_n")) / top_k, "_broad": (F.col("_bg") - drag * F.col("_ba")) / F.col("slots"),
                       "_band": (F.col("_mg") - drag * F.col("_mk")) / top_k})
    d = d.withColumn("_act", F.col("_sel") - F.col("_band"))
    return d.groupBy("drag_bps").agg(
        F.count(F.lit(1)).alias("days"), F.avg("_sel").alias("selected_mean"), sharpe("_sel", 0).alias("selected_sharpe"), compound("_sel").alias("selected_total"),
        F.avg("_broad").alias("benchmark_mean"), F.avg("_band").alias("band_matched_mean"), F.avg("_act").alias("active_mean"), sharpe("_act", 0).alias("active_sharpe"))


def diagnostics(trades: DataFrame) -> DataFrame:
    """Counts and rates of every unfilled, blocked and exit-limit case (one row)."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    ok, assessed = F.col("status") == "audited", F.col("entry_reference").isNotNull()
    close = ok & (F.col("exit_reason") == "close")
    row = trades.agg(
        F.count(F.lit(1)).alias("candidate_rows"), n(~flag("entry_limit_available")).alias("daily_limit_unavailable_rows"),
        n(flag("blocked_limit_up_open")).alias("daily_limit_up_rows"), n(F.col("status") == "signal_unfilled").alias("signal_unfilled_rows"),
        n(assessed).alias("entry_rows"), n(assessed & F.col("minute_limit_available")).alias("entry_limit_available_rows"),
        n(assessed & F.col("entry_blocked_limit_up")).alias("entry_limit_up_rows"), n(F.col("status") == "minute_entry_blocked").alias("entry_blocked_rows"),
        n(ok).alias("audited_rows"), n(close).alias("close_exit_rows"), n(close & F.col("close_exit_at_down_limit")).alias("close_at_down_limit_rows"),
        n(ok & F.col("target_crossed")).alias("target_fill_rows"))
    return row.withColumns({"signal_unfilled_rate": safe_divide("signal_unfilled_rows", "candidate_rows"), "entry_blocked_rate": safe_divide("entry_blocked_rows", "entry_rows"),
                            "target_fill_rate": safe_divide("target_fill_rows", "audited_rows")})


def reason_counts(trades: DataFrame) -> DataFrame:
    return trades.where("reasons is not null").groupBy("status", "reasons").agg(F.count(F.lit(1)).alias("rows"))
