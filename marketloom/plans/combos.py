"""Search over factor combinations: the daily returns of every combination's top-K book, in one job."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import YEAR, growth, sharpe
from ..operators.calendar import last_session_before, next_session
from ..operators.portfolio import DATE, SYM, dense_index
from ..session import staged

BLOCK = 16_384  # rows of one date scored together; bounds a task's matrices
NAME = "variant"


def combination_names(factors: list[str], sizes: tuple[int, ...]) -> list[tuple[str, ...]]:
    """Every combination of the given sizes; names in alphabetical order."""
    return [c for n in sizes for c in combinations(sorted(factors), n)]


def block_best(panel: DataFrame, signs: dict[str, float], combos: list[tuple[str, ...]], k: int) -> DataFrame:
    """(trade_date, symbol, score, combo): the best ``k`` of each block of a date, for every combination; ``combo`` is its number.

    A block's factors are a matrix; sums are formed left to right, a shared prefix once, so that a score has the same digits
    whatever the block. A missing factor is zero; ties go to the smaller symbol. A date of any size is split into blocks, and only
    blocks' winners leave a task.
    """
    names, kind = sorted({f for c in combos for f in c}), panel.schema[SYM].dataType
    sizes = panel.groupBy(DATE).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    rows = panel.select(DATE, SYM, *[(F.lit(signs[f]) * F.coalesce(F.col(f), F.lit(0.0))).alias(f) for f in names]).join(sizes, DATE)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(SYM), F.col("_blocks"))).drop("_blocks")

    def best(block: pa.Table) -> pa.Table:
        block = block.sort_by(SYM)
        x = {f: block[f].to_numpy() for f in names}
        prefix: dict[tuple[str, ...], np.ndarray] = {(f,): x[f] for f in names}
        taken, scores = [], []
        for c in combos:
            for n in range(2, len(c) + 1):
                if c[:n] not in prefix:
                    prefix[c[:n]] = prefix[c[: n - 1]] + x[c[n - 1]]
            s = prefix[c] if len(c) < 3 else prefix.pop(c)
            at = np.arange(len(s))
            if len(s) > k:
                cut = np.partition(s, len(s) - k)[len(s) - k]
                above, tied = np.flatnonzero(s > cut), np.flatnonzero(s == cut)
                at = np.concatenate([above, tied[: k - len(above)]])  # rows are in order of symbols
            taken.append(at)
            scores.append(s[at])
        at = np.concatenate(taken)
        combo = np.repeat(np.arange(len(combos), dtype=np.int32), [len(t) for t in taken])
        picked = block.select([DATE, SYM]).take(pa.array(at))
        return pa.table({DATE: picked[DATE], SYM: picked[SYM], "score": pa.array(np.concatenate(scores)), "combo": pa.array(combo)})

    return rows.groupBy(DATE, "_block").applyInArrow(best, f"{DATE} date, {SYM} {kind.simpleString()}, score double, combo int")


def combination_holdings(panel: DataFrame, signs: dict[str, float], combos: list[tuple[str, ...]], k: int) -> DataFrame:
    """(trade_date, symbol, combos): the numbers of the combinations whose top ``k`` of a date hold a symbol."""
    w = Window.partitionBy(DATE, "combo").orderBy(F.desc("score"), SYM)
    top = block_best(panel, signs, combos, k).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return top.groupBy(DATE, SYM).agg(F.sort_array(F.collect_list("combo")).alias("combos"))  # at most one entry a combination


def combination_daily(panel: DataFrame, returns: DataFrame, calendar: DataFrame, signs: dict[str, float], combos: list[tuple[str, ...]], k: int, cost_bps: float) -> DataFrame:
    """(combo, trade_date, ret): daily returns of every combination's equal-weight top-``k`` book.

    A book formed on a panel date is bought at the next session, which earns nothing and pays the cost of the names bought and
    sold, and earns the mean of its names' returns from the session after it to the next panel date (the last one: to the
    end of the calendar). A missing return is left out of the mean; a day without any has no row, and a book that
    never has one pays no cost. Formations after the last session are not bought. ``panel``: trade_date, symbol (unique) and the factors;
    ``returns``: trade_date, symbol, ret. Tables of no rows give none.
    """
    held = combination_holdings(panel, signs, combos, k)
    held = staged(held.join(dense_index(panel.select(DATE).distinct()), DATE))
    w = Window.partitionBy(SYM).orderBy("idx")  # a symbol's formations
    before = F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag("combos").over(w))
    pairs = held.withColumn("_both", F.array_intersect("combos", F.coalesce(before, F.array().cast("array<int>"))))
    names = held.select("idx", F.explode("combos").alias("combo")).groupBy("idx", "combo").agg(F.count(F.lit(1)).alias("names"))
    both = pairs.select("idx", F.explode("_both").alias("combo")).groupBy("idx", "combo").agg(F.count(F.lit(1)).alias("both"))
    by_combo = Window.partitionBy("combo").orderBy("idx")
    moves = (names.join(both, ["idx", "combo"], "left").withColumn("_was", F.coalesce(F.lag("names").over(by_combo), F.lit(0)))
             .select("idx", "combo", ((F.col("names") + F.col("_was") - 2 * F.coalesce("both", F.lit(0))) / k).alias("turnover")))
    cal = calendar.select(DATE).distinct()
    formed = held.select(DATE, "idx").distinct()
    entries = staged(next_session(formed, cal, DATE, "entry_date").where("entry_date is not null"))
    days = last_session_before(cal, entries.select(DATE), "_formed").where("_formed is not null")
    days = days.join(entries.select(F.col(DATE).alias("_formed"), "idx", "entry_date"), "_formed").where(F.col(DATE) > F.col("entry_date")).select(DATE, "idx")
    paid_for = returns.where("ret is not null").select(DATE, SYM, "ret").join(days, DATE).join(held.select("idx", SYM, "combos"), ["idx", SYM])
    # The rows of a day are added up on the map side, so a day and a combination are one row a task.
    earned = staged(paid_for.select("idx", DATE, "ret", F.explode("combos").alias("combo")).groupBy("combo", "idx", DATE).agg(F.avg("ret").alias("ret")))
    alive = earned.select("combo", "idx").distinct()
    cost = (moves.join(alive, ["combo", "idx"], "left_semi").join(entries.select("idx", F.col("entry_date").alias(DATE)), "idx")
            .select("combo", DATE, (-F.col("turnover") * cost_bps / 10000.0).alias("ret")))
    return earned.select("combo", DATE, "ret").unionByName(cost)


def combination_search(daily: DataFrame, combos: list[tuple[str, ...]], odds_months: int = 36) -> DataFrame:
    """(variant, n_factors, days, log_ann, ann, sharpe, odds): statistics of every combination's daily returns.

    ``log_ann`` is the logarithm of the annual growth, from the sum of logarithms: the growth itself leaves the range of doubles. It is null
    once capital is lost.
    ``odds`` compares the rolling windows of ``odds_months`` calendar months that did not lose with those that lost; a month without a
    day counts as no change, and the odds are null where none lost.
    """
    n = F.count(F.lit(1))
    log_ann = F.when(F.min("ret") > -1.0, F.sum(F.when(F.col("ret") > -1.0, F.log(1.0 + F.col("ret")))) * float(YEAR) / n)
    total = daily.groupBy("combo").agg(n.alias("days"), log_ann.alias("log_ann"), F.expm1(log_ann).alias("ann"), sharpe("ret").alias("sharpe"))
    months = daily.groupBy("combo", F.trunc(DATE, "MM").alias("month")).agg((growth("ret")).alias("g"))
    whole = months.groupBy("combo").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = whole.select("combo", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).join(months, ["combo", "month"], "left")
    w = Window.partitionBy("combo").orderBy("month").rowsBetween(1 - odds_months, 0)
    grid = grid.select("combo", (F.product(F.coalesce("g", F.lit(1.0))).over(w) - 1.0).alias("r"), F.count(F.lit(1)).over(w).alias("c")).where(F.col("c") == odds_months)
    lost = F.sum((F.col("r") < 0).cast("long"))
    odds = grid.groupBy("combo").agg(F.try_divide(n - lost, lost).alias("odds"))
    labels = F.array(*[F.lit("+".join(c)) for c in combos])
    sizes = F.array(*[F.lit(len(c)) for c in combos])
    out = total.join(odds, "combo", "left")
    return out.select(F.element_at(labels, F.col("combo") + 1).alias(NAME), F.element_at(sizes, F.col("combo") + 1).alias("n_factors"), "days", "log_ann", "ann", "sharpe", "odds")
