"""Exact ranks and quantiles inside groups of any size, for several measures at once.

A date's cross-section can hold more names than one task should sort, and one value (a zero volume) a third of them.
Groups of more than BIN rows get a cut point of each measure for every BIN rows. Cut points turn a value into a bin
by an expression: between two cuts, or equal to one. Bins of large groups are counted in a small table; the rows below a bin
plus the rank inside it are the rank. So one exchange of the rows ranks a measure, whatever the groups' sizes, and
no window holds much more than BIN rows: rows equal to a cut tie, need no window, and are spread. Groups of up to BIN rows have no
cuts and one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..session import staged
from .keys import join_null_safe

BIN = 1_000_000  # rows between two cut points, about
GRID = 256  # bins of a group at most are twice as many
SPREAD = 64  # parts of rows that need no window
SKETCHED = 20_000  # rows of a group on average, from which quantiles go by brackets
BRACKETED = 1_000  # groups at most whose brackets are broadcast
WIDTH = 0.002  # half a bracket, as a share of the group; the sketch is twenty times as fine


def sort_key(df: DataFrame, value: str) -> tuple[Column, bool]:
    """(number in the order of the value, equal only for equal values). Strings go by their first seven bytes."""
    if isinstance(df.schema[value].dataType, StringType | BinaryType):
        return F.conv(F.rpad(F.hex(F.substring(F.col(value).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"), False
    return F.col(value), True


def large_groups(df: DataFrame, by: list[str], values: list[str]) -> DataFrame | None:
    """Groups in which any measure has more than BIN rows, with their non-null rows ``_n{i}``; None if there is none.

    There is at most one for every BIN rows of the table, so they are broadcast: a million for 100 TB.
    """
    sizes = df.groupBy(*by).agg(*[F.count(v).alias(f"_n{i}") for i, v in enumerate(values)])
    large = sizes.where(" or ".join(f"_n{i} > {BIN}" for i in range(len(values))))
    return None if large.isEmpty() else F.broadcast(large)


def cut_points(df: DataFrame, by: list[str], values: list[str], large: DataFrame) -> DataFrame:
    """One row per large group: ``_n{i}`` and the ascending cut points ``_c{i}`` of each measure."""
    grid = [j / GRID for j in range(1, GRID)]
    q = [F.percentile_approx(sort_key(df, v)[0], grid, 10 * GRID).alias(f"_q{i}") for i, v in enumerate(values)]
    g = join_null_safe(df.select(*by, *values), large, by).groupBy(*by).agg(*[F.max(f"_n{i}").alias(f"_n{i}") for i in range(len(values))], *q)

    def chosen(i: int) -> Column:
        step = F.greatest(F.lit(1), F.floor(F.lit(GRID * BIN) / F.col(f"_n{i}")))
        return F.array_distinct(F.filter(f"_q{i}", lambda x, j: (j + 1) % step == 0)).alias(f"_c{i}")

    return g.select(*by, *[f"_n{i}" for i in range(len(values))], *[chosen(i) for i in range(len(values))])


def bin_of(df: DataFrame, value: str, i: int) -> Column:
    """Even numbers lie between cuts, odd ones are equal to a cut; null for null values."""
    k, exact = sort_key(df, value)
    low = F.size(F.filter(f"_c{i}", lambda c: c < k)) * 2
    some = low + F.array_contains(f"_c{i}", k).cast("int") if exact else low
    return F.when(F.col(value).isNotNull(), F.when(F.col(f"_c{i}").isNotNull(), some).otherwise(0))


def binned(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``df`` with, for each measure i: ``_n{i}``, ``_bin{i}``, ``_below{i}`` rows in lower bins, and ``_rows{i}`` in its own.

    All but the bin are null in groups without cut points.
    """
    large = large_groups(df, by, values)
    if large is None:  # the joins below would add these columns
        nothing = {f"{t}{i}": F.lit(None).cast("long") for t in ("_n", "_below", "_rows") for i in range(len(values))}
        return df.withColumns(nothing | {f"_bin{i}": F.when(F.col(v).isNotNull(), 0) for i, v in enumerate(values)})
    cuts = cut_points(df, by, values, large)
    entries = F.array(*[F.struct(F.lit(i).alias("m"), bin_of(df, v, i).alias("b")) for i, v in enumerate(values)])
    seen = join_null_safe(df.select(*by, *values), F.broadcast(cuts), by).select(*by, F.explode(entries).alias("e")).where("e.b is not null")
    counts = seen.groupBy(*by, F.col("e.m").alias("m"), F.col("e.b").alias("b")).agg(F.count(F.lit(1)).alias("k"))  # summed on the map side
    lists = counts.groupBy(*by).agg(*[F.collect_list(F.when(F.col("m") == i, F.struct("b", "k"))).alias(f"_l{i}") for i in range(len(values))])

    def by_bin(i: int, wanted) -> Column:
        """Rows in the bins that ``wanted(bin, place)`` takes, for every place."""
        places = F.sequence(F.lit(0), F.array_max(F.transform(f"_l{i}", lambda e: e["b"])))
        return F.transform(places, lambda p: F.aggregate(F.filter(f"_l{i}", lambda e: wanted(e["b"], p)), F.lit(0).cast("long"), lambda a, e: a + e["k"]))

    tables = {f"_below{i}": by_bin(i, lambda b, p: b < p) for i in range(len(values))}
    tables |= {f"_rows{i}": by_bin(i, lambda b, p: b == p) for i in range(len(values))}
    bins = join_null_safe(cuts, lists.select(*by, *[c.alias(n) for n, c in tables.items()]), by)
    d = join_null_safe(df, F.broadcast(bins), by, "left")
    d = d.withColumns({f"_bin{i}": bin_of(df, v, i) for i, v in enumerate(values)})
    return d.withColumns({f"{t}{i}": F.get(f"{t}{i}", f"_bin{i}") for t in ("_below", "_rows") for i in range(len(values))}).drop(*[f"_c{i}" for i in range(len(values))])


def ranked_many(df: DataFrame, by: list[str], measures: dict[str, str]) -> DataFrame:
    """Add, for each measure with prefix p, ``{p}avg`` (average-tie rank), ``{p}min`` and ``{p}n``; null values stay null."""
    d, ranks, helpers = binned(df, by, list(measures)), {}, []
    for i, (value, prefix) in enumerate(measures.items()):
        tied = F.col(f"_bin{i}") % 2 == 1
        # Rows that tie at a cut, and rows without a value, need no window: they are dealt anywhere.
        spread = F.when(tied | F.col(value).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD))).otherwise(0)
        d = d.withColumn(f"_spread{i}", spread)
        w = Window.partitionBy(*by, f"_bin{i}", f"_spread{i}").orderBy(value)
        inside = F.when(tied, 1).otherwise(F.rank().over(w))
        upto = F.when(tied, F.col(f"_rows{i}")).otherwise(F.count(F.lit(1)).over(w))  # rows up to the value, its ties included
        below = F.coalesce(F.col(f"_below{i}"), F.lit(0))
        size = F.coalesce(F.col(f"_n{i}"), F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        d = d.withColumns({f"_first{i}": inside + below, f"_last{i}": upto + below, f"_n{i}": size})
        known = lambda c, v=value: F.when(F.col(v).isNotNull(), c)
        ranks |= {f"{prefix}avg": known((F.col(f"_first{i}") + F.col(f"_last{i}")) / 2.0), f"{prefix}min": known(F.col(f"_first{i}").cast("long")), f"{prefix}n": known(F.col(f"_n{i}"))}
        helpers += [f"{h}{i}" for h in ("_n", "_bin", "_below", "_rows", "_spread", "_first", "_last")]
    return d.withColumns(ranks).drop(*helpers)


def ranked(df: DataFrame, by: list[str], value: str, prefix: str = "rk_") -> DataFrame:
    """``ranked_many`` for one measure."""
    return ranked_many(df, by, {value: prefix})


def bracketed_quantiles(df: DataFrame, by: list[str], wanted: dict[str, dict[str, float]], n: str | None) -> DataFrame:
    """Exact quantiles of few large groups: only values near a wanted place leave the map side, equal ones as one row.

    A sketch gives a bracket for every place and a count tells how many rows lie below it and inside. Where the place should
    not be inside, all the group's values are taken.
    """
    values = list(wanted)
    places = [(i, name, float(p)) for i, v in enumerate(values) for name, p in wanted[v].items()]
    x = df.select(*by, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    counted = [F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(values))]
    ends = [[e for j, (m, _, p) in enumerate(places) if m == i for e in (max(p - WIDTH, 0.0), min(p + WIDTH, 1.0))] for i in range(len(values))]
    near = [F.percentile_approx(f"_v{i}", e, 10_000).alias(f"_q{i}") for i, e in enumerate(ends)]  # one sketch a measure
    at_end = {j: 2 * sum(m == i for m, _, _ in places[:j]) for j, (i, _, _) in enumerate(places)}
    sketch = staged(x.groupBy(*by).agg(*counted, *near))
    low, high, inside, below = [], [], [], []
    for j, (i, _, _) in enumerate(places):
        low.append(F.get(f"_q{i}", F.lit(at_end[j])))
        high.append(F.get(f"_q{i}", F.lit(at_end[j] + 1)))
        below.append(F.count(F.when(F.col(f"_v{i}") < low[j], 1)).alias(f"_b{j}"))
        inside.append(F.count(F.when(F.col(f"_v{i}").between(low[j], high[j]), 1)).alias(f"_k{j}"))
    counts = join_null_safe(x, F.broadcast(sketch), by).groupBy(*by).agg(*below, *inside)
    c = join_null_safe(sketch, counts, by)
    at = [(F.col(f"_n{i}") - 1) * F.lit(p) for i, _, p in places]
    good = [(F.col(f"_b{j}") <= F.floor(a)) & (F.ceil(a) < F.col(f"_b{j}") + F.col(f"_k{j}")) for j, a in enumerate(at)]
    bounds = staged(c.select(*by, *[f"_n{i}" for i in range(len(values))], *[a.alias(f"_at{j}") for j, a in enumerate(at)],
                             *[e.alias(f"{t}{j}") for j, ok in enumerate(good) for t, e in
                               (("_lo", F.when(ok, low[j])), ("_hi", F.when(ok, high[j])), ("_b", F.when(ok, F.col(f"_b{j}")).otherwise(0)))]))
    held = [F.col(f"_v{i}").isNotNull() & (F.col(f"_lo{j}").isNull() | F.col(f"_v{i}").between(F.col(f"_lo{j}"), F.col(f"_hi{j}"))) for j, (i, _, _) in enumerate(places)]
    some = held[0]
    for h in held[1:]:
        some = some | h
    entries = [F.when(held[j], F.struct(F.lit(j).alias("j"), F.col(f"_v{i}").alias("v"), (F.floor(f"_at{j}") - F.col(f"_b{j}")).alias("f"), (F.ceil(f"_at{j}") - F.col(f"_b{j}")).alias("c")))
               for j, (i, _, _) in enumerate(places)]
    rows = join_null_safe(x, F.broadcast(bounds), by).where(some).select(*by, F.explode(F.array(*entries)).alias("e")).where("e is not null").select(*by, "e.*")
    rows = rows.groupBy(*by, "j", "v", "f", "c").agg(F.count(F.lit(1)).alias("k"))
    last = F.sum("k").over(Window.partitionBy(*by, "j").orderBy("v"))
    rows = rows.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("k"))
    pick = lambda j, to: F.max(F.when((F.col("j") == j) & (F.col("_first") <= F.col(to)) & (F.col(to) < F.col("_last")), F.col("v")))
    g = rows.groupBy(*by).agg(*[pick(j, to).alias(f"_{to}{j}") for j in range(len(places)) for to in ("f", "c")])
    g = join_null_safe(g, bounds, by)
    outs = [(F.col(f"_f{j}") + (F.col(f"_c{j}") - F.col(f"_f{j}")) * (F.col(f"_at{j}") - F.floor(f"_at{j}"))).alias(name) for j, (_, name, _) in enumerate(places)]
    return F.broadcast(g.select(*by, *outs, *([F.when(F.col("_n0") > 0, F.col("_n0")).alias(n)] if n else [])))


def quantiles_many(df: DataFrame, by: list[str], wanted: dict[str, dict[str, float]], n: str | None = "n") -> DataFrame:
    """Linear-interpolation quantiles per group, one column per named probability of each measure; ``n`` counts the first one.

    Few large groups go by brackets around the wanted places. Otherwise, of large groups only the bins that hold a wanted place are ordered.
    """
    groups, rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    if 0 < groups <= BRACKETED and rows >= SKETCHED * groups:
        return bracketed_quantiles(df, by, wanted, n)
    values = list(wanted)
    d = binned(df.select(*by, *values), by, values)
    # One row a measure; each is ordered inside its bin.
    fields = [F.struct(F.lit(i).alias("m"), F.col(v).cast("double").alias("v"), F.col(f"_bin{i}").alias("b"), F.col(f"_below{i}").alias("below"), F.col(f"_rows{i}").alias("rows"), F.col(f"_n{i}").alias("n")) for i, v in enumerate(values)]
    d = d.select(*by, F.explode(F.array(*fields)).alias("e")).select(*by, "e.*").where("v is not null").withColumn("below", F.coalesce("below", F.lit(0)))
    places = [(i, name, (F.col("n") - 1) * F.lit(float(p))) for i, v in enumerate(values) for name, p in wanted[v].items()]
    upto = F.col("below") + F.coalesce(F.col("rows"), F.col("n"))
    holds = lambda low, high, at: (low <= at) & (at < high)
    needed = F.col("n").isNull()
    for i, _, at in places:
        needed = needed | ((F.col("m") == i) & (holds(F.col("below"), upto, F.floor(at)) | holds(F.col("below"), upto, F.ceil(at))))
    tied = F.col("b") % 2 == 1
    d = d.where(needed).withColumn("s", F.when(tied, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(0))
    w = Window.partitionBy(*by, "m", "b", "s").orderBy("v")
    d = d.withColumns({"n": F.coalesce("n", F.count("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), "_at": F.row_number().over(w) - 1})  # one order, so one sort
    low = F.col("below") + F.when(tied, 0).otherwise(F.col("_at"))
    d = d.withColumn("_low", low).withColumn("_high", F.when(tied, upto).otherwise(F.col("_low") + 1))
    aggs, outs = [], []
    for i, name, at in places:
        pick = lambda to, i=i: F.max(F.when((F.col("m") == i) & holds(F.col("_low"), F.col("_high"), to), F.col("v")))
        aggs += [pick(F.floor(at)).alias(f"_lo_{name}"), pick(F.ceil(at)).alias(f"_hi_{name}"), F.max(F.when(F.col("m") == i, at)).alias(f"_at_{name}")]
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((a + (b - a) * (F.col(f"_at_{name}") - F.floor(f"_at_{name}"))).alias(name))
    g = d.groupBy(*by).agg(F.max(F.when(F.col("m") == 0, F.col("n"))).alias("_n"), *aggs)
    return g.select(*by, *outs, *([F.col("_n").alias(n)] if n else []))


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``quantiles_many`` for one measure, plus ``n``."""
    return quantiles_many(df, by, {value: probs})


def with_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], n: str | None = None) -> DataFrame:
    """The group's quantiles (and optionally its non-null count) on every row."""
    return join_null_safe(df, quantiles_many(df, by, {value: probs}, n), by, "left")
