"""Concept text: parsing, keyword exposure, containment joins and set stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calendar import sessions

DATE, SYM = "trade_date", "symbol"


def explode_concepts(df: DataFrame, text: str = "concepts", out: str = "concept") -> DataFrame:
    """One row per distinct concept of a bracketed, comma-separated list."""
    parts = F.split(F.regexp_replace(text, "[\\[\\]'\"]", ""), ",")
    clean = F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))
    return df.withColumn(out, F.explode(clean)).drop(text)


def keyword_scores(df: DataFrame, keywords: dict[str, dict[str, float]], keys: list[str], concept: str = "concept") -> DataFrame:
    """Dimension scores: keyword weights of every concept that contains, or is contained in, a keyword.

    The keyword list is a fixed constant and travels in the expression; no join is needed.
    """
    entries = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(dim).alias("dimension"), F.lit(float(w)).alias("weight"))
                        for k, dims in keywords.items() for dim, w in dims.items()])
    low = F.lower(F.col(concept))
    hits = F.filter(entries, lambda e: F.contains(low, e["k"]) | F.contains(e["k"], low))
    return (df.withColumn("_e", F.explode(hits)).groupBy(*keys, F.col("_e.dimension").alias("dimension"))
            .agg(F.sum("_e.weight").alias("score")))


def entity_scores(scores: DataFrame, exposures: DataFrame, keys: list[str]) -> DataFrame:
    """Entity score = Σ dimension score × exposure."""
    return (scores.join(exposures, "dimension").groupBy(*keys, "entity")
            .agg(F.sum(F.col("score") * F.col("exposure")).alias("score")))


def contained_pairs(short: DataFrame, long: DataFrame, s: str, text: str) -> DataFrame:
    """(short, text) pairs where the short string occurs in the text: substrings of the lengths in use, then an equi join.

    Both sides are distinct names, so the work follows the vocabulary and not its users.
    """
    names = short.select(F.lower(s).alias("_k"), F.col(s)).distinct()
    lengths = names.agg(F.sort_array(F.collect_set(F.length("_k")))).scalar()  # at most one entry per text length
    texts = long.select(F.lower(text).alias("_t"), F.col(text)).distinct().withColumn("_lens", lengths)
    size = F.explode(F.filter("_lens", lambda n: n <= F.length("_t")))
    parts = texts.select(text, "_t", size.alias("_n")).select(
        text, F.explode(F.transform(F.expr("sequence(1, length(_t) - _n + 1)"),
                                    lambda i: F.substr(F.col("_t"), i, F.col("_n")))).alias("_k")).distinct()
    return names.join(parts, "_k").select(s, text)


def concept_members(concepts: DataFrame, members: DataFrame, name: str = "name", description: str = "description") -> DataFrame:
    """Members of a concept: names containing it or contained in it; only if none, descriptions containing it."""
    c = concepts.select("concept").distinct()
    names = members.select(name).distinct()
    either = contained_pairs(c, names, "concept", name).unionByName(
        contained_pairs(names, c, name, "concept").select("concept", name)).distinct()
    direct = members.join(either, name).select("concept", "member")
    rest = c.join(direct.select("concept").distinct(), "concept", "left_anti")
    by_text = contained_pairs(rest, members.select(description).distinct(), "concept", description)
    return direct.unionByName(members.join(by_text, description).select("concept", "member")).distinct()


def daily_stats(hot: DataFrame, top_n: int) -> DataFrame:
    """Per concept and date over the top rows: best rank, total score, stock count."""
    w = Window.partitionBy(DATE).orderBy(F.col("hot").desc(), F.col(SYM), F.col("concepts"))
    top = hot.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return (explode_concepts(top).groupBy(DATE, "concept")
            .agg(F.min("rank").alias("min_rank"), F.sum("hot").alias("total_hot"), F.count(F.lit(1)).alias("stock_count")))


def appearances(stats: DataFrame, lookback: int) -> DataFrame:
    """Number of appearances in the previous ``lookback`` sessions, plus today, capped at the lookback."""
    d = stats.join(sessions(stats).select(DATE, "session"), DATE)
    w = Window.partitionBy("concept").orderBy("session").rangeBetween(-lookback, -1)
    return d.withColumn("streak", F.least(F.count(F.lit(1)).over(w) + 1, F.lit(lookback)))


def jaccard_by_day(members: DataFrame) -> DataFrame:
    """Jaccard of a concept's member sets on consecutive sessions, from counts of one lagged pass."""
    d = members.select(DATE, "concept", SYM).distinct().join(sessions(members).select(DATE, "session"), DATE)
    w = Window.partitionBy("concept", SYM).orderBy("session")
    d = d.withColumn("_both", F.coalesce(F.lag("session").over(w) == F.col("session") - 1, F.lit(False)).cast("bigint"))
    day = d.groupBy("concept", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("_both").alias("both"))
    prev = Window.partitionBy("concept").orderBy("session")
    day = day.withColumn("_p", F.when(F.lag("session").over(prev) == F.col("session") - 1, F.lag("n").over(prev)))
    return day.where("_p is not null").select(
        "concept", "session", (F.col("both") / (F.col("n") + F.col("_p") - F.col("both"))).alias("jaccard"))
