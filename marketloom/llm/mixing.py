"""Mixing sources to target weights over a tree of domain, language and source.

A token budget flows down the tree. At each node it is shared by the children's weights; a child that cannot use its
share, all its epochs being spent, gets what it has, and its siblings share the rest. A node can take what its
leaves can, so a shortage is made up by siblings first and passes to the ancestors' siblings only when all of them are full. Each
leaf then takes whole epochs and a prefix of one more, in an order seeded by epoch. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parallelism, staged
from .quality import SPACE

TREE = ["domain", "lang", "source"]


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")).cast("long")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: the share of ``budget`` of each node among those with one parent, from ``weight`` and ``room``.

    In the order of room / weight, a node is full while its room is within its share of what the nodes before it
    leave; the others share the rest by weight, rounded down.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("room") / F.col("weight"), F.col(name).asc_nulls_first())
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("full", F.col("room") * left <= (F.col("budget") - before) * F.col("weight"))
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(by), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    part = (F.col("budget") - spent) * F.col("weight")
    rest = ((part - part % open_weight) / open_weight).cast("long")
    return nodes.withColumn("given", F.when(F.col("full"), F.col("room")).otherwise(rest)).drop("full")


def weight_of(column: str, weights: dict[str, int]) -> Column:
    """Relative weight by name; names without one, null too, have 1."""
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(F.col(column) == k, w).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """Adds ``given`` tokens to each leaf (domain, lang, source, tokens): one row per leaf, whatever the number of documents.

    The budget is ``percent`` of all tokens; a leaf has room for ``max_epochs`` times its own.
    """
    nodes = leaves.withColumn("room", F.col("tokens") * max_epochs)
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    nodes = nodes.withColumn("budget", ((whole * percent - (whole * percent) % 100) / 100).cast("long"))
    for depth, name in enumerate(TREE):
        parent, keys = TREE[:depth], TREE[: depth + 1]
        inner = nodes.groupBy(*keys).agg(F.sum("room").alias("room"), F.max("budget").alias("budget")).where("room > 0")
        inner = share(inner.withColumn("weight", weight_of(name, weights.get(name, {}))), parent, name)
        given = inner.select(*[F.col(k).alias(f"_{k}") for k in keys], "given")
        match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        cond = match[0]
        for m in match[1:]:
            cond = cond & m
        nodes = nodes.drop("budget").join(given, cond).drop(*[f"_{k}" for k in keys]).withColumnRenamed("given", "budget")
    return nodes.withColumnRenamed("budget", "given").select(*TREE, "tokens", "given")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits of the MD5 of seed:epoch:doc_id."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def select(rows: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int) -> DataFrame:
    """Choose from stored ``rows`` with doc_id, n_tokens and the tree's columns; adds epoch, one row per epoch that takes the document.

    A leaf's prefix ends with the last document that fits its tokens. Its end is found by the sums of buckets of the order
    key; only the bucket in which it lies is ordered, so a leaf that holds most documents is not gathered. Rows that share
    an id follow each other and are taken together.
    """
    leaves = rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(staged(leaves), weights, percent, max_epochs)
    plan = plan.withColumn("rest", F.col("given") % F.col("tokens")).withColumn("whole", ((F.col("given") - F.col("rest")) / F.col("tokens")).cast("int"))
    plan = staged(plan)
    leaf = plan.select(*[F.col(k).alias(f"_{k}") for k in TREE], "rest", "whole")
    same = lambda right: F.col("domain").eqNullSafe(right["_domain"]) & F.col("lang").eqNullSafe(right["_lang"]) & F.col("source").eqNullSafe(right["_source"])
    keyed = rows.join(leaf, same(leaf)).drop("_domain", "_lang", "_source").withColumn("_key", order_key(seed, F.col("whole") + 1, F.col("doc_id")))
    bits = max(4, (4 * parallelism(rows.sparkSession)).bit_length())
    keyed = keyed.withColumn("_bucket", F.shiftright("_key", 60 - bits))
    narrow = keyed.select(*TREE, "doc_id", "n_tokens", "rest", "_key", "_bucket")
    sums = narrow.groupBy(*TREE, "_bucket").agg(F.sum("n_tokens").alias("sum"), F.max("rest").alias("rest"))
    upto = F.sum("sum").over(Window.partitionBy(*TREE).orderBy("_bucket"))
    cross = sums.withColumn("upto", upto).where("upto > rest and upto - sum <= rest")
    cross = cross.select(*[F.col(k).alias(f"_{k}") for k in TREE], F.col("_bucket").alias("_cross"), (F.col("rest") - F.col("upto") + F.col("sum")).alias("_left"))
    cross = staged(cross)
    inside = narrow.join(cross, same(cross) & (narrow._bucket == cross._cross)).select(*TREE, "doc_id", "n_tokens", "_key", "_left")
    run = F.sum("n_tokens").over(Window.partitionBy(*TREE).orderBy("_key", "doc_id"))  # rows with equal keys count together
    last = inside.withColumn("run", run).where("run <= _left").groupBy(*TREE).agg(F.max(F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("_last"))
    last = last.select(*[F.col(k).alias(f"_{k}") for k in TREE], "_last")
    pair = cross._domain.eqNullSafe(last._domain) & cross._lang.eqNullSafe(last._lang) & cross._source.eqNullSafe(last._source)
    ends = staged(cross.join(last, pair, "left").select(cross._domain, cross._lang, cross._source, "_cross", "_last"))
    here = F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    prefix = (F.col("rest") > 0) & ((F.col("_bucket") < F.col("_cross")) | (F.col("_bucket") == F.col("_cross")) & F.coalesce(here <= F.col("_last"), F.lit(False)))
    out = keyed.join(ends, same(ends), "left").withColumn("_times", F.col("whole") + F.coalesce(prefix, F.lit(False)).cast("int")).where("_times > 0")
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*rows.columns, "epoch")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int = 42) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens (words), epoch of every chosen document.

    Documents without words have no tokens to choose by and are left out. Null names are leaves of their own. An empty table
    gives none.
    """
    rows = docs.select("doc_id", domain.alias("domain"), "lang", "source", word_count(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    return select(staged(rows), weights, percent, max_epochs, seed)


def keep_mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int, seed: int = 42) -> DataFrame:
    """The documents chosen in one epoch, with their own columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, "doc_id", domain.alias("domain"), "lang", "source", word_count(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    return select(staged(rows), weights, percent, 1, seed).select("_doc.*")
