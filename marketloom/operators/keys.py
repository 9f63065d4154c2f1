"""Key handling: duplicates, uniqueness, declared join cardinality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KEYS_HELD = 1_000_000  # keys that one task compares


class DuplicateKeyError(ValueError):
    pass


def keep_one(df: DataFrame, keys: list[str], order: list[str | Column], keep: str = "first") -> DataFrame:
    """One whole row per key: the first (or last) in ``order``.

    An aggregate, not ``row_number``: copies of one key are combined on the map side, so
    a key that holds much of the table never reaches a task as a group of rows.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    by = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_row"))
    return out.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def assert_unique(df: DataFrame, keys: list[str], label: str = "table") -> DataFrame:
    """Return ``df``; raise with five sample keys when a key repeats."""
    sample = duplicate_keys(df, keys).limit(5).collect()
    if sample:
        raise DuplicateKeyError(f"{label}: duplicate keys {[tuple(r) for r in sample]}")
    return df


def count_unique(df: DataFrame, keys: list[str], label: str = "table", at_most: int | None = None) -> int:
    """Rows of ``df``, from one pass that also checks the keys; raises as ``assert_unique`` does when a key repeats.

    Keys that hardly repeat gain nothing from being summed before they are shuffled, and each task would hold as many as its
    file gives it. So rows go by key to as many tasks as they fill with KEYS_HELD each: a task's memory does not grow with the table. ``at_most`` saves the count of a derived table.
    """
    parts = max((df.count() if at_most is None else at_most) // KEYS_HELD + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, most = df.select(*keys).repartition(parts, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k"), F.max("k")).first()
    if (most or 0) > 1:
        assert_unique(df, keys, label)
    return rows or 0


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                 cardinality: str = "one_to_one") -> DataFrame:
    """Equi join that first verifies the declared cardinality (one/many on each side)."""
    one_left, one_right = (side == "one" for side in cardinality.split("_to_"))
    if one_left:
        assert_unique(left, keys, "left side")
    if one_right:
        assert_unique(right, keys, "right side")
    return left.join(right, keys, how)


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the other side's columns but its keys are added."""
    right = other.select(*[F.col(k).alias(f"_r_{k}_") for k in keys], *[c for c in other.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}_")) for k in keys])
    return df.join(right, on, how).drop(*[f"_r_{k}_" for k in keys])
