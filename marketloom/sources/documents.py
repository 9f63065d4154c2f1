"""JSON manifests, selection lists and file receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import compact_date, flag, market_suffix
from .tables import required

MANIFEST = ("status string, quality_status string, "
            "daily array<struct<date:string, canonical_source:string, valid:boolean>>")


def coverage_manifest(spark: SparkSession, path: str, sources: tuple[str, ...]) -> DataFrame:
    """(trade_date, minute_source) of valid records of supported sources; a failed or empty manifest raises."""
    doc = spark.read.json(path, schema=MANIFEST)
    bad = doc.where("coalesce(status, '') <> 'passed' or coalesce(quality_status, '') <> 'passed'")
    days = (doc.select(F.explode("daily").alias("r")).where(F.col("r.valid") & F.col("r.canonical_source").isin(*sources))
            .select(compact_date("r.date").alias("trade_date"), F.col("r.canonical_source").alias("minute_source")))
    if bad.limit(1).count() or not days.limit(1).count():
        raise ValueError("minute coverage manifest is not passed or holds no supported day")
    return days


def selections(df: DataFrame, top_k: int, markets: list[str], start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Selections of one top_k inside market and window, and one audit row of what was dropped."""
    required(df, ["signal_date", "ts_code", "top_k"], "selections")
    d = df.where(F.col("top_k") == top_k).where(market_suffix("ts_code").isin(*markets))
    day = F.col("signal_date")
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    kept = d.where(day.between(lo, hi)).withColumn("execution_eligible", flag("execution_eligible", True))
    count = lambda c: F.sum(c.cast("bigint"))
    audit = d.agg(F.count(F.lit(1)).alias("rows"), count(day.isNull()).alias("null_rows"),
                  count(F.coalesce(day < lo, F.lit(False))).alias("before_rows"),
                  count(F.coalesce(day > hi, F.lit(False))).alias("after_rows"))
    per_day = kept.groupBy("signal_date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ts_code").alias("u"))
    if per_day.where(f"n > {top_k} or n > u").limit(1).count():
        raise ValueError("selections repeat a key or exceed top_k on a date")
    return kept, audit


def file_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file under a folder (files small enough to be one row each)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), F.col("length").alias("size"),
                        F.sha2("content", 256).alias("sha256"))


def receipt_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Files added, removed or changed between two inventories."""
    e = expected.select("file", F.col("sha256").alias("expected"))
    o = observed.select("file", F.col("sha256").alias("observed"))
    return e.join(o, "file", "full").where("not (expected <=> observed)").withColumn(
        "difference", F.when(F.col("expected").isNull(), "added").when(F.col("observed").isNull(), "removed")
        .otherwise("changed"))


def complete_source(receipt: DataFrame, observed: DataFrame) -> DataFrame:
    """Receipts of complete datasets whose recorded hash still matches."""
    return receipt.where("quality_status = 'complete'").join(observed.select("file", "sha256"), ["file", "sha256"])
