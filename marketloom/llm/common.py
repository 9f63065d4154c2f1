"""Helpers shared by the operators: tables, shared folders, files, text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import open_fs, prepare, shared_dir, staged

__all__ = ["table", "staged", "shared_dir", "fresh_dir", "parallelism", "open_fs", "write_atomic", "columns_of", "salted", "batches"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder, not yet made, under the shared folder of the cluster."""
    return f"{shared_dir(spark)}/{what}/{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    """Partitions for shuffles that name a number: the cluster's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_atomic(uri: str, write) -> None:
    """Call ``write(stream)`` on a private name, then move it into place: a retried task replaces the same file."""
    where, path = open_fs(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(private, compression=None) as out:
        write(out)
    where.move(private, path)


def columns_of(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under fixed names; a clashing extra column never gets in."""
    prepare(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").alias(to) for to, c in names.items()])


def salted(key: Column, salts: int) -> Column:
    """0 .. salts-1, evenly from a row key."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def batches(rows: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """Columns of each Arrow batch as Python lists."""
    for b in rows:
        yield [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]
