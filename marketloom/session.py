"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "marketloom") -> SparkSession:
    """Session for tests and the local benchmark; clusters bring their own."""
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; one in the warehouse only when none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For panels that several branches of one job read: the lineage is computed once,
    column pruning still applies to the re-read, and a lost executor costs one file.
    """
    spark = df.sparkSession
    path = f"{staged_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Delete what this application staged, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staged_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """(file system, path) for a folder or file URI; works in tasks, for any store that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and send them texts in batches of a few megabytes, however long they are."""
    importable(spark)
    for key, most in BATCH.items():
        now = re.match(r"\d+", str(spark.conf.get(key)))
        if not now or int(now[0]) > most or int(now[0]) <= 0:
            spark.conf.set(key, str(most))
