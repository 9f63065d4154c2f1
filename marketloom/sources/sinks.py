"""Writers."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import csv
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from ..session import importable, open_fs, staged


def by_date_folders(df: DataFrame, path: str, date: str = "trade_date") -> None:
    """``trade_date=YYYYMMDD/`` folders; rebalance groups a date's rows and splits an oversized one."""
    out = df.withColumn(date, F.date_format(date, "yyyyMMdd").cast("int"))
    out.hint("rebalance", date).write.partitionBy(date).parquet(path)


def by_symbol_csv(df: DataFrame, path: str, symbol: str = "symbol") -> DataFrame:
    """One CSV folder ``symbol=<value>`` per symbol, with a header, rows of a symbol in date order; returns (symbol, file, rows).

    Tasks write the files themselves and move them into place: Spark's writer opens, commits and lists every folder by
    itself, the last two on the driver alone, which a market's names outgrow. A symbol that rebalancing splits has several files.
    """
    kind, spark = dict(df.dtypes)[symbol], df.sparkSession
    rest = [c for c in df.columns if c != symbol]
    importable(spark)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.csv"
        where, root = open_fs(path)
        out, now, file, rows = None, None, "", 0
        done: list[tuple] = []

        def close():
            out.close()
            where.move(f"{file}.{task.taskAttemptId()}", file)
            done.append((now, file, rows))

        try:
            for b in parts:
                keys = b.column(b.schema.get_field_index(symbol))
                body = b.select(rest)
                values, starts = keys.to_pylist(), [0]
                starts += [i for i in range(1, len(values)) if values[i] != values[i - 1]]
                for lo, hi in zip(starts, [*starts[1:], len(values)]) if values else ():
                    if out is None or values[lo] != now:
                        if out is not None:
                            close()
                        now, rows = values[lo], 0
                        folder = f"{root}/{symbol}={'__HIVE_DEFAULT_PARTITION__' if now is None else quote(str(now), safe=' -._')}"
                        where.create_dir(folder, recursive=True)
                        file = f"{folder}/{name}"
                        out = csv.CSVWriter(where.open_output_stream(f"{file}.{task.taskAttemptId()}", compression=None), body.schema, write_options=csv.WriteOptions(quoting_style="needed"))
                    out.write_batch(body.slice(lo, hi - lo))
                    rows += hi - lo
                if len(done) >= 1000:
                    yield manifest(done)
                    done = []
            if out is not None:
                close()
            yield manifest(done)
        finally:
            if out is not None:
                out.close()

    def manifest(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key_type), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], ["symbol", "file", "rows"])

    key_type = to_arrow_type(df.schema[symbol].dataType)
    rows = df.hint("rebalance", symbol).sortWithinPartitions(symbol, "trade_date")
    return staged(rows.mapInArrow(write, f"symbol {kind}, file string, rows long"))


def read_symbol_csv(written: DataFrame, schema: str) -> DataFrame:
    """Rows of the files that ``by_symbol_csv`` returned, with their symbol; each task opens its share of them, none is listed."""
    kind, fields = dict(written.dtypes)["symbol"], to_arrow_schema(StructType.fromDDL(schema))
    key_type = to_arrow_type(written.schema["symbol"].dataType)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for symbol, file in zip(b.column("symbol").to_pylist(), b.column("file").to_pylist()):
                where, name = open_fs(file)
                with where.open_input_stream(name, compression=None) as source:
                    t = csv.read_csv(source, convert_options=csv.ConvertOptions(column_types=dict(zip(fields.names, fields.types)), strings_can_be_null=True))
                t = t.append_column("symbol", pa.array([symbol] * len(t), key_type))
                yield from t.select([*fields.names, "symbol"]).combine_chunks().to_batches()

    shares = max(8, int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written.select("symbol", "file").repartition(shares).mapInArrow(read, f"{schema}, symbol {kind}")


def result_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each result as Parquet, CSV and JSON."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
        df.write.option("header", True).csv(f"{path}/{name}.csv")
        df.write.json(f"{path}/{name}.json")
