import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture
def frame(spark):
    """DataFrame from rows: ``frame("trade_date date, symbol string", [("2024-01-02", "A")])``."""
    from pyspark.sql import functions as F

    def make(schema, rows):
        fields = [f.strip().split() for f in schema.split(",")]
        raw = ", ".join(f"{n} {'string' if t in ('date', 'timestamp') else t}" for n, t in fields)
        df = spark.createDataFrame(rows, raw)
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in fields])

    return make
