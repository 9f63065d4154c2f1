import datetime as dt
import random

import pytest

from marketloom.operators import verify as VF

ROWS = "trade_date date, symbol long, flag boolean"
SPANS = "symbol long, in_date date, out_date date"


def test_interval_agreement_is_the_union_of_the_intervals(spark):
    """Overlapping, touching, open, repeated and reversed intervals; repeated rows; null flags."""
    r, day = random.Random(3), lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    spans = [(s, day(a), None if r.random() < 0.1 else day(a + r.randint(-2, 9))) for s in range(12) for a in [r.randint(0, 40) for _ in range(r.randint(0, 5))]]
    spans += spans[:2] + [(1, None, day(3))]
    rows = [(day(i), s, r.choice([True, False, None])) for s in range(14) for i in range(50) if r.random() < 0.7]
    rows += rows[:5]
    inside = lambda d, s: any(s == x and a is not None and a <= d and (b is None or d <= b) for x, a, b in spans)
    hit = sum(1 for d, s, f in rows if f and inside(d, s))
    got = VF.interval_agreement(spark.createDataFrame(rows, ROWS), "flag", spark.createDataFrame(spans, SPANS)).first()
    assert got.precision == pytest.approx(hit / sum(inside(d, s) for d, s, _ in rows)) and got.recall == pytest.approx(hit / sum(1 for *_, f in rows if f))


def test_rates_and_empty_tables(spark):
    k = ["trade_date", "symbol"]
    a = spark.createDataFrame([("d", 1), ("d", 1), ("d", 2), (None, 3), (None, 3), ("e", 4)], "trade_date string, symbol long")
    b = spark.createDataFrame([("d", 1), ("d", 1), ("e", 5)], "trade_date string, symbol long")
    none = a.limit(0)
    value = lambda df: df.first().observed
    assert [value(VF.duplicate_rows(x, k)) for x in (a, b, none)] == [2.0, 1.0, 0.0]
    assert value(VF.join_rate(a, b, k)) == pytest.approx(2 / 6) and value(VF.join_rate(none, b, k)) is None
    assert [value(VF.date_coverage(x, y)) for x, y in ((b, a), (none, a), (a, none))] == [1.0, 0.0, 0.0]
    empty = VF.interval_agreement(spark.createDataFrame([], ROWS), "flag", spark.createDataFrame([], SPANS)).first()
    assert empty.precision is None and empty.recall is None


def test_selections_audit_every_name(spark):
    """No cut by rank: every bar of the two markets is audited."""
    from marketloom import fixtures as V
    from marketloom.catalog.sources import scan_selections

    d = "/root/testdata/sf0.001"
    assert scan_selections(spark, d).first().rows == V.daily(spark, d).where("symbol % 10 < 9").count()
