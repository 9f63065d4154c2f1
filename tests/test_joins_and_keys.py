import datetime as dt

import pytest
from market_helpers import pdf

from marketloom.operators import asof as A
from marketloom.operators import calendar as C
from marketloom.operators import clean as CL
from marketloom.operators import concepts as CO
from marketloom.operators import keys as K
from marketloom.sources import tables as S


def test_keep_first_and_last(frame):
    df = frame("trade_date date, symbol string, v int, o int", [("2024-01-02", "A", 1, 0), ("2024-01-02", "A", 2, 1), ("2024-01-03", "A", 3, 0)])
    assert pdf(K.keep_one(df, ["trade_date", "symbol"], ["o"]), "trade_date")["v"].tolist() == [1, 3]
    assert pdf(K.keep_one(df, ["trade_date", "symbol"], ["o"], "last"), "trade_date")["v"].tolist() == [2, 3]


def test_duplicate_keys_raise(frame):
    df = frame("trade_date date, symbol string", [("2024-01-02", "A"), ("2024-01-02", "A")])
    with pytest.raises(K.DuplicateKeyError):
        K.assert_unique(df, ["trade_date", "symbol"])
    with pytest.raises(K.DuplicateKeyError):
        K.checked_join(df, df, ["trade_date", "symbol"])


def test_compact_and_iso_dates(frame):
    from marketloom.functions.expr import compact_date

    df = frame("x string", [("20240105",), ("2024-01-05",), ("2024-01-05 00:00:00",), ("bad",), (None,)])
    got = [r[0] for r in df.select(compact_date("x")).collect()]
    assert got == [dt.date(2024, 1, 5)] * 3 + [None, None]


def test_delisting_moves_to_the_next_session(frame):
    cal = frame("trade_date date", [("2024-01-05",), ("2024-01-08",)])
    x = frame("symbol string, delist_date date", [("A", "2024-01-06"), ("B", "2024-01-08"), ("C", "2024-01-09")])
    got = pdf(C.next_session(x, cal, "delist_date", "event_date", strict=False), "symbol")["event_date"].tolist()
    assert got[:2] == [dt.date(2024, 1, 8)] * 2 and got[2] is None
    assert pdf(C.next_session(x, cal, "delist_date", "e"), "symbol")["e"].tolist()[1] is None


def test_interval_expand_is_closed_on_both_ends(frame):
    spells = frame("symbol string, s date, e date", [("A", "2024-01-10", "2024-02-29")])
    dates = frame("trade_date date", [("2024-01-09",), ("2024-01-10",), ("2024-02-29",), ("2024-03-01",)])
    assert pdf(A.expand_intervals(spells, dates, "s", "e"), "trade_date")["trade_date"].tolist() == [dt.date(2024, 1, 10), dt.date(2024, 2, 29)]


def test_interval_industry_end_is_exclusive_and_open_end_is_active(frame):
    panel = frame("trade_date date, symbol string", [("2024-01-31", "A"), ("2024-02-01", "A"), ("2030-01-01", "A"), ("2024-01-31", "B")])
    spells = frame("symbol string, in_date date, out_date date, industry string", [("A", "2020-01-01", "2024-02-01", "x"), ("A", "2024-02-01", None, "y")])
    got = pdf(A.interval_value(panel, spells, "industry"), "symbol", "trade_date")["industry"].tolist()
    assert got == ["x", "y", "y", None]


def test_pit_fields_take_priority_not_recency_and_first_seen_on_ties(frame):
    ev = frame("symbol string, available_date date, report_period date, seq int, roe double",
               [("A", "2024-01-05", "2023-09-30", 1, 1.0), ("A", "2024-01-10", "2023-06-30", 2, 2.0), ("A", "2024-02-01", "2023-12-31", 3, None),
                ("A", "2024-02-02", "2023-12-31", 4, 4.0), ("A", "2024-02-02", "2023-12-31", 5, 5.0)])
    f = frame("trade_date date, symbol string", [("2024-01-04", "A"), ("2024-01-31", "A"), ("2024-02-01", "A"), ("2024-02-02", "A")])
    got = pdf(A.latest_pit_fields(ev, f, ["roe"], ["report_period", "available_date"]), "trade_date")["roe"].tolist()
    assert got[1:] == [1.0, 1.0, 4.0] and got[0] != got[0]


def test_unknown_announcement_date_wins(frame):
    q = frame("symbol string, end_date date, ann_date date, roe double", [("A.SZ", "2023-12-31", "2024-03-01", 1.0), ("A.SZ", "2023-12-31", None, 2.0), ("A.SZ", "2023-12-31", "2025-01-01", 3.0)])
    got = S.latest_announcement(q, "2024-12-31").first()
    assert got["symbol"] == "A" and got["roe"] == 2.0


def test_overlay_and_match_rate(frame):
    bars = frame("trade_date date, symbol string, is_suspended boolean", [("2024-01-02", "A", False), ("2024-01-02", "B", True), ("2024-01-02", "C", None)])
    ev = frame("trade_date date, symbol string", [("2024-01-02", "A"), ("2024-01-02", "A"), ("2024-01-02", "Z")])
    got = pdf(CL.overlay_suspensions(bars, ev), "symbol")
    assert got["is_suspended"].tolist() == [True, True, False] and got["newly_flagged"].tolist() == [True, False, False]
    assert tuple(CL.suspension_audit(bars, ev).first()) == (2, 1, 1)


def test_containment_join_finds_both_directions_and_falls_back(frame):
    c = frame("concept string", [("chip",), ("new energy car",), ("gold",), ("none",)])
    m = frame("member int, name string, description string", [(1, "AI Chip", "x"), (2, "energy", "makes gold"), (3, "bank", "gold vault")])
    got = {(r["concept"], r["member"]) for r in CO.concept_members(c, m).collect()}
    assert got == {("chip", 1), ("new energy car", 2), ("gold", 2), ("gold", 3)}


def test_month_end_rows_drop_the_running_month(frame):
    df = frame("trade_date date, symbol string", [("2024-01-30", "A"), ("2024-01-31", "A"), ("2024-02-05", "A")])
    got = pdf(S.month_end_rows(df, drop_current_after="2024-02-06"))["trade_date"].tolist()
    assert got == [dt.date(2024, 1, 31)]


def test_month_end_folders_read_only_their_files(spark, tmp_path):
    days = ["20240130", "20240131", "20240201", "20240229", "20240304"]
    spark.createDataFrame([(d, i) for i, d in enumerate(days)], "trade_date string, symbol int").write.partitionBy("trade_date").parquet(str(tmp_path / "x"))
    assert S.folder_values(spark, str(tmp_path / "x"), "trade_date") == days
    read = S.month_end_folders(spark, str(tmp_path / "x"), "2024-03-05")
    assert sorted(r.symbol for r in read.collect()) == [1, 3] and len(read.inputFiles()) == 2
    assert sorted(r.symbol for r in S.month_end_folders(spark, str(tmp_path / "x"), "2024-03-31").collect()) == [1, 3, 4]
    with pytest.raises(ValueError):
        S.month_end_folders(spark, str(tmp_path / "x" / "trade_date=20240131"))


def test_newest_vintage_or_the_older_layout(spark, tmp_path):
    spark.createDataFrame([(9, 1), (10, 2)], "vintage int, v int").write.partitionBy("vintage").parquet(str(tmp_path / "a"))
    assert [r.v for r in S.latest_vintage(spark, str(tmp_path / "a")).collect()] == [2]
    spark.range(3).write.parquet(str(tmp_path / "b"))
    assert S.latest_vintage(spark, str(tmp_path / "b")).count() == 3


def test_last_copy_of_a_turnover_row_counts(frame):
    from marketloom.operators.clean import clip_turnover

    rows = frame("trade_date date, symbol string, turnover_rate string, copy int", [("2024-01-02", "A", "3", 0), ("2024-01-02", "A", "200", 1), ("2024-01-02", "B", "x", 0), ("2024-01-02", "C", "0", 0)])
    assert {r.symbol: r.turnover_rate for r in clip_turnover(rows, order=["copy"]).collect()} == {"A": 100.0, "C": 0.01}


def test_a_wrong_reported_delta_does_not_match(frame):
    from marketloom.operators.verify import delta_report

    rows = frame("variant string, trade_date date, ret double", [("base", "2024-01-02", 1.0), ("base", "2024-01-03", 2.0), ("x", "2024-01-02", 2.0), ("x", "2024-01-03", 4.0), ("y", "2024-01-03", 0.0), ("z", "2024-01-03", 9.0)])
    got = {r.variant: (r.dates, r.delta_ret, r.ret_matches) for r in delta_report(rows, "base", ["ret"], frame("variant string, ret double", [("x", 1.5), ("y", 2.0)]), ["ret"]).collect()}
    assert got == {"x": (2, 1.5, True), "y": (1, -2.0, False), "z": (1, 7.0, False)}
