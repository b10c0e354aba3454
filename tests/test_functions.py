from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from studyloom import functions as fn


def one(df, col):
    return [r[0] for r in df.select(col.alias("x")).collect()]


def test_blank_to_null_touches_text_only(frame):
    df = frame("a string, `b c` string, n int", ("", "x", 0), ("y", "", 1))
    assert rows(fn.blank_to_null(df)) == [("y", None, 1), (None, "x", 0)]


def test_replace_first_is_literal_and_once(frame):
    df = frame("i int, t string", (1, "a.b.c"), (2, "abc"), (3, None), (4, ".."))
    assert rows(fn.replace_first(df, "t", ".", "_"), "i", "t") == [(1, "a_b.c"), (2, "abc"), (3, None), (4, "_.")]
    assert rows(fn.replace_first(df, "t", "b", ""), "i", "t")[0] == (1, "a..c")
    with pytest.raises(ValueError):
        fn.replace_first(df, "t", "")


def test_not_in_keeps_missing(frame):
    df = frame("t string", ("a",), ("b",), (None,))
    assert one(df, fn.not_in("t", ["a"])) == [False, True, True]
    assert df.filter(~F.col("t").isin("a")).count() == 1
    assert one(df, fn.not_in("t", [])) == [True, True, True]


def test_text_tests_differ_on_missing(frame):
    df = frame("t string", ("Unscheduled - 1",), ("Day 1",), (None,))
    assert one(df, fn.has_text("t", "Unsch")) == [True, False, False]
    assert one(df, fn.matches_text("t", "Unsch")) == [True, False, None]
    assert one(df, fn.either_text("t", ["Unsch", "Day"])) == [True, True, False]


def test_presence(frame):
    df = frame("a int, b int", (1, None), (None, None), (1, 2))
    assert one(df, fn.any_present("a", "b")) == [True, False, True]
    assert one(df, fn.all_present("a", "b")) == [False, False, True]
    assert fn.keep_present(df, "b").count() == 1


def test_strip_punctuation_of_any_script(frame):
    df = frame("t string, n int", ("a-b — c (5%) $+<=>^`|~ «x» é", 12))
    assert rows(fn.strip_punctuation(df)) == [("ab  c 5  x é", "12")]


def test_to_number(frame):
    df = frame("t string", ("1.5",), (" 2 ",), ("x",), ("",), (None,), ("3d",), ("4f",), ("1e3",), ("-0.5",))
    assert one(df, fn.to_number("t")) == [1.5, 2.0, None, None, None, None, None, 1000.0, -0.5]


LAYOUTS = ["d-MMM-yyyy", "d-MMM-yyyy H:mm", "d M yyyy", "yyyy M d", "d/M/yyyy", "d-M-yyyy H:mm", "yyyy-MM-dd"]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("05-Jan-2021", date(2021, 1, 5)), ("5-JAN-2021", date(2021, 1, 5)), ("05-Jan-2021 09:30", date(2021, 1, 5)),
        ("05 01 2021", date(2021, 1, 5)), ("2021 01 05", date(2021, 1, 5)), ("05/01/2021", date(2021, 1, 5)),
        ("05-01-2021 10:00", date(2021, 1, 5)), ("2021-01-05", date(2021, 1, 5)), ("30/02/2021", None),
        ("29-Feb-2020", date(2020, 2, 29)), ("29-Feb-2021", None), ("", None), ("n/a", None), (None, None),
    ],
)
def test_parse_date(frame, raw, expected):
    assert one(frame("t string", (raw,)), fn.parse_date("t", LAYOUTS)) == [expected]


@pytest.mark.parametrize(
    "start,end,months",
    [
        ("2020-01-15", "2020-02-14", 0), ("2020-01-15", "2020-02-15", 1), ("2020-01-31", "2020-02-28", 0),
        ("2020-01-31", "2020-02-29", 0), ("2020-01-31", "2020-03-31", 2), ("2019-02-28", "2020-02-28", 12),
        ("2020-02-29", "2021-02-28", 11), ("2020-05-10", "2020-05-10", 0),
    ],
)
def test_months_complete(frame, start, end, months):
    df = frame("s date, e date", (start, end))
    assert one(df, fn.months_complete("s", "e")) == [months]


def test_days_between_is_signed(frame):
    df = frame("d date", ("2021-01-01",), ("2021-01-10",), (None,))
    assert one(df, fn.days_between(date(2021, 1, 5), "d")) == [4, -5, None]


@pytest.mark.parametrize("shift", range(7))
def test_weekday_rank_starts_at_as_of(frame, shift):
    as_of = date(2021, 3, 1) + timedelta(days=shift)
    names = fn.weekday_order(as_of)
    days = [as_of + timedelta(days=i) for i in range(7)]
    df = frame("d date", *[(d,) for d in days])
    assert one(df, fn.weekday_rank("d", as_of)) == list(range(7))
    assert one(df, fn.weekday_name("d")) == names == [d.strftime("%A") for d in days]


def test_date_text(frame):
    assert one(frame("d date", ("2021-01-05",), (None,)), fn.date_text("d")) == ["2021Jan05", None]


def test_levels(frame):
    df = frame("v string", ("b",), ("a",), ("z",), (None,))
    out = fn.with_level(df, "v", ["b", "a"], ["Bee", "Ay"])
    assert rows(out, "v", "v_rank") == [("Ay", 2), ("Bee", 1), (None, None), (None, None)]
    with pytest.raises(ValueError):
        fn.with_level(df, "v", ["a"], [])
    long = fn.with_level(df, "v", [str(i) for i in range(1001)] + ["a"])
    assert rows(long, "v", "v_rank") == [("a", 1002), (None, None), (None, None), (None, None)]
    table = frame("level string, label string, rank int", ("b", "Bee", 1), ("a", "Ay", 2))
    assert rows(fn.with_level(df, "v", table), "v", "v_rank") == rows(out, "v", "v_rank")


def test_recode_and_suffix(frame):
    df = frame("v string", ("a",), ("b",), (None,))
    assert one(df, fn.recode("v", {"a": "A"})) == ["A", "b", None]
    df = frame("v string", ("MLR-12",), ("MLR-x",), (None,), ("MLR-" + "0" * 21 + "7",), ("MLR-3000000000",))
    assert one(df, fn.numeric_suffix("v", 5)) == [12, None, None, 7, 3_000_000_000]
