from datetime import date, timedelta

import pytest
from conftest import rows

from studyloom.plans import quality, schedule

AS_OF = date(2021, 6, 16)
SCHEMA = (
    "subject long, visit_code string, scheduled_date date, rescheduled_date date, exact_date date, window_close date,"
    " group string, site string"
)


@pytest.fixture(scope="module")
def visits(frame):
    return frame(
        SCHEMA,
        (1, "Day 14", "2021-06-01", None, "2021-06-02", "2021-06-10", "Group A", "S1"),   # done
        (2, "Day 14", "2021-06-01", None, None, "2021-06-10", "Group A", "S1"),           # missed
        (3, "Day 14", "2021-06-01", None, None, "2021-06-16", "Group B", "S2"),           # closes today
        (4, "Day 28", "2021-06-16", None, None, "2021-06-30", "Group B", "S2"),           # due today
        (5, "Day 28", "2021-07-01", "2021-06-10", None, "2021-07-10", "Group A", "S1"),   # only rescheduled is past
        (6, "Day 28", "2021-07-01", None, "2021-06-15", "2021-06-12", "Group A", "S1"),   # early and out of window
        (7, "Day 3B28", None, None, None, None, "Group A", "S1"),
        (8, "Unlisted", "2021-01-01", None, None, "2021-01-10", "Group A", None),
        (9, "Day 42", "2021-08-01", None, None, "2021-08-10", "Group A", "S1"),           # future
    )


def test_visit_table(visits):
    out = [tuple(r) for r in schedule.visit_table(visits, AS_OF, 3).collect()]
    assert out == [
        ("Day 14", 3, 1, 1, 1, "33%", "33.3%"),
        ("Day 28", 2, 1, 1, None, "33%", "50.0%"),
        (None, 1, None, None, 1, None, None),
        ("Total", 6, 2, 2, 2, "-", "33.3%"),
    ]


def test_visit_table_equals_four_branches(visits, frame):
    """The one-pass table against filter, group and join per column."""
    import random

    rng = random.Random(5)
    day = lambda: rng.choice([None, *[AS_OF + timedelta(days=d) for d in (-9, -1, 0, 1, 9)]])
    data = [(i, rng.choice(["Day 14", "Day 28", "Day 42"]), day(), day(), day(), day(), "Group A", "S") for i in range(200)]
    df = frame(SCHEMA, *data)
    table = {r.visit_code: r for r in schedule.visit_table(df, AS_OF, 10).collect()}
    for code in ("Day 14", "Day 28", "Day 42"):
        mine = [r for r in data if r[1] == code]
        assert table[code].scheduled == sum((r[2] is not None and r[2] <= AS_OF) or r[4] is not None for r in mine)
        assert (table[code].actual or 0) == sum(r[4] is not None for r in mine)
        assert (table[code].due or 0) == sum(
            r[2] is not None and r[2] <= AS_OF and r[4] is None and r[5] is not None and r[5] >= AS_OF for r in mine
        )
        assert (table[code].missed or 0) == sum(
            r[2] is not None and r[2] < AS_OF and r[4] is None and r[5] is not None and r[5] < AS_OF for r in mine
        )


def test_table_and_chart_rules_differ_on_the_closing_day(visits):
    long = rows(schedule.visit_status_long(visits, AS_OF), "subject", "status")
    assert (3, "Missed") in long and (3, "Due visit") not in long
    assert rows(schedule.due_visits(visits, AS_OF), "subject") == [(3,), (4,)]
    # The chart goes by the rescheduled date, and leaves out visits not yet planned.
    assert (5, "Due visit") in long and not [x for x in long if x[0] in (6, 9)]
    counts = schedule.visit_status_counts(visits, AS_OF)
    assert sum(r.n for r in counts.collect()) == len(long)
    expected = schedule.visit_status_long(visits, AS_OF).groupBy("group", "visit_code", "status").count()
    assert rows(counts, "group", "visit_code", "status", "n") == rows(expected)
    with pytest.raises(ValueError):
        schedule.status_rules(AS_OF, "other")


def test_lists(visits):
    assert rows(schedule.missed_visits(visits, AS_OF), "subject") == [(2,), (8,)]
    assert rows(schedule.rescheduled_visits(visits), "subject") == [(5,)]
    assert rows(quality.out_of_window(visits), "subject") == [(6,)]
    assert rows(quality.out_of_window_counts(visits)) == [("Day 28", 1), ("Total", 1)]


def test_sites_by_arm(visits):
    table = {r.site: r for r in schedule.sites_by_arm(visits).collect()}
    assert (table["S1"]["Group A"], table["S1"]["Group B"], table["Total"].Total) == (6, None, 9)


def test_unscheduled(frame):
    v = frame(
        "subject long, visit string, visit_date date",
        (1, "Unscheduled - 1", "2021-06-09"), (2, "Unscheduled - 2", "2021-06-16"), (3, "Day 14", "2021-06-10"), (4, None, "2021-06-10"),
        (5, "Unscheduled - 3", "2021-06-08"),
    )
    assert rows(schedule.unscheduled_visits(v), "subject") == [(1,), (2,), (5,)]
    assert rows(schedule.unscheduled_visits(v, AS_OF), "subject") == [(1,)]


def test_last_week_has_no_upper_bound(frame):
    df = frame(
        SCHEMA,
        *[(i, "Day 14", None, None, d, None, "Group A", "S1") for i, d in enumerate(["2021-06-08", "2021-06-09", "2021-06-15", "2021-06-16", "2021-06-20", None])],
    )
    week = schedule.last_week_visits(df, AS_OF)
    assert rows(week, "subject") == [(1,), (2,), (4,)]
    table = schedule.weekday_table(week, ["site", "visit_code"], "exact_date", AS_OF).first()
    assert (table.n, table.n_wednesday, table.n_tuesday, table.n_sunday, table.pct_sunday) == (3, 1, 1, 1, 33.3)


@pytest.mark.parametrize("shift", range(7))
def test_weekday_columns_start_at_any_as_of_day(frame, shift):
    as_of = date(2021, 6, 14) + timedelta(days=shift)
    df = frame("g string, d date", ("a", as_of))
    columns = schedule.weekday_table(df, ["g"], "d", as_of).columns
    assert columns[2] == f"n_{as_of.strftime('%A').lower()}" and len(columns) == 16


def test_next_week(frame):
    df = frame(
        SCHEMA,
        (1, "Day 14", "2021-06-16", None, None, None, "Group A", "S1"),
        (2, "Day 14", "2021-06-22", None, None, None, "Group A", "S1"),
        (3, "Day 14", "2021-06-23", None, None, None, "Group A", "S1"),           # day seven
        (4, "Day 14", "2021-06-01", "2021-06-18", None, None, "Group A", "S1"),
        (5, "Day 14", "2021-06-18", "2021-07-18", None, None, "Group A", "S1"),   # listed under the later date
        (6, "Day 14", "2021-06-18", "2021-06-19", None, None, "Group A", "S1"),   # meets both, listed once
        (7, "Day 14", "2021-06-18", None, "2021-06-15", None, "Group A", "S1"),   # done
        (8, "Day 14", "2021-06-20", None, None, None, "Group A", "S2"),
        (8, "Day 14", "2021-06-18", None, None, None, "Group A", "S1"),           # repeated, earliest kept
    )
    six = rows(schedule.next_week_visits(df, AS_OF), "subject", "target_date")
    assert six == [
        (1, date(2021, 6, 16)), (2, date(2021, 6, 22)), (4, date(2021, 6, 18)), (5, date(2021, 7, 18)),
        (6, date(2021, 6, 19)), (8, date(2021, 6, 18)),
    ]
    assert len(rows(schedule.next_week_visits(df, AS_OF, days=7))) == 7


def test_immunology(frame):
    df = frame(
        SCHEMA,
        (1, "Day 3B0", "2021-06-24", None, None, None, "Group A", "S1"), (2, "Day 3B0", "2021-06-25", None, None, None, "Group A", "S1"),
        (3, "Day 3B0", "2020-01-01", None, None, None, "Group A", "S1"), (4, "Day 3B0", "2021-06-20", None, None, None, "Group B", "S1"),
        (5, "Day 14", "2021-06-20", None, None, None, "Group A", "S1"), (6, "Day 3B0", "2021-06-20", None, "2021-06-10", None, "Group A", "S1"),
    )
    assert rows(schedule.immunology_due(df, AS_OF), "subject") == [(1,), (3,)]
