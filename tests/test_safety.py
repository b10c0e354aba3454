from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from studyloom.plans import records, safety

AS_OF = date(2021, 6, 30)
ORDER = ["onset", "record_id"]


@pytest.fixture(scope="module")
def visits(frame):
    return frame(
        "subject long, visit string, visit_date date, first_entry date",
        (1, "Day 28", "2021-06-01", "2021-06-01"), (1, "Day 14", "2021-05-01", "2021-06-01"), (2, "Dose 1", "2021-06-02", "2021-06-03"),
        (3, "Dose 1", None, "2021-06-05"), (3, "Dose 2", "2021-06-06", None),
    )


@pytest.fixture(scope="module")
def forms(frame):
    return frame(
        "subject long, visit string, visit_date date, entry_status string, entered_by string",
        (1, "Day 28", "2021-06-01", "Complete", "Bob"), (1, "Day 28", "2021-06-01", "Complete", "Ann"),
        (1, "Day 14", "2021-05-01", "Complete", "Cy"), (2, "Dose 1", "2021-06-02", "Not Started", "Ann"),
        (3, "Dose 1", None, "Complete", None), (3, "Dose 2", "2021-06-06", "Complete", "Dee"),
    )


@pytest.fixture(scope="module")
def events(frame):
    return frame(
        "record_id int, subject long, any_event string, ae_code string, term_code long, high_term string, onset date, resolution date,"
        " severity string, outcome string, first_entry date, last_entry date",
        (1, 1, "Yes", "A1", 10, "T1", "2021-06-01", None, "Grade 3", "Not recovered", "2021-06-01", "2021-06-25"),
        (2, 1, "Yes", "A1", 10, "T1", "2021-06-02", None, "Grade 1", "Not recovered", "2021-06-01", "2021-06-25"),
        (3, 1, "Yes", "A2", 99, None, "2021-06-25", None, "Grade 2", "Recovering / Resolving", "2021-06-01", "2021-06-25"),
        (4, 2, "Yes", "A1", 10, "T2", "2021-06-03", None, "Grade 3", "Fatal", "2021-06-03", "2021-06-25"),
        (5, 3, "Yes", "A1", 10, "T2", "2021-06-05", "2021-06-06", "Grade 3", "Not recovered", "2021-06-05", "2021-06-23"),
        (6, 3, "No", "A2", 99, "T2", "2021-06-05", "2021-06-06", "Grade 1", "Not recovered", "2021-06-07", "2021-06-22"),
        (7, 3, "Yes", "A3", 10, "T2", None, "2021-06-06", "Grade 3", "Not recovered", None, "2021-06-30"),
    )


@pytest.fixture(scope="module")
def linked(events, visits, forms):
    entries = records.visit_entries(visits, forms, ["Day 14"])
    return safety.link_unsolicited(events, entries, AS_OF, [99], ORDER)


def test_visit_entries(visits, forms):
    # Missing dates match missing dates; started forms only; first visit of the entry day.
    assert rows(records.visit_entries(visits, forms), "subject", "entry_date", "visit", "entered_by") == [
        (1, date(2021, 6, 1), "Day 14", "Cy"), (3, date(2021, 6, 5), "Dose 1", None), (3, None, "Dose 2", "Dee"),
    ]
    assert rows(records.visit_entries(visits, forms, ["Day 14"]), "subject", "visit", "entered_by")[0] == (1, "Day 28", "Ann")


def test_entries_equal_join_then_first(visits, forms):
    """Taking the first visit before the link gives what linking all of them and then taking the first does."""
    pairs = [
        (v.subject, v.first_entry, v.visit, f.entered_by, f.entry_status)
        for v in visits.collect()
        for f in forms.filter("entry_status <> 'Not Started'").collect()
        if (v.subject, v.visit, v.visit_date) == (f.subject, f.visit, f.visit_date)
    ]
    best = {}
    for p in sorted(pairs, key=lambda p: (p[2], p[3] is None, p[3] or "")):
        best.setdefault(p[:2], p[2:4])
    got = {(r.subject, r.entry_date): (r.visit, r.entered_by) for r in records.visit_entries(visits, forms).collect()}
    assert got == best


def test_link(linked):
    assert rows(linked, "record_id", "linked_visit", "entered_by", "days") == [
        (1, "Day 28", "Ann", 29), (3, "Day 28", "Chronic", 5), (4, None, None, 27), (5, "Dose 1", None, 25), (6, None, "Chronic", 25),
    ]


def test_lists(linked):
    assert rows(safety.grade_three(linked), "subject") == [(1,), (2,), (3,)]
    opened = safety.still_open(linked)
    assert rows(opened, "subject", "ae_code") == [(1, "A1"), (1, "A2"), (3, "A1"), (3, "A2")]
    assert rows(safety.still_open(linked, min_days=7), "subject", "ae_code") == [(1, "A1"), (3, "A1"), (3, "A2")]
    teams = safety.open_by_team(opened, [("nurses", ["An", "Bo"]), ("lead", ["Zed"])], unlinked_team="lead")
    assert "entered_by" not in teams.columns
    assert rows(teams, "team", "subject", "ae_code") == [("Chronic", 1, "A2"), ("lead", 3, "A2"), ("nurses", 1, "A1")]


def test_closure(linked, events, visits, forms):
    both = safety.listed_and_every(events, visits, forms, ["Day 14"], [99], [], ORDER)
    shown = ["subject", "ae_code", "first_entry", "outcome", "linked_visit", "entered_by"]
    everywhere = safety.link_unsolicited(events, records.visit_entries(visits, forms), AS_OF, [], ORDER, dated_only=False)
    for rule, expected in (("listed", linked), ("every", everywhere)):
        assert rows(both.filter(F.col("rule") == rule), *shown) == rows(expected, *shown)
    out = safety.closure_summary(both, AS_OF, ["Ann", "Dee"])
    # Closed events of owners without open ones are left out, here those entered by Dee.
    assert [tuple(r) for r in out.collect()] == [
        ("Ann", 1, 1, None), ("Pending Link", 1, 1, None), ("Chronic", 2, 1, None), ("Total", 4, 3, 0),
    ]


def test_tables(events, linked, frame):
    table = {r.outcome: r for r in safety.outcome_by_grade(safety.reported(events)).collect()}
    assert table["Not recovered"]["Grade 3"] == 3 and table["Not recovered"]["Grade 2"] is None and table["Total"].Total == 6
    terms = {r.high_term: r.Total for r in safety.term_by_grade(events, "high_term", missing="Other infections").collect()}
    assert terms == {"T1": 2, "T2": 4, "Other infections": 1, "Total": 7}
    assert [tuple(r) for r in safety.grade_three_counts(linked, "high_term").collect()] == [("T2", 2), ("T1", 1), ("Total", 3)]
    dosed = frame("post_dose string, outcome string, severity string", ("Dose 1", "x", "Grade 1"), (None, "x", "Grade 1"))
    assert safety.after_dose(dosed).count() == 1


def test_solicited(frame):
    local = frame(
        "subject long, post_dose string, term string, onset date, ongoing string, resolution date, outcome string",
        (1, "Dose 1", "Pain", "2021-06-01", "Yes", None, "Recovering / Resolving"), (2, "Dose 1", "Pain", "2021-06-01", "No", "2021-06-02", "Recovering / Resolving"),
        (3, "Dose 1", "Pain", None, "Yes", None, "Recovering / Resolving"),
    )
    systemic = local.filter("subject = 1").drop("ongoing")
    assert rows(safety.open_solicited(local, systemic), "kind", "subject", "ongoing") == [
        ("Local Solicited", 1, "Yes"), ("Local Solicited", 3, "Yes"), ("Systemic Solicited", 1, None),
    ]
    assert rows(safety.recovering(local, AS_OF), "subject", "days") == [(1, 29), (2, 29)]
