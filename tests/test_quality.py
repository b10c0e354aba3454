import pytest
from conftest import rows

from studyloom.plans import extract, quality

QUERIES = "subject long, visit string, module string, field string, query_text string, query_type string, query_status string, query_id string"


@pytest.fixture(scope="module")
def queries(frame):
    return frame(
        QUERIES,
        (1, "Dose 2", "Vitals", "Visit date", "Difference between dates.", "Automatic", "Open Query", "q1"),
        (1, "Dose 2", "Vitals", "Visit date", "Difference between dates.", "Automatic", "Open Query", "q1"),
        (1, "Dose 2", "Vitals", "Visit date", "Visit Date is missing.", "Manual", "Resolved", "q2"),
        (2, "Screening", "Lab", "Visit date", "Difference between", "Manual", "Open Query", "q3"),
        (2, "Unscheduled - 2", "Lab", "Visit date", "Difference between", "Manual", "Answered", "q4"),
        (2, None, "Lab", "Visit date", "Difference between", "Manual", "Answered", "q5"),
        (3, "B 14", "Lab", "Date of vaccination", "Visit Date is missing!", None, "Draft", "q6"),
        (3, "Day 42", "Lab", "Weight", "Difference between", "Manual", "Resolved", "q7"),
        (3, "Day 42", "Lab", "Visit date", None, "Manual", "Resolved", "q8"),
    )


def test_query_table_order_and_totals(queries):
    out = quality.query_table(queries).collect()
    assert [r.query_status for r in out] == ["Resolved", "Answered", "Open Query", "Draft", "Total"]
    assert (out[-1].Automatic, out[-1].Manual, out[-1].NA, out[-1].Total) == (2, 6, 1, 9)
    assert tuple(quality.query_totals(queries).first()) == (9, 2, 6, 3)


@pytest.fixture(scope="module")
def forms(frame):
    return frame(
        "subject long, visit string, module string, visit_date date, entry_status string, entered_by string, source_signoff string, ecrf_signoff string",
        (1, "Dose 2", "Vitals", "2021-01-05", "Complete", "Ann (nurse)", "Pending", "Pending"),
        (2, "Day 14", "Lab", "2021-01-05", "Incomplete", None, "Pending", "Signed"),
        (3, "Day 14", "Lab", "2021-01-05", "Not Started", "Bob", "Pending", "Pending"),
        (4, None, "Lab", "2021-01-05", "Incomplete", "Bob", None, "Pending"),
        (9, "Day 14", "Lab", "2021-01-05", None, "Bob", "Pending", "Pending"),
        (9, "Day 14", "Lab", "2021-01-05", None, "Bob", "Pending", "Pending"),
    )


@pytest.fixture(scope="module")
def visits(frame):
    return frame("subject long, visit string, visit_date date", (1, "Dose 2", "2021-01-05"), (1, "Dose 2", "2021-01-06"), (9, "x", None))


def test_open_queries(queries, visits, forms):
    out = quality.open_queries(queries, visits, forms)
    assert rows(out) == [
        ("1", "Dose 2", "2021Jan05", "Vitals", "Visit date", "Difference between dates", "Ann nurse"),
        ("1", "Dose 2", "2021Jan06", "Vitals", "Visit date", "Difference between dates", "Ann nurse"),
        ("2", "Screening", None, "Lab", "Visit date", "Difference between", "Pending Entry"),
    ]
    assert [tuple(r) for r in quality.open_by_module(out).collect()] == [("Vitals", 2), ("Lab", 1)]


def test_open_queries_fail_on_two_forms(queries, visits, forms):
    with pytest.raises(Exception, match="more than one row matches"):
        quality.open_queries(queries, visits, forms.union(forms)).collect()


def test_incomplete_and_signoff(forms):
    assert rows(quality.incomplete_records(forms), "subject") == [(2,), (4,)]
    assert rows(quality.incomplete_records(forms, [(2, "Day 14"), (4, "Day 14")]), "subject") == [(4,)]
    assert rows(quality.incomplete_records(forms, [(4, None)]), "subject") == [(2,)]
    assert rows(quality.signoff_pending(forms), "subject") == [(1,), (2,)]
    assert rows(quality.signoff_pending(forms, "ecrf"), "subject") == [(1,)]
    assert tuple(quality.signoff_totals(forms).first()) == (2, 1)
    with pytest.raises(ValueError):
        quality.signoff_pending(forms, "paper")


def test_deviations(queries, frame):
    found = quality.deviations(queries)
    # Screening, unscheduled and missing visits go; the dot in the text rule stands for any character.
    assert rows(found, "subject", "visit_code", "query_text") == [
        (1, "Day 28", "Difference between dates."), (3, "Day B14", "Visit Date is missing!"),
    ]
    assert rows(quality.open_deviations(found), "subject") == [(1,)]
    schedule = frame(
        "visit_code string, exact_date date, window_close date", ("Day 28", "2021-01-05", "2021-01-01"), ("Day 28", "2021-01-01", "2021-01-01"),
        ("Day 42", "2021-01-05", "2021-01-01"),
    )
    assert rows(quality.deviation_table(found, schedule)) == [("Day 28", 1, 1), ("Day B14", 1, None), ("Total", 2, 1)]


def test_still_in_snapshot(frame):
    cols = "subject long, visit string, module string, field string, query_text string"
    earlier = frame(cols + ", entered_by string", (1, "v", "m", "f", "t", "Ann"), (2, "v", None, "f", "t", "Bob"), (3, "v", "m", "f", "t", "Cy"))
    today = [frame(cols, (1, "v", "m", "f", "t")), frame(cols, (2, "v", None, "f", "t"), (3, "v", "m", "f", "other"))]
    assert rows(extract.still_in_snapshot(earlier, [*today, today[0]]), "subject", "entered_by", "today_rows") == [
        (1, "Ann", 2), (2, "Bob", 1),
    ]
