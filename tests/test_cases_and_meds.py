from datetime import date

import pytest
from conftest import rows

from studyloom.fixed_values import FILM, FILM_NEGATIVE, RDT, RDT_POSITIVE
from studyloom.plans import cases, meds, records

CASE = "Malaria case report"


@pytest.fixture(scope="module")
def vaccination(frame):
    return frame(
        "subject long, visit string, dose_date date",
        (1, "Dose 1", "2021-01-10"), (1, "Dose 2", "2021-02-10"), (1, "2B0 Vaccination", "2021-03-10"),
        (2, "Dose 1", "2021-01-10"), (2, "Dose 2", "2021-01-10"), (2, "Dose 3", None),
    )


MEDS = (
    "subject long, visit string, indication string, episode string, generic_name string, brand_name string, start_date date, ongoing string,"
    " stop_date date, frequency string, first_entry date, last_entry date"
)


@pytest.fixture(scope="module")
def medications(frame):
    return frame(
        MEDS,
        (1, "Logs", "Malaria", "M1", "Artemether lumefantrine", "B", "2021-01-09", "No", "2021-01-12", "x", "2021-01-10", None),
        (1, "Logs", "Malaria", "M2", "Lumefantrine", "B", "2021-03-20", "Yes", None, "x", "2021-03-20", None),
        (2, "Logs", "Malaria", "M1", "lumefantrine", "B", "2021-01-01", "Yes", None, "x", "2021-01-09", None),
        (2, "Logs", "Fever", "M2", "lumefantrine", "B", "2021-01-20", "Yes", None, "x", "2021-01-20", None),
        (2, "Logs", "Malaria", "M3", "Quinine", "B", "2021-01-20", "Yes", None, "x", "2021-01-20", None),
        (3, "Logs", "Malaria", "M1", None, "B", "2021-01-20", "Yes", None, "x", None, None),
    )


def test_treatment_cases(frame, medications, vaccination):
    visits = frame(
        "subject long, visit string, visit_date date", (1, "Dose 1", "2021-01-10"), (1, "Extra", "2021-01-10"), (1, "Extra", "2021-01-10")
    )
    drugs = cases.drug_records(medications, visits)
    assert rows(drugs, "subject", "episode", "timepoint", "visit_rows") == [
        (1, "M1", "Dose 1", 1), (1, "M1", "Extra", 2), (1, "M2", None, 1), (2, "M1", None, 1), (2, "M2", None, 1),
    ]
    treated = cases.treatment_cases(drugs)
    assert rows(cases.ongoing_treatment(drugs), "subject", "episode") == [(1, "M2"), (2, "M1"), (2, "M2")]
    placed = cases.with_last_dose(treated, vaccination, "first_entry")
    # On the day of a dose that dose counts; before every dose there is none.
    assert rows(placed, "subject", "episode", "last_dose", "days_since") == [
        (1, "M1", "Dose 1", 0), (1, "M1", "Dose 1", 0), (1, "M2", "2B0", 10), (2, "M1", None, None),
    ]
    table = [tuple(r) for r in cases.dose_shares(treated, vaccination, "first_entry", weight="visit_rows").collect()]
    assert table == [("Dose 1", 3, "60%"), ("2B0", 1, "20%"), (None, 1, "20%"), ("Total", 5, "100%")]
    unweighted = [tuple(r) for r in cases.dose_shares(treated, vaccination, "first_entry").collect()]
    assert unweighted[0] == ("Dose 1", 2, "50%")


def test_totals_add_rounded_percentages(frame, vaccination):
    df = frame("subject long, d date", (1, "2021-01-10"), (1, "2021-02-10"), (1, "2021-03-10"))
    table = [tuple(r) for r in cases.dose_shares(df, vaccination, "d").collect()]
    assert table[-1] == ("Total", 3, "99%")
    one_digit = [tuple(r) for r in cases.dose_shares(df, vaccination, "d", digits=1).collect()]
    assert one_digit[0][2] == "33.3%" and one_digit[-1][2] == "99.9%"


FILMS = "subject long, visit string, episode string, sample_date date, sample_type string, film_result string, rdt_result string, first_entry date"


@pytest.fixture(scope="module")
def films(frame):
    return frame(
        FILMS,
        (1, CASE, "E1", "2021-01-01", FILM, "Positive", None, "2021-01-01"),      # before every dose
        (1, CASE, "E2", "2021-02-20", FILM, "Positive", None, "2021-02-20"),
        (1, CASE, "E3", "2021-03-20", FILM, "Positive", None, "2021-03-20"),
        (1, CASE, "E3", "2021-03-20", RDT, None, RDT_POSITIVE, "2021-03-20"),
        (1, CASE, "E4", "2021-04-20", FILM, FILM_NEGATIVE, None, "2021-04-20"),
        (2, CASE, "E1", "2021-01-10", FILM, "Positive", None, "2021-01-10"),      # two doses that day
        (2, "Day 14", "E1", "2021-01-11", FILM, "Positive", None, "2021-01-11"),
        (2, CASE, "E2", "2021-01-12", FILM, None, None, "2021-01-12"),
        (3, CASE, "E1", "2021-01-12", FILM, "Positive", None, "2021-01-12"),      # never dosed
    )


def test_film_cases(films, vaccination):
    numbered = cases.numbered_cases(films, vaccination)
    assert rows(numbered, "subject", "episode", "last_dose", "case_number_all", "case_number") == [
        (1, "E2", "Dose 2", "MLR-2", "MLR-1"), (1, "E3", "2B0", "MLR-3", "MLR-2"), (2, "E1", "Dose 1", "MLR-1", "MLR-1"),
    ]
    assert [tuple(r) for r in cases.case_number_table(films, vaccination).select("case_number", "n", "percentage").collect()] == [
        ("MLR-1", 2, "66.7%"), ("MLR-2", 1, "33.3%"), ("Total", 3, "100%"),
    ]
    shares = cases.dose_shares(cases.positive_films(films), vaccination, "sample_date", 1, matched_only=True)
    assert [tuple(r) for r in shares.collect()][-1] == ("Total", 3, "99.9%")
    assert rows(cases.film_rdt_overlap(films.union(films.filter("rdt_result is not null"))), "subject", "episode", "rdt_rows") == [(1, "E3", 2)]


def test_medications(frame, medications):
    visits = frame(
        "subject long, visit string, visit_date date, first_entry date", (1, "Dose 1", "2021-01-10", "2021-01-10"), (2, "Dose 1", "2021-01-09", "2021-01-09"),
    )
    forms = frame(
        "subject long, visit string, visit_date date, entry_status string, entered_by string", (1, "Dose 1", "2021-01-10", "Complete", "Ann"),
        (2, "Dose 1", "2021-01-09", "Complete", "Bob"),
    )
    repeated = medications.union(medications.filter("subject = 1 and episode = 'M1'"))
    no_indication = frame(MEDS, (4, "Logs", None, "M1", "x", "B", None, None, None, None, None, None), (4, "Logs", "x", None, "x", "B", None, None, None, None, None, None))
    clean = meds.clean_medications(repeated.union(no_indication), records.visit_entries(visits, forms))
    assert rows(clean, "subject", "episode", "visit", "entered_by") == [
        (1, "M1", "Dose 1", "Ann"), (1, "M2", None, "Name missing"), (2, "M1", "Dose 1", "Bob"), (2, "M2", None, "Name missing"),
        (2, "M3", None, "Name missing"), (3, "M1", None, "Name missing"),
    ]
    assert rows(meds.open_closed(clean)) == [("Closed", 1), ("Open", 5), ("Total", 6)]
    opened = meds.open_medications(clean, ["Ann"])
    assert rows(opened, "subject", "owner", "staff")[1] == (2, "Name missing", "Name missing")
    assert rows(meds.open_list(opened, "Other staff"), "subject", "staff") == [(2, "Bob")]
    summary = [tuple(r) for r in meds.open_summary(opened, date(2021, 2, 3)).collect()]
    # Two records are exactly 14 days old and do not count as long open.
    assert summary == [("Name missing", 4, None), ("Other staff", 1, 1)]
