from datetime import date

import pytest
from conftest import rows

from studyloom.fixed_values import CHEMISTRY_TESTS, FILM, HAEMATOLOGY_TESTS, LAB_RANGES
from studyloom.plans import extract, labs

AS_OF = date(2021, 6, 30)
LABS = "subject long, visit string, test string, result double, no_result_reason string, range_flag string, significance string, event_code string, first_entry date"


@pytest.fixture(scope="module")
def bloods(frame):
    return frame(
        "subject long, visit string, hem string, hem_date date, bio string, bio_date date, dbs string, dbs_date date",
        (1, "V1", "Yes", "2021-06-25", "Yes", None, "Yes", "2021-01-01"),     # recent through one date only
        (2, "V1", "Yes", "2021-06-01", "No", "2021-06-01", "Yes", "2021-06-01"),   # 29 days
        (3, "V1", "Yes", "2021-05-31", None, None, "No", None),              # 30 days: not this month
        (4, "V1", "No", None, "Yes", None, "Yes", "2021-08-01"),             # future passes
        (5, "V1", "Yes", None, "Yes", None, "Yes", None),                    # no date at all
        (5, "V1", "Yes", None, "Yes", None, "Yes", None),
    )


@pytest.fixture(scope="module")
def films(frame):
    return frame(
        "subject long, visit string, sample_type string, film_result string",
        (1, "V1", FILM, "Negative"), (1, "V1", FILM, "Positive"), (2, "V1", FILM, None), (4, "V1", "other", "Positive"),
    )


@pytest.fixture(scope="module")
def results(frame):
    def panel(subject, tests, **odd):
        return [(subject, "V1", t, odd.get(t, 1.0), None, None, None, None, "2021-06-26") for t in tests]

    data = panel(1, HAEMATOLOGY_TESTS + CHEMISTRY_TESTS)
    data += panel(2, HAEMATOLOGY_TESTS[:-1])
    # A stated reason is as good as a result.
    data += [(2, "V1", HAEMATOLOGY_TESTS[-1], None, "Clotted", None, None, None, "2021-06-26")]
    data += panel(3, HAEMATOLOGY_TESTS[1:])
    # Only the first result of a test counts, even when a later one is filled.
    data += panel(5, CHEMISTRY_TESTS[1:]) + [
        (5, "V1", CHEMISTRY_TESTS[0], None, None, None, None, None, "2021-06-01"),
        (5, "V1", CHEMISTRY_TESTS[0], 2.0, None, None, None, None, "2021-06-20"),
    ]
    return frame(LABS, *data)


def test_samples(bloods):
    counts = {(r.period, r.sample): r.n for r in labs.sample_counts(bloods, AS_OF).collect()}
    assert counts == {
        ("overall", "film"): 5, ("overall", "haematology"): 5, ("overall", "chemistry"): 4,
        ("month", "film"): 3, ("month", "haematology"): 2, ("month", "chemistry"): 2,
        ("week", "film"): 2, ("week", "haematology"): 1, ("week", "chemistry"): 2,
    }
    by_rows = labs.sample_rows(bloods, AS_OF).groupBy("period", "sample").count()
    assert {(r.period, r.sample): r["count"] for r in by_rows.collect()} == counts


def test_matrix(bloods, films, results):
    m = {r.measure: (r.film, r.haematology, r.chemistry, r.total) for r in labs.results_matrix(bloods, films, results, AS_OF).collect()}
    assert m == {
        "Expected overall": (5, 5, 4, 14), "Pending overall": (4, 3, 3, 10),
        "Expected this month": (3, 2, 2, 7), "Entered this month": (2, 2, 1, 5), "Pending this month": (2, 0, 1, 3),
        "Expected this week": (2, 1, 2, 5), "Entered this week": (2, 1, 1, 4), "Pending this week": (1, 0, 1, 2),
    }


def test_pending_and_entered_lists_agree_with_the_matrix(bloods, films, results):
    pending = labs.pending_results(bloods, films, results, AS_OF)
    assert rows(pending.filter("period = 'overall' and sample = 'haematology'"), "subject") == [(3,), (5,), (5,)]
    entered = labs.entered_results(bloods, films, results, AS_OF)
    for period, pend, ent in (("month", 3, 5), ("week", 2, 4)):
        assert pending.filter(f"period = '{period}'").count() == pend
        assert sum(r.results for r in entered.filter(f"period = '{period}'").collect()) == ent
    # Entered plus pending is what was expected, films with two results aside.
    one_film = films.filter("film_result = 'Negative'")
    counts = {(r.period, r.sample): r.n for r in labs.sample_counts(bloods, AS_OF).collect()}
    left = labs.pending_results(bloods, one_film, results, AS_OF).groupBy("period", "sample").count().collect()
    done = labs.entered_results(bloods, one_film, results, AS_OF).groupBy("period", "sample").count().collect()
    both = {}
    for r in left + done:
        both[(r.period, r.sample)] = both.get((r.period, r.sample), 0) + r["count"]
    assert both == counts


def test_reconcile(frame, bloods):
    results = frame(
        LABS, (1, "V1", "ALT", 20.0, None, None, None, None, None), (1, "V1", "MCV", 70.0, None, None, None, None, None),
        (2, "V1", "ALT", 20.0, None, None, None, None, None), (2, "V1", "MCV", None, "Clotted", None, None, None, None),
        (2, "V1", "WBC Count", None, None, None, None, None, None), (5, "V1", "ALT", 1.0, None, None, None, None, None),
    )
    system = frame(
        "subject string, sample_date date, test string, result string", ("1", "2021-06-25", "ALT", "20"), ("1", "2021-06-25", "MCV", "71"),
        ("2", "2021-06-02", "ALT", "20.0"), ("2", "2021-06-01", "WBC Count", "n/a"),
    )
    out = labs.reconcile(results, bloods, system)
    # Same day and value pass, a missing value matches a missing one, undated samples are not compared.
    assert rows(out, "subject", "test") == [(1, "MCV"), (2, "ALT")]
    twice = labs.reconcile(results, bloods.union(bloods), system)
    assert rows(twice, "subject", "test", "collection_rows") == [(1, "MCV", 2), (2, "ALT", 2)]
    assert rows(labs.mismatch_subjects(out)) == [(1, "V1"), (2, "V1")]


def _range(frame, *cases):
    results = frame(LABS, *[(i, v, t, x, why, flag, sig, code, "2021-06-15") for i, (v, t, x, why, flag, sig, code, _) in enumerate(cases)])
    births = frame("subject long, birth_date date", *[(i, c[-1]) for i, c in enumerate(cases)], *[(i, None) for i in range(3)])
    return {r.subject: r.query_text for r in labs.range_check(results, births).collect()}


def _born(months):
    total = 2021 * 12 + 5 - months
    return date(total // 12, total % 12 + 1, 15)


def test_range_bounds_and_bands(frame):
    cases, expected = [], {}
    for test, age_lo, age_hi, lo, hi in LAB_RANGES:
        for age in (age_lo, age_hi):
            for value, bad in ((lo, False), (hi, False), (lo - 0.001, True), (hi + 0.001, True)):
                if bad:
                    expected[len(cases)] = test
                cases.append(("V1", test, value, None, None, None, None, _born(age)))
    got = _range(frame, *cases)
    assert set(got) == set(expected)
    subject = {"Monocytes": "Monocytes value", "Eosinophils": "Eosinophils value", "Total Bilirubin": "Bilirubin"}
    assert all(got[i] == f"Review {subject.get(t, t)} and/ or range" for i, t in expected.items())


def test_range_outside_every_band(frame):
    ages = (0, 216)
    assert _range(frame, *[("V1", "ALT", 999.0, None, None, None, None, _born(a)) for a in ages]) == {}
    assert _range(frame, ("V1", "Creatinine", 999.0, None, None, None, None, _born(60))) == {}
    assert _range(frame, ("V1", "Other test", 999.0, None, None, None, None, _born(20))) == {}


def test_range_other_rules(frame):
    got = _range(
        frame,
        ("V1", "ALT", 999.0, "Clotted", None, None, None, _born(20)),             # a reason silences the range rule
        ("V1", "ALT", 999.0, None, "High", None, None, _born(20)),
        ("V1", "ALT", 999.0, None, "High", "Clinically Significant", None, _born(20)),
        ("V1", "ALT", 999.0, None, "High", "Clinically Significant", "E1", _born(20)),
        ("V1", "ALT", None, None, None, None, None, _born(20)),
        ("Screening", "ALT", 999.0, None, None, None, None, _born(20)),
        (None, "ALT", 999.0, None, None, None, None, _born(20)),
        ("V1", "ALT", 999.0, None, None, "Clinically Significant", None, _born(20)),
        ("V1", "ALT", 999.0, None, None, None, None, None),
    )
    assert got == {1: "Complete Clinical significance", 2: "Complete Event code", 7: "Review ALT and/ or range"}


def test_extra_samples(frame):
    df = frame(
        "collected string, sample_date date, test_category string, sample_type string, test string",
        ("Yes", "2021-06-01", "Micro", "Blood", "A"), ("Yes", "2021-05-30", None, "Blood", "A"), ("Yes", "2020-06-30", None, "Blood", "A"),
        ("Yes", "2020-06-29", None, "Blood", "A"), ("Yes", None, None, "Blood", "A"), ("No", "2021-06-01", "Micro", "Blood", "B"),
    )
    # 31 to 365 days are counted as within the year, a missing date as older.
    assert rows(labs.extra_sample_table(df, AS_OF)) == [("Blood", "A", 0, 2, 2), ("Micro", "A", 1, 0, 0), ("Total", "-", 1, 2, 2)]


def test_lab_extract(frame):
    from studyloom.fixed_values import CHEMISTRY_COLUMNS, HAEMATOLOGY_COLUMNS

    def table(columns, *data):
        schema = "serial_study_id long, date_collect date, fk_study int, " + ", ".join(f"{c} double" for c in columns)
        return frame(schema, *[(s, d, k, *[x] * len(columns)) for s, d, k, x in data])

    haem = table(HAEMATOLOGY_COLUMNS, (1, "2021-01-01", 1, 5.0), (1, "2021-01-01", 1, 5.0), (2, "2021-01-01", 1, 6.0), (3, "2021-01-01", 2, 7.0))
    chem = table(CHEMISTRY_COLUMNS, (1, "2021-01-01", 1, 8.0), (4, "2021-01-01", 1, None), (3, "2021-01-01", 2, 9.0))
    full = extract.lab_extract(haem, chem, 1)
    # Repeated rows collapse, unmatched rows keep their missing values.
    assert full.count() == 3 * 16
    assert {r.subject for r in full.collect()} == {1, 2, 4}
    assert full.filter("result is null").count() == 3 + 16
    left = extract.lab_extract(haem, chem, 1, mode="left")
    assert {r.subject for r in left.collect()} == {1, 2}
    assert rows(left.filter("subject = 1 and test = 'ALT'"), "result") == [(8.0,)]
    with pytest.raises(ValueError):
        extract.lab_extract(haem, chem, 1, mode="right")
