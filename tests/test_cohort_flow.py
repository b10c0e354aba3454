import pytest
from conftest import rows

from studyloom.plans import cohort_flow, status

FLAGS = "earlier_vaccine string, birth_defect string, underweight string, long_illness string, recent_vaccine string, immune_condition string, other string, details string"


@pytest.fixture(scope="module")
def listings(frame):
    def row(subject, visit="Screening", **flags):
        names = [p.split()[0] for p in FLAGS.split(", ")]
        return (subject, visit, *[flags.get(n) for n in names])

    eligibility = frame(
        f"subject long, visit string, {FLAGS}",
        row(1, earlier_vaccine="Yes"),
        row(1, birth_defect="Yes", earlier_vaccine="Yes"),
        row(1, birth_defect="Yes"),
        row(2, earlier_vaccine="Yes"),                      # randomised: stays
        row(3, recent_vaccine="Yes"),                           # randomised, flag alone still excludes
        row(4, details="had a vaccine"),                 # randomised, text does not exclude
        row(5, details="had a vaccine"),
        row(6, immune_condition="Yes"),                          # randomised
        row(7, details="HIV care"),
        row(8, other="Closure of enrolment"),
        row(9, other="Consent withdrawal"),
        row(10), row(11), row(12, visit=None), row(13),
        row(999, earlier_vaccine="Yes"),                    # test subject
    )
    vaccination = frame(
        "subject long, visit string, dose_date date",
        (2, "Dose 1", "2021-01-01"), (2, "Dose 2", "2021-02-01"), (10, "Dose 1", "2021-01-05"),
        (10, "2B0 Vaccination", "2022-01-05"), (12, "Dose 1", "2021-01-05"),
    )
    participants = frame(
        "subject long, group string, current_status string, site string, consent_v6 string, consent_v7 string",
        (2, "Group A", "On Active Follow up", "S1", "Yes", None),
        (10, "Group B", "Loss to follow up", "S1", None, "No"),
        (11, "Group B", "Consent withdrawal", None, "No", None),
        (1, "Group A", "Consent withdrawal", "S2", None, None),
        (12, "Group A", "On Active Follow up", "S1", "Yes", "Yes"),
    )
    randomisation = frame(
        "subject long, rand string", (2, "R2"), (3, "R3"), (4, "R4"), (6, "R6"), (10, "R10"), (11, "R11"), (12, "R12"), (13, None)
    )
    return eligibility, vaccination, participants, randomisation


@pytest.fixture(scope="module")
def base(listings):
    return cohort_flow.analysis_base(*listings, [999])


def flow(base, **kwargs):
    return {r.cohort: r.n for r in cohort_flow.flow_counts(base, 9, **kwargs).collect()}


def test_flow(base):
    n = flow(base)
    assert n["full"] == 15 and n["screened"] == 14
    # Subject 1 leaves at the first reason; its third row is not counted for the second.
    assert n["earlier_vaccine"] == 2 and n["birth_defect"] == 0
    assert n["closure"] == 1 and n["early_withdrawal"] == 1
    assert n["excluded"] == 9 and n["randomized"] == 5
    assert n["excluded"] + n["randomized"] == n["screened"]
    assert n["vacc1"] == 2 and n["vac_grp_a"] == 1 and n["vac_grp_b"] == 1 and n["vacc5"] == 1
    assert n["rand_no_enr"] == 3  # subjects 4, 11 and 13
    assert n["on_active_fu"] == 1 and n["ltf_b"] == 1
    assert n["withdrawal"] == 4 and n["withdrawal_a"] == 3 and n["consent_withdrawal"] == 4
    assert n["consent_v6_yes"] == 1 and n["consent_v6_no"] == 1 and n["consent_v7_yet"] == 1


def test_yes_alone_excludes_even_when_randomised(base):
    assert flow(base)["recent_vaccine"] == 2 and flow(base)["immune_condition"] == 2
    strict = flow(base, strict=True)
    assert strict["recent_vaccine"] == 1 and strict["immune_condition"] == 1
    assert strict["randomized"] == 7


def test_text(base):
    text = {r.cohort: r.text for r in cohort_flow.flow_counts(base, 9).collect()}
    assert text["vacc1"] == "Enrolled (n = 2)"
    assert len(text) == 57


def test_required_end_of_study(listings, frame):
    required = cohort_flow.required_eos(*listings, [999])
    got = rows(required, "subject", "current_status", "time")
    assert got.count((1, "Excluded before rand", "After Enr")) == 3
    assert got.count((1, "Consent withdrawal", "After Enr")) == 3
    assert (11, "Randomized not enrolled", "Before Enr") in got and (11, "Consent withdrawal", "Before Enr") in got
    assert (10, "Loss to follow up", "After Enr") in got
    assert not [g for g in got if g[0] in (2, 12)]
    summary = status.required_eos_summary(required).collect()
    assert summary[-1].current_status == "Total"
    assert summary[-1].total == len(got) == summary[-1].before_enr + summary[-1].after_enr
    done = frame("subject long, completion_date date", (1, "2021-05-01"), (77, "2021-05-01"))
    assert {r.subject for r in status.eos_pending(required, done).collect()} == {g[0] for g in got} - {1}
    assert rows(status.eos_not_required(done, required), "subject") == [(77,)]


@pytest.mark.parametrize("strict", [False, True])
def test_required_rows_are_those_of_the_analysis_base(listings, frame, strict):
    """Also where subjects are listed several times, without a number and with one, or not at all."""
    eligibility, vaccination, participants, randomisation = listings
    blank = (None,) * (len(eligibility.columns) - 2)
    eligibility = eligibility.union(frame(eligibility.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), (None, "Screening", "Yes", *blank[1:]), (14, "Screening", *blank)))
    randomisation = randomisation.union(frame("subject long, rand string", (2, "R2b"), (1, None), (1, "R1"), (5, "R5"), (5, None), (None, "R0")))
    participants = participants.union(participants.filter("subject in (1, 11)"))
    base = cohort_flow.analysis_base(eligibility, vaccination, participants, randomisation, [999]).filter("visit is not null")
    reasons = cohort_flow.exclusion_reasons(strict)
    first, dosed = {}, set()
    from studyloom.operators.cohort import reason_index

    placed = base.withColumn("i", reason_index(reasons)).collect()
    for r in placed:
        first[r.subject] = min([x for x in (first.get(r.subject), r.i) if x is not None], default=None)
        dosed |= {r.subject} if r.dose_1 else set()
    expected = []
    for r in placed:
        tags = ["Excluded before rand"] if first[r.subject] is not None else [] if r.subject in dosed else ["Randomized not enrolled"]
        tags += [r.current_status] if r.current_status in ("Loss to follow up", "Completed follow up", "Consent withdrawal") else []
        expected += [(r.subject, r.group, r.other, t, r.site) for t in tags]
    got = cohort_flow.required_eos(eligibility, vaccination, participants, randomisation, [999], strict)
    key = lambda r: repr(r)
    assert sorted(map(tuple, got.select("subject", "group", "other", "current_status", "site").collect()), key=key) == sorted(expected, key=key)
