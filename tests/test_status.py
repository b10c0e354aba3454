from conftest import rows

from studyloom.plans import status


def test_consent(frame):
    p = frame(
        "subject long, group string, current_status string, site string, consent_v6 string, consent_v6_one string, consent_v6_two string,"
        " consent_v7 string, consent_v7_one string, consent_v7_two string",
        (1, "Group A", "On Active Follow up", "S", "Yes", "a", "b", None, None, None),
        (2, "Group A", "On Active Follow up", "S", None, None, None, "No", "c", None),
        (3, "Group B", "Loss to follow up", "S", "Yes", "d", "e", None, None, None),
    )
    assert rows(status.consent_counts(p, "v6")) == [("Pending", 1), ("Yes", 1)]
    assert rows(status.consent_list(p, "v6", "Yes")) == [(1, "Group A", "S", "a", "b")]
    assert rows(status.consent_list(p, "v7", "No")) == [(2, "Group A", "S", "c", None)]
    pending = status.consent_list(p, "v7", "Pending")
    assert pending.columns == ["subject", "group", "site", "current_status"]
    assert rows(pending) == [(1, "Group A", "S", "On Active Follow up")]
    table = {r.site: r for r in status.site_arm_table(p, active_only=True).collect()}
    assert table["Total"]["Group A"] == "100% (2)" and table["Total"]["Group B"] == "- (0)"
    full = {r.site: r for r in status.site_arm_table(p).collect()}
    assert full["S"]["Group B"] == "100% (1)"


def test_doses(frame):
    dosing = frame(
        "subject long, visit string", (1, "    Dose 1"), (2, "Dose 1"), (2, "Dose 2"), (3, "Dose 2"), (4, "Booster 2"), (None, "Dose 2")
    )
    vaccination = frame(
        "subject long, visit string, dose_date date", (1, "Dose 1", None), (2, "Dose 2", None), (4, "2B0 Vaccination", None)
    )
    table = [tuple(r) for r in status.dosed_vs_vaccinated(dosing, vaccination).collect()]
    # A padded name is outside the levels here and matches nothing.
    assert table == [("Dose 1", 1, 1), ("Dose 2", 3, 1), ("Booster 2", 1, 1), (None, 1, None)]
    # Padding is trimmed before doses are compared.
    assert rows(status.dosed_not_vaccinated(dosing, vaccination)) == [(2, "Dose 1"), (3, "Dose 2"), (None, "Dose 2")]
