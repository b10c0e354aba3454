"""Fixed values the results depend on. Rosters and id lists are parameters instead."""

# Dose names in order, and the column each one becomes.
DOSE_COLUMNS = {
    "Dose 1": "dose_1",
    "Dose 2": "dose_2",
    "Dose 3": "dose_3",
    "Booster": "booster",
    "2B0 Vaccination": "booster_2",
}

# Dose names used when a case is attributed to a dose.
CASE_DOSES = ["Dose 1", "Dose 2", "Dose 3", "Booster", "2B0"]

# Dose names of the dosing summary.
DOSING_LEVELS = ["Dose 1", "Dose 2", "Dose 3", "Booster", "Booster 2"]

# Codes and labels of the dose an adverse event followed.
POST_DOSE_CODES = ["1", "2", "3", "Booster 1", "Booster 2"]
POST_DOSE_LABELS = ["Dose 1", "Dose 2", "Dose 3", "Booster 1", "Booster 2"]

# Schedule visit codes in order.
VISIT_LEVELS = [
    "Day 14", "Day 28", "Day 42", "Day 56", "Day 70", "Day 84", "Day 140", "Day 196",
    "Day 236", "Day 292", "Day 348", "Day 404", "Day B0", "Day B14", "Day B28", "Day B84",
    "Day B140", "Day B168", "Day B224", "Day B280", "Day B336", "Reconsent", "Day B365/2B0",
    "Day 2B14", "Day 2B28", "Day 2B180", "Day 3B0", "Day 3B14", "Day 3B28", "Day 3B180",
    "Day 3B365",
]

# Visit names of the data queries and the schedule code they mean.
VISIT_CODE_MAP = {
    "Dose 2": "Day 28",
    "Dose 3": "Day 56",
    "Pre-Booster": "Day B0",
    "B 14": "Day B14",
    "B 28": "Day B28",
    "B 84": "Day B84",
    "B 140": "Day B140",
    "B 168": "Day B168",
    "B 224": "Day B224",
    "B 280": "Day B280",
    "B 336": "Day B336",
    "B1Y 0": "Day B365/2B0",
    "B 365": "Day B365/2B0",
    "2B 28": "Day 2B28",
    "2B 180": "Day 2B180",
}

# Visits at which no clinician enters events or medications.
FIELD_VISITS = [
    "Day 14", "Day 42", "Day 70", "Day 140", "Day 196", "Day 292", "Day 348", "Day 404",
    "B 14", "B 84", "B 140", "B 224", "B 280", "B 336",
]

# Visits with an immunology blood sample.
IMMUNOLOGY_VISITS = ["Day 2B180", "Day 3B0", "Day 3B28", "Day 3B180", "Day 3B365"]

# Follow-up statuses.
ACTIVE = "On Active Follow up"
COMPLETED = "Completed follow up"
LOST = "Loss to follow up"
WITHDRAWAL_STATUSES = [
    "Consent withdrawal",
    "Blood volume Issues",
    "Terminated due to dosing error",
    "Terminated due to PI discretion",
    "SAE resulting to death",
]

# Query statuses in display order.
QUERY_STATUS_LEVELS = ["Resolved", "Data Deleted", "CDM Override", "Answered", "Open Query"]

# Origins of a data query.
QUERY_TYPES = ["Automatic", "Manual"]

# Randomised arms.
ARMS = ["Group A", "Group B"]

# Severity grades of the event tables.
GRADES = ["Grade 1", "Grade 2", "Grade 3"]

# Cohort names and display labels.
COHORT_LABELS = {
    "full": "Screened",
    "screened": "screened",
    "earlier_vaccine": "Previous Malaria Vaccination",
    "birth_defect": " Has Major congenital defects",
    "underweight": "Malnourished and requiring admission",
    "long_illness": "Clinically significant Acute illnesses",
    "recent_vaccine": "Received a Vaccine within 30 days",
    "immune_condition": "Significant Disease Disorder",
    "closure": "Closure of enrolment",
    "early_withdrawal": "Consent withdrawal pre-randomization",
    "randomized": "Randomized",
    "excluded": "Excluded",
    "vacc1": "Enrolled",
    "enr": "Enrolled participants",
    "group_a_enr": "Group A enrolled",
    "group_b_enr": "Group B enrolled",
    "recvac1": "Received Vacc1",
    "vac_grp_a": "Vac1 Group A",
    "vac_grp_b": "Vac1 Group B",
    "vac2_grp_a": "Vac2 Group A",
    "vac2_grp_b": "Vac2 Group B",
    "vac3_grp_a": "Vac3 Group A",
    "vac3_grp_b": "Vac3 Group B",
    "vac4_grp_a": "Booster Group A",
    "vac4_grp_b": "Booster Group B",
    "vacc2": "Received Vacc2",
    "vacc3": "Received Vacc3",
    "vacc4": "Received Booster",
    "vacc5": "Received 2nd Booster",
    "vac5_grp_a": "2B0 Group A",
    "vac5_grp_b": "2B0 Group B",
    "rand_no_enr": "Randomized but not enrolled",
    "on_active_fu": "On follow up",
    "active_a": "Group A active",
    "active_b": "Group B active",
    "withdrawal": "Withdrawals",
    "ltf_a": "Group A LTF",
    "ltf_b": "Group B LTF",
    "withdrawal_a": "Group A Withdrawals",
    "withdrawal_b": "Group B Withdrawals",
    "pi_discretion": "Moved outside study area",
    "consent_withdrawal": "Known Consent withdrawals",
    "blood_volume": "Issues with Blood volume",
    "vac_error": "Dosing error termination",
    "fup_done": "Completed Follow up",
    "ltfup": "Loss to follow up",
    "sae_death": "SAE resulting to death",
    "consent_v6_yes": "Consent V6 Accept",
    "v6_a": "V6 Group A",
    "v6_b": "V6 Group B",
    "consent_v6_no": "Consent V6 Decline",
    "consent_v6_yet": "Consent V6 Pending",
    "consent_v7_yes": "Consent V7 Accept",
    "v7_a": "V7 Group A",
    "v7_b": "V7 Group B",
    "consent_v7_no": "Consent V7 Decline",
    "consent_v7_yet": "Consent V7 Pending",
}

# Statuses shown on the end-of-study list.
EXCLUDED_STATUS = "Excluded before rand"
NOT_ENROLLED_STATUS = "Randomized not enrolled"

# Medical dictionary codes of chronic conditions (two lists differ by one code).
CHRONIC_CODES = [10040644, 10040641, 10040642, 10061273, 10022016, 10043348, 10062061, 10039906]
CHRONIC_CODES_CLOSURE = [10040644, 10040641, 10040642, 10061273, 10022016, 10043348, 10062061]

# Outcomes after which an adverse event needs no more work.
CLOSED_OUTCOMES = ["Recovered / Resolved without sequelae", "Fatal", "Lost to follow-up / Unknown"]
RECOVERING = "Recovering / Resolving"

# Wording of blood film and rapid test records.
FILM = "Blood film for Plasmodium species"
RDT = "A P. falciparum rapid diagnosis test (RDT)"
FILM_NEGATIVE = "Negative for Plasmodium species"
RDT_POSITIVE = "Positive for Plasmodium falciparum"
CASE_VISIT = "Malaria case report"

# Tests of the two laboratory panels.
HAEMATOLOGY_TESTS = [
    "Platelet Count", "Haemoglobin", "Haematocrit", "RBC Count", "MCV", "WBC Count", "Neutrophils",
    "Lymphocytes", "Monocytes", "Eosinophils", "Basophils", "Neutrophils (%)", "Lymphocytes (%)",
]
CHEMISTRY_TESTS = ["Total Bilirubin", "Creatinine", "ALT"]

# Laboratory system columns and the test each one holds.
HAEMATOLOGY_COLUMNS = {
    "wbc": "WBC Count",
    "rbc": "RBC Count",
    "hgb": "Haemoglobin",
    "hct": "Haematocrit",
    "mcv": "MCV",
    "plt": "Platelet Count",
    "ne": "Neutrophils (%)",
    "ly": "Lymphocytes (%)",
    "mo_1": "Monocytes",
    "eo_1": "Eosinophils",
    "ba_1": "Basophils",
    "ne_1": "Neutrophils",
    "ly_1": "Lymphocytes",
}
CHEMISTRY_COLUMNS = {"ALT": "ALT", "T_Bilirubin": "Total Bilirubin", "Plasma_Creatinine": "Creatinine"}

# Fixed values: (test, youngest and oldest age in months, lowest and highest
# normal result); all four bounds belong to the range.
LAB_RANGES = [
    ("Monocytes", 1, 5, 0.29, 1.9), ("Monocytes", 6, 11, 0.3, 1.86),
    ("Monocytes", 12, 59, 0.21, 1.42), ("Monocytes", 60, 215, 0.15, 0.58),
    ("Eosinophils", 1, 5, 0.07, 0.71), ("Eosinophils", 6, 11, 0.06, 1.11),
    ("Eosinophils", 12, 59, 0.07, 1.07), ("Eosinophils", 60, 215, 0.04, 0.50),
    ("Platelet Count", 1, 5, 52.0, 752.0), ("Platelet Count", 6, 11, 89.0, 789.0),
    ("Platelet Count", 12, 59, 139.0, 730.0), ("Platelet Count", 60, 215, 159.0, 451.0),
    ("Creatinine", 1, 5, 26.0, 43.0), ("Creatinine", 6, 11, 25.0, 45.0),
    ("Creatinine", 12, 59, 25.0, 48.0),
    ("ALT", 1, 5, 7.18, 34.83), ("ALT", 6, 11, 9.98, 33.03), ("ALT", 12, 215, 11.0, 35.0),
    ("Total Bilirubin", 1, 215, 2.0, 9.0),
    ("WBC Count", 1, 5, 5.1, 14.9), ("WBC Count", 6, 11, 6.0, 17.2),
    ("WBC Count", 12, 59, 5.1, 16.3), ("WBC Count", 60, 215, 3.8, 8.8),
    ("Haemoglobin", 1, 5, 8.1, 14.0), ("Haemoglobin", 6, 11, 7.2, 11.5),
    ("Haemoglobin", 12, 59, 7.6, 12.2), ("Haemoglobin", 60, 215, 10.4, 14.7),
    ("Haematocrit", 1, 5, 24.6, 42.1), ("Haematocrit", 6, 11, 23.7, 35.8),
    ("Haematocrit", 12, 59, 25.7, 37.3), ("Haematocrit", 60, 215, 32.3, 44.4),
    ("RBC Count", 1, 5, 2.85, 5.34), ("RBC Count", 6, 11, 3.80, 5.78),
    ("RBC Count", 12, 59, 3.84, 5.92), ("RBC Count", 60, 215, 3.93, 5.91),
    ("MCV", 1, 5, 57.0, 100.0), ("MCV", 6, 11, 52.0, 78.0),
    ("MCV", 12, 59, 52.0, 82.0), ("MCV", 60, 215, 64.0, 90.0),
    ("Basophils", 1, 5, 0.01, 0.13), ("Basophils", 6, 11, 0.01, 0.3),
    ("Basophils", 12, 59, 0.01, 0.25), ("Basophils", 60, 215, 0.02, 0.1),
    ("Neutrophils", 1, 5, 0.57, 4.03), ("Neutrophils", 6, 11, 0.98, 4.38),
    ("Neutrophils", 12, 59, 1.12, 5.27), ("Neutrophils", 60, 215, 1.03, 5.04),
    ("Lymphocytes", 1, 5, 3.12, 9.44), ("Lymphocytes", 6, 11, 3.39, 11.00),
    ("Lymphocytes", 12, 59, 2.5, 10.39), ("Lymphocytes", 60, 215, 1.5, 4.09),
    ("Neutrophils (%)", 1, 5, 9.1, 35.1), ("Neutrophils (%)", 6, 11, 10.2, 38.5),
    ("Neutrophils (%)", 12, 59, 12.8, 51.8), ("Neutrophils (%)", 60, 215, 24.4, 60.8),
    ("Lymphocytes (%)", 1, 5, 44.2, 78.0), ("Lymphocytes (%)", 6, 11, 44.2, 77.6),
    ("Lymphocytes (%)", 12, 59, 36.9, 74.8), ("Lymphocytes (%)", 60, 215, 26.4, 65.5),
]

# Query wording; tests not listed use their own name.
RANGE_QUERY_SUBJECT = {
    "Monocytes": "Monocytes value",
    "Eosinophils": "Eosinophils value",
    "Total Bilirubin": "Bilirubin",
}
MISSING_SIGNIFICANCE_TEXT = "Complete Clinical significance"
MISSING_CODE_TEXT = "Complete Event code"
SIGNIFICANT = "Clinically Significant"
