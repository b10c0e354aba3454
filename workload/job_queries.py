"""One query per study job, on listings derived from the driver tables."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from studyloom.fixed_values import (
    CHEMISTRY_COLUMNS,
    COHORT_LABELS,
    DOSING_LEVELS,
    HAEMATOLOGY_COLUMNS,
    HAEMATOLOGY_TESTS,
    IMMUNOLOGY_VISITS,
    LAB_RANGES,
    RANGE_QUERY_SUBJECT,
    VISIT_CODE_MAP,
    VISIT_LEVELS,
)
from studyloom.plans import (
    cases,
    cohort_flow,
    extract,
    labs,
    meds,
    quality,
    records,
    safety,
    schedule,
    status,
)
from studyloom.operators.joins import split_by_team
from studyloom.session import shared_dir
from studyloom.sources import load, read_lab_tables, read_run, update_extract, write_run
from studyloom.sources.labdb import CHEMISTRY_TABLE, HAEMATOLOGY_TABLE
from studyloom.sources.listings import LISTINGS, clean, conform
from workload.registry import AS_OF, EVENTS_AS_OF, query

DAY = "DATE '2001-01-01'"
EVENT_DAY = "DATE '2024-02-01'"
ARM = 700


def quoted(values) -> str:
    return ", ".join("'" + str(v) + "'" for v in values)


# ------------------------------------------------------- participant flow


def _required(L):
    return cohort_flow.required_eos(L.eligibility, L.vaccination, L.participants, L.randomisation)


def _base(L):
    return cohort_flow.analysis_base(L.eligibility, L.vaccination, L.participants, L.randomisation)


def _flow_sql(strict: bool = False) -> str:
    either = {
        True: "({flag} = 'Yes' OR contains(details, '{word}')) AND rand IS NULL",
        False: "{flag} = 'Yes' OR (contains(details, '{word}') AND rand IS NULL)",
    }[strict]
    reasons = {
        "earlier_vaccine": "earlier_vaccine = 'Yes' AND rand IS NULL",
        "birth_defect": "birth_defect = 'Yes' AND rand IS NULL",
        "underweight": "underweight = 'Yes' AND rand IS NULL",
        "long_illness": "long_illness = 'Yes' AND rand IS NULL",
        "recent_vaccine": either.format(flag="recent_vaccine", word="vaccine"),
        "immune_condition": either.format(flag="immune_condition", word="HIV"),
        "closure": "other = 'Closure of enrolment' AND rand IS NULL",
        "early_withdrawal": "other = 'Consent withdrawal' AND rand IS NULL",
    }
    dose = "max(CASE WHEN visit = '{0}' THEN '{0}' END) AS {1}"
    doses = ", ".join(
        dose.format(v, c)
        for v, c in {
            "Dose 1": "dose_1", "Dose 2": "dose_2", "Dose 3": "dose_3", "Booster": "booster",
            "2B0 Vaccination": "booster_2",
        }.items()
    )
    parts = [
        f"d AS (SELECT subject, {doses} FROM {{vaccination}} GROUP BY subject)",
        """b AS (SELECT e.*, d.* EXCLUDE (subject), p.* EXCLUDE (subject), r.rand FROM {eligibility} e
            LEFT JOIN d ON e.subject = d.subject LEFT JOIN {participants} p ON e.subject = p.subject
            LEFT JOIN {randomisation} r ON e.subject = r.subject)""",
        "a0 AS (SELECT * FROM b WHERE visit IS NOT NULL)",
    ]
    for i, (name, test) in enumerate(reasons.items()):
        parts.append(f"x_{name} AS (SELECT * FROM a{i} WHERE {test})")
        parts.append(f"a{i + 1} AS (SELECT * FROM a{i} WHERE subject NOT IN (SELECT subject FROM x_{name}))")
    parts.append("gone AS (SELECT * FROM a0 WHERE subject NOT IN (SELECT subject FROM a8))")
    parts.append(
        "noenr AS (SELECT * FROM a8 WHERE subject NOT IN (SELECT subject FROM a0 WHERE dose_1 IS NOT NULL))"
    )
    return "WITH " + ",\n".join(parts)


def _flow_counts_sql(strict: bool = False) -> str:
    a, b = f"subject <= {ARM}", f"subject > {ARM}"
    active = "current_status = 'On Active Follow up'"
    withdrawn = (
        "current_status IN ('Consent withdrawal', 'Blood volume Issues', 'Terminated due to dosing error',"
        " 'Terminated due to PI discretion', 'SAE resulting to death')"
    )
    tests = {
        "vacc1": "dose_1 IS NOT NULL", "vac_grp_a": f"dose_1 IS NOT NULL AND {a}",
        "vac_grp_b": f"dose_1 IS NOT NULL AND {b}", "enr": "dose_1 IS NOT NULL",
        "group_a_enr": f"dose_1 IS NOT NULL AND {a}", "group_b_enr": f"dose_1 IS NOT NULL AND {b}",
        "recvac1": "dose_1 IS NOT NULL",
    }
    for n, col in (("2", "dose_2"), ("3", "dose_3"), ("4", "booster"), ("5", "booster_2")):
        tests[f"vacc{n}"] = f"{col} IS NOT NULL"
        tests[f"vac{n}_grp_a"] = f"{col} IS NOT NULL AND {a}"
        tests[f"vac{n}_grp_b"] = f"{col} IS NOT NULL AND {b}"
    tests |= {
        "on_active_fu": active, "active_a": f"{active} AND {a}", "active_b": f"{active} AND {b}",
        "pi_discretion": "current_status = 'Terminated due to PI discretion'",
        "consent_withdrawal": "current_status = 'Consent withdrawal'",
        "blood_volume": "current_status = 'Blood volume Issues'",
        "vac_error": "current_status = 'Terminated due to dosing error'",
        "fup_done": "current_status = 'Completed follow up'",
        "ltfup": "current_status = 'Loss to follow up'", "ltf_a": f"current_status = 'Loss to follow up' AND {a}",
        "ltf_b": f"current_status = 'Loss to follow up' AND {b}",
        "sae_death": "current_status = 'SAE resulting to death'",
        "withdrawal": withdrawn, "withdrawal_a": f"{withdrawn} AND {a}", "withdrawal_b": f"{withdrawn} AND {b}",
    }
    for v in ("v6", "v7"):
        col = f"consent_{v}"
        tests |= {
            f"{col}_yes": f"{col} = 'Yes'", f"{v}_a": f"{col} = 'Yes' AND {a}", f"{v}_b": f"{col} = 'Yes' AND {b}",
            f"{col}_no": f"{col} = 'No'", f"{col}_yet": f"{col} IS NULL AND {active}",
        }
    sources = {"full": "b", "screened": "a0", "randomized": "a8", "excluded": "gone", "rand_no_enr": "noenr"}
    sources |= {
        n: f"x_{n}"
        for n in (
            "earlier_vaccine", "birth_defect", "underweight", "long_illness", "recent_vaccine", "immune_condition", "closure",
            "early_withdrawal",
        )
    }
    rows = [f"SELECT '{n}' AS cohort, count(*) AS n FROM {s}" for n, s in sources.items()]
    rows += [f"SELECT '{n}', count(*) FROM a0 WHERE {t}" for n, t in tests.items()]
    labels = ", ".join(f"('{n}', '{label}')" for n, label in COHORT_LABELS.items())
    return (
        f"{_flow_sql(strict)}, c AS ({' UNION ALL '.join(rows)}), l(cohort, label) AS (VALUES {labels})\n"
        "SELECT cohort, n, label, label || ' (n = ' || n || ')' AS text FROM c JOIN l USING (cohort)"
    )


@query("cohort_flow_counts", _flow_counts_sql())
def cohort_flow_counts(L):
    return cohort_flow.flow_counts(_base(L), ARM)


@query("cohort_flow_counts_strict", _flow_counts_sql(True))
def cohort_flow_counts_strict(L):
    return cohort_flow.flow_counts(_base(L), ARM, strict=True)


_REQUIRED = (
    _flow_sql()
    + """, u AS (SELECT subject, "group", other, 'Excluded before rand' AS current_status, site FROM gone
    UNION ALL SELECT subject, "group", other, 'Randomized not enrolled', site FROM noenr
    UNION ALL SELECT subject, "group", other, current_status, site FROM a0
        WHERE current_status IN ('Loss to follow up', 'Completed follow up')
    UNION ALL SELECT subject, "group", other, current_status, site FROM a0
        WHERE current_status IN ('Consent withdrawal', 'Blood volume Issues', 'Terminated due to dosing error',
            'Terminated due to PI discretion', 'SAE resulting to death')),
    req AS (SELECT *, CASE WHEN site IS NULL THEN 'Before Enr' ELSE 'After Enr' END AS time FROM u)
    """
)


@query("required_eos", _REQUIRED + "SELECT * FROM req")
def required_eos(L):
    return _required(L)


@query(
    "required_eos_summary",
    _REQUIRED
    + """, t AS (SELECT current_status, time FROM req UNION ALL SELECT 'Total', time FROM req)
    SELECT current_status, nullif(count(*) FILTER (WHERE time = 'Before Enr'), 0) AS before_enr,
        nullif(count(*) FILTER (WHERE time = 'After Enr'), 0) AS after_enr, count(*) AS total FROM t GROUP BY 1""",
)
def required_eos_summary(L):
    return status.required_eos_summary(_required(L))


@query("eos_pending", _REQUIRED + "SELECT * FROM req WHERE subject NOT IN (SELECT subject FROM {end_of_study})")
def eos_pending(L):
    return status.eos_pending(_required(L), L.end_of_study)


@query(
    "eos_not_required", _REQUIRED + "SELECT * FROM {end_of_study} WHERE subject NOT IN (SELECT subject FROM req)"
)
def eos_not_required(L):
    return status.eos_not_required(L.end_of_study, _required(L))


# ----------------------------------------------------------------- status


def _cell(row: str, test: str, name: str) -> str:
    """A cross-tab cell: missing where 0, but for the total row."""
    n = f"count(*) FILTER (WHERE {test})"
    return f"""CASE WHEN {row} = 'Total' THEN {n} ELSE nullif({n}, 0) END AS "{name}\""""


def _site_arm_sql(where: str) -> str:
    return f"""WITH p0 AS (SELECT site, "group" AS g FROM {{participants}} {where}),
    t AS (SELECT * FROM p0 UNION ALL SELECT 'Total', g FROM p0),
    c AS (SELECT site, count(*) FILTER (WHERE g = 'Group A') AS a, count(*) FILTER (WHERE g = 'Group B') AS b,
        count(*) FILTER (WHERE g NOT IN ('Group A', 'Group B')) AS o, count(*) FILTER (WHERE g IS NULL) AS m,
        count(*) AS n FROM t GROUP BY 1),
    w AS (SELECT a AS wa, b AS wb, o AS wo, m AS wm, n AS wn FROM c WHERE site = 'Total')
    SELECT site, round(a * 100 / wa)::BIGINT || '% (' || a || ')' AS "Group A",
        round(b * 100 / wb)::BIGINT || '% (' || b || ')' AS "Group B",
        coalesce(round(o * 100 / nullif(wo, 0))::BIGINT || '%', '-') || ' (' || o || ')' AS "Other",
        coalesce(round(m * 100 / nullif(wm, 0))::BIGINT || '%', '-') || ' (' || m || ')' AS "NA",
        round(n * 100 / wn)::BIGINT || '% (' || n || ')' AS "Total" FROM c, w"""


@query("site_arm_enrolled", _site_arm_sql(""))
def site_arm_enrolled(L):
    return status.site_arm_table(L.participants, ["Group A", "Group B"])


@query("site_arm_active", _site_arm_sql("WHERE current_status = 'On Active Follow up'"))
def site_arm_active(L):
    return status.site_arm_table(L.participants, ["Group A", "Group B"], active_only=True)


@query(
    "consent_counts",
    """SELECT coalesce(consent_v6, 'Pending') AS consent_v6, count(*) AS count FROM {participants}
    WHERE current_status = 'On Active Follow up' GROUP BY 1""",
)
def consent_counts(L):
    return status.consent_counts(L.participants, "v6")


@query(
    "consent_refused",
    """SELECT subject, "group", site, consent_v7_one, consent_v7_two FROM {participants}
    WHERE current_status = 'On Active Follow up' AND consent_v7 = 'No'""",
)
def consent_refused(L):
    return status.consent_list(L.participants, "v7", "No")


@query(
    "consent_pending",
    """SELECT subject, "group", site, current_status FROM {participants}
    WHERE current_status = 'On Active Follow up' AND consent_v6 IS NULL""",
)
def consent_pending(L):
    return status.consent_list(L.participants, "v6", "Pending")


@query(
    "dosed_vs_vaccinated",
    f"""WITH d AS (SELECT CASE WHEN visit IN ({quoted(DOSING_LEVELS)}) THEN visit END AS visit, count(*) AS dosed
        FROM {{dosing}} GROUP BY 1),
    v AS (SELECT CASE WHEN visit = '2B0 Vaccination' THEN 'Booster 2' ELSE visit END AS visit, count(*) AS vaccinated
        FROM {{vaccination}} GROUP BY 1)
    SELECT d.visit, dosed, vaccinated FROM d LEFT JOIN v ON d.visit IS NOT DISTINCT FROM v.visit""",
)
def dosed_vs_vaccinated(L):
    return status.dosed_vs_vaccinated(L.dosing, L.vaccination)


@query(
    "dosed_not_vaccinated",
    """SELECT subject, trim(visit) AS visit FROM {dosing} d WHERE trim(visit) IN ('Dose 1', 'Dose 2') AND NOT EXISTS (
        SELECT 1 FROM {vaccination} v WHERE v.subject = d.subject AND v.visit = trim(d.visit))""",
)
def dosed_not_vaccinated(L):
    return status.dosed_not_vaccinated(L.dosing, L.vaccination)


# --------------------------------------------------------------- schedule


@query(
    "visit_table",
    f"""WITH s AS (SELECT *, CASE WHEN visit_code IN ({quoted(VISIT_LEVELS)}) THEN visit_code END AS code FROM {{schedule}}),
    c AS (SELECT code, count(*) FILTER (WHERE scheduled_date <= {DAY} OR exact_date IS NOT NULL) AS scheduled,
        nullif(count(*) FILTER (WHERE exact_date IS NOT NULL), 0) AS actual,
        nullif(count(*) FILTER (WHERE scheduled_date <= {DAY} AND exact_date IS NULL AND window_close >= {DAY}), 0) AS due,
        nullif(count(*) FILTER (WHERE window_close < {DAY} AND exact_date IS NULL AND scheduled_date < {DAY}), 0) AS missed
        FROM s GROUP BY 1),
    k AS (SELECT *, round_even(actual * 100.0 / 15000, 0)::BIGINT || '%' AS actual_vs_enrolled FROM c WHERE scheduled > 0),
    t AS (SELECT * FROM k UNION ALL SELECT 'Total', sum(scheduled)::BIGINT, sum(actual)::BIGINT,
        coalesce(sum(due), 0)::BIGINT, coalesce(sum(missed), 0)::BIGINT, '-' FROM k)
    SELECT code AS visit_code, scheduled, actual, due, missed, actual_vs_enrolled,
        CAST(round_even(actual * 100.0 / scheduled, 1) AS DECIMAL(20, 1)) || '%' AS success_rate FROM t""",
)
def visit_table(L):
    return schedule.visit_table(L.schedule, AS_OF, 15000)


_CHART = f"""WITH s AS (SELECT * FROM {{schedule}} WHERE coalesce(rescheduled_date, scheduled_date) <= {DAY}),
    l AS (SELECT subject, visit_code, "group", 'Scheduled' AS status FROM s
    UNION ALL SELECT subject, visit_code, "group", 'Actual' FROM s WHERE exact_date IS NOT NULL
    UNION ALL SELECT subject, visit_code, "group", 'Due visit' FROM s WHERE exact_date IS NULL AND window_close > {DAY}
    UNION ALL SELECT subject, visit_code, "group", 'Missed' FROM s WHERE exact_date IS NULL AND window_close <= {DAY})
    """


@query("visit_status_long", _CHART + "SELECT * FROM l")
def visit_status_long(L):
    return schedule.visit_status_long(L.schedule, AS_OF)


@query("visit_status_counts", _CHART + 'SELECT "group", visit_code, status, count(*) AS n FROM l GROUP BY ALL')
def visit_status_counts(L):
    return schedule.visit_status_counts(L.schedule, AS_OF)


@query(
    "missed_visits",
    f"""SELECT subject, visit_code, scheduled_date, "group", site FROM {{schedule}}
    WHERE window_close < {DAY} AND exact_date IS NULL AND scheduled_date < {DAY}""",
)
def missed_visits(L):
    return schedule.missed_visits(L.schedule, AS_OF)


@query(
    "due_visits",
    f"""SELECT subject, visit_code, scheduled_date, "group", site FROM {{schedule}}
    WHERE window_close >= {DAY} AND exact_date IS NULL AND scheduled_date <= {DAY}""",
)
def due_visits(L):
    return schedule.due_visits(L.schedule, AS_OF)


@query("rescheduled_visits", "SELECT * FROM {schedule} WHERE rescheduled_date IS NOT NULL")
def rescheduled_visits(L):
    return schedule.rescheduled_visits(L.schedule)


@query("unscheduled_visits", "SELECT * FROM {date_of_visit} WHERE visit LIKE '%Unscheduled%'")
def unscheduled_visits(L):
    return schedule.unscheduled_visits(L.date_of_visit)


@query(
    "unscheduled_last_week",
    f"""SELECT * FROM {{date_of_visit}} WHERE visit LIKE '%Unscheduled%' AND visit_date >= {DAY} - 7
    AND visit_date < {DAY}""",
)
def unscheduled_last_week(L):
    return schedule.unscheduled_visits(L.date_of_visit, AS_OF)


@query(
    "sites_by_arm",
    f"""WITH f AS (SELECT site, "group" AS g FROM (SELECT *, row_number() OVER (PARTITION BY subject
        ORDER BY scheduled_date, visit_code, site, "group") AS rn FROM {{schedule}}) WHERE rn = 1),
    t AS (SELECT * FROM f UNION ALL SELECT 'Total', g FROM f)
    SELECT site, {_cell("site", "g = 'Group A'", "Group A")}, {_cell("site", "g = 'Group B'", "Group B")},
        {_cell("site", "g NOT IN ('Group A', 'Group B')", "Other")}, {_cell("site", "g IS NULL", "NA")},
        count(*) AS "Total" FROM t GROUP BY 1""",
)
def sites_by_arm(L):
    return schedule.sites_by_arm(L.schedule, ["Group A", "Group B"])


_LAST_WEEK = f"""WITH v AS (SELECT *, dayname(exact_date) AS weekday FROM {{schedule}}
    WHERE exact_date <> {DAY} AND exact_date > {DAY} - 8)
    """


@query("last_week_visits", _LAST_WEEK + "SELECT * FROM v")
def last_week_visits(L):
    return schedule.last_week_visits(L.schedule, AS_OF)


_WEEK = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query(
    "last_week_table",
    _LAST_WEEK
    + ", c AS (SELECT site, visit_code, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE weekday = '{d}') AS n_{d.lower()}" for d in _WEEK)
    + " FROM v GROUP BY ALL) SELECT *, "
    + ", ".join(f"round(n_{d.lower()} * 100.0 / n, 1)::DOUBLE AS pct_{d.lower()}" for d in _WEEK)
    + " FROM c",
)
def last_week_table(L):
    rows = schedule.last_week_visits(L.schedule, AS_OF)
    return schedule.weekday_table(rows, ["site", "visit_code"], "exact_date", AS_OF)


def _next_week_sql(days: int) -> str:
    return f"""WITH u AS (SELECT * FROM {{schedule}} WHERE scheduled_date BETWEEN {DAY} AND {DAY} + {days}
        AND exact_date IS NULL
    UNION ALL SELECT * FROM {{schedule}} WHERE rescheduled_date BETWEEN {DAY} AND {DAY} + {days} AND exact_date IS NULL),
    t AS (SELECT subject, visit_code, coalesce(rescheduled_date, scheduled_date) AS target_date, site, "group" FROM u),
    f AS (SELECT *, row_number() OVER (PARTITION BY subject, visit_code ORDER BY target_date, site, "group") AS rn FROM t)
    SELECT * EXCLUDE (rn), dayname(target_date) AS weekday FROM f WHERE rn = 1"""


@query("due_next_week", _next_week_sql(6))
def due_next_week(L):
    return schedule.next_week_visits(L.schedule, AS_OF)


@query("due_next_seven_days", _next_week_sql(7))
def due_next_seven_days(L):
    return schedule.next_week_visits(L.schedule, AS_OF, days=7)


@query(
    "next_week_table",
    _next_week_sql(6).replace("SELECT * EXCLUDE (rn), dayname(target_date) AS weekday FROM f WHERE rn = 1", "")
    + ", v AS (SELECT *, dayname(target_date) AS weekday FROM f WHERE rn = 1), c AS (SELECT site, visit_code, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE weekday = '{d}') AS n_{d.lower()}" for d in _WEEK)
    + " FROM v GROUP BY ALL) SELECT *, "
    + ", ".join(f"round(n_{d.lower()} * 100.0 / n, 1)::DOUBLE AS pct_{d.lower()}" for d in _WEEK)
    + " FROM c",
)
def next_week_table(L):
    rows = schedule.next_week_visits(L.schedule, AS_OF)
    return schedule.weekday_table(rows, ["site", "visit_code"], "target_date", AS_OF)


@query(
    "immunology_due",
    f"""SELECT subject, visit_code, target_date, "group", site, dayname(target_date) AS weekday FROM (SELECT *,
        coalesce(rescheduled_date, scheduled_date) AS target_date FROM {{schedule}})
    WHERE visit_code IN ({quoted(IMMUNOLOGY_VISITS)}) AND "group" = 'Group A' AND target_date - {DAY} <= 8
        AND exact_date IS NULL""",
)
def immunology_due(L):
    return schedule.immunology_due(L.schedule, AS_OF)


# ---------------------------------------------------------------- quality


@query(
    "query_table",
    f"""WITH t AS (SELECT query_status, query_type FROM {{queries}} UNION ALL SELECT 'Total', query_type FROM {{queries}})
    SELECT query_status, {_cell("query_status", "query_type = 'Automatic'", "Automatic")},
        {_cell("query_status", "query_type = 'Manual'", "Manual")},
        {_cell("query_status", "query_type NOT IN ('Automatic', 'Manual')", "Other")},
        {_cell("query_status", "query_type IS NULL", "NA")}, count(*) AS "Total" FROM t GROUP BY 1""",
)
def query_table(L):
    return quality.query_table(L.queries)


@query(
    "query_totals",
    """SELECT count(*) AS generated, count(*) FILTER (WHERE query_type = 'Automatic') AS automatic,
        count(*) FILTER (WHERE query_type = 'Manual') AS manual,
        count(*) FILTER (WHERE query_status = 'Open Query') AS open FROM {queries}""",
)
def query_totals(L):
    return quality.query_totals(L.queries)


_OPEN_QUERIES = """WITH o AS (SELECT q.subject, q.visit, q.module, field, query_text, query_id, v.visit_date
        FROM {queries} q LEFT JOIN {date_of_visit} v ON q.subject = v.subject AND q.visit = v.visit
        WHERE query_status = 'Open Query'),
    e AS (SELECT DISTINCT o.*, f.entered_by FROM o LEFT JOIN {visit_forms} f
        ON o.subject = f.subject AND o.visit = f.visit AND o.module = f.module),
    r AS (SELECT CAST(subject AS VARCHAR) AS subject, visit, strftime(visit_date, '%Y%b%d') AS visit_date, module, field,
        query_text, coalesce(entered_by, 'Pending Entry') AS entered_by FROM e),
    s AS (SELECT regexp_replace(subject, '[\\p{P}\\p{S}]', '', 'g') AS subject,
        regexp_replace(visit, '[\\p{P}\\p{S}]', '', 'g') AS visit, visit_date,
        regexp_replace(module, '[\\p{P}\\p{S}]', '', 'g') AS module,
        regexp_replace(field, '[\\p{P}\\p{S}]', '', 'g') AS field,
        regexp_replace(query_text, '[\\p{P}\\p{S}]', '', 'g') AS query_text,
        regexp_replace(entered_by, '[\\p{P}\\p{S}]', '', 'g') AS entered_by FROM r)
    """


def _open(L):
    return quality.open_queries(L.queries, L.date_of_visit, L.visit_forms)


@query("open_queries", _OPEN_QUERIES + "SELECT * FROM s")
def open_queries(L):
    return _open(L)


@query("open_by_module", _OPEN_QUERIES + "SELECT module, count(*) AS count FROM s GROUP BY 1")
def open_by_module(L):
    return quality.open_by_module(_open(L))


ROSTER = [("Staff 0", "data"), ("Staff 1", "data"), ("Staff 2", "field"), ("Staff 3", "clinic")]


@query(
    "open_queries_by_team",
    _OPEN_QUERIES
    + """SELECT *, CASE entered_by WHEN 'Staff 0' THEN 'data' WHEN 'Staff 1' THEN 'data' WHEN 'Staff 2' THEN 'field'
        WHEN 'Staff 3' THEN 'clinic' ELSE 'others' END AS team FROM s""",
)
def open_queries_by_team(L):
    return split_by_team(_open(L), "entered_by", ROSTER)


@query(
    "incomplete_records",
    """SELECT subject, visit, visit_date, module, entry_status, entered_by FROM {visit_forms}
    WHERE entry_status = 'Incomplete' AND NOT (subject = 7 AND visit = 'Day 14') AND NOT (subject = 11 AND visit = 'Day 28')""",
)
def incomplete_records(L):
    return quality.incomplete_records(L.visit_forms, [(7, "Day 14"), (11, "Day 28")])


@query(
    "incomplete_by_team",
    """SELECT subject, visit, visit_date, module, entry_status, entered_by,
        CASE entered_by WHEN 'Staff 0' THEN 'data' WHEN 'Staff 1' THEN 'data' WHEN 'Staff 2' THEN 'field'
        WHEN 'Staff 3' THEN 'clinic' ELSE 'others' END AS team FROM {visit_forms} WHERE entry_status = 'Incomplete'""",
)
def incomplete_by_team(L):
    return split_by_team(quality.incomplete_records(L.visit_forms), "entered_by", ROSTER)


@query(
    "signoff_pending_source",
    "SELECT * FROM {visit_forms} WHERE entry_status <> 'Not Started' AND source_signoff = 'Pending'",
)
def signoff_pending_source(L):
    return quality.signoff_pending(L.visit_forms, "source")


@query(
    "signoff_pending_ecrf",
    """SELECT * FROM {visit_forms} WHERE entry_status <> 'Not Started' AND source_signoff = 'Pending'
    AND ecrf_signoff = 'Pending'""",
)
def signoff_pending_ecrf(L):
    return quality.signoff_pending(L.visit_forms, "ecrf")


@query(
    "signoff_totals",
    """SELECT count(*) AS source_pending, count(*) FILTER (WHERE ecrf_signoff = 'Pending') AS ecrf_pending
    FROM {visit_forms} WHERE entry_status <> 'Not Started' AND source_signoff = 'Pending'""",
)
def signoff_totals(L):
    return quality.signoff_totals(L.visit_forms)


@query("out_of_window", "SELECT * FROM {schedule} WHERE exact_date - window_close > 0")
def out_of_window(L):
    return quality.out_of_window(L.schedule)


_OUT = f"""c AS (SELECT CASE WHEN visit_code IN ({quoted(VISIT_LEVELS)}) THEN visit_code END AS visit_code, count(*) AS local
        FROM {{schedule}} WHERE exact_date - window_close > 0 GROUP BY 1)"""


@query("out_of_window_counts", f"WITH {_OUT} SELECT * FROM c UNION ALL SELECT 'Total', sum(local)::BIGINT FROM c")
def out_of_window_counts(L):
    return quality.out_of_window_counts(L.schedule)


_DEVIATIONS = (
    """f AS (SELECT *, row_number() OVER (PARTITION BY subject, visit ORDER BY query_id) AS rn FROM {queries}
        WHERE field IN ('Visit date', 'Date of vaccination') AND visit <> 'Screening'
        AND NOT regexp_matches(visit, 'Unscheduled|Pre-vacc')
        AND (query_text LIKE '%Difference between%' OR query_text LIKE '%Visit Date is missing_%')),
    dv AS (SELECT subject, CASE visit """
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VISIT_CODE_MAP.items())
    + """ ELSE visit END AS visit_code, module, field, query_text, query_status FROM f WHERE rn = 1)"""
)


@query("deviations", f"WITH {_DEVIATIONS} SELECT * FROM dv")
def deviations(L):
    return quality.deviations(L.queries)


@query("open_deviations", f"WITH {_DEVIATIONS} SELECT * FROM dv WHERE query_status = 'Open Query'")
def open_deviations(L):
    return quality.open_deviations(quality.deviations(L.queries))


@query(
    "deviation_table",
    f"""WITH {_DEVIATIONS}, {_OUT}, n AS (SELECT visit_code, count(*) AS source FROM dv GROUP BY 1),
    j AS (SELECT n.visit_code, source, local FROM n LEFT JOIN c ON n.visit_code = c.visit_code)
    SELECT * FROM j UNION ALL SELECT 'Total', sum(source)::BIGINT, sum(local)::BIGINT FROM j""",
)
def deviation_table(L):
    return quality.deviation_table(quality.deviations(L.queries), L.schedule)


# ------------------------------------------------------------------- labs

_RECENT = f"""({DAY} - hem_date < %d OR {DAY} - bio_date < %d OR {DAY} - dbs_date < %d)"""
_SAMPLES = (
    "sr AS ("
    + " UNION ALL ".join(
        f"SELECT '{p}' AS period, '{s}' AS sample, * FROM {{bloods}} WHERE {flag} = 'Yes'"
        + (f" AND coalesce({_RECENT % (days, days, days)}, false)" if days else "")
        for p, days in (("overall", 0), ("month", 30), ("week", 7))
        for s, flag in (("film", "dbs"), ("haematology", "hem"), ("chemistry", "bio"))
    )
    + ")"
)
_PANELS = f"""fl AS (SELECT subject, visit, count(*) AS k FROM {{panel_films}} WHERE film_result IS NOT NULL GROUP BY ALL),
    lo AS (SELECT *, coalesce(CAST(result AS VARCHAR), no_result_reason) AS shown, row_number() OVER (
        PARTITION BY subject, visit, test ORDER BY first_entry, result, no_result_reason) AS rn FROM {{lab_results}}),
    lp AS (SELECT subject, visit,
        count(DISTINCT test) FILTER (WHERE shown IS NOT NULL AND test IN ({quoted(HAEMATOLOGY_TESTS)})) = 13 AS hem_ok,
        count(DISTINCT test) FILTER (WHERE shown IS NOT NULL AND test NOT IN ({quoted(HAEMATOLOGY_TESTS)})) = 3 AS bio_ok
        FROM lo WHERE rn = 1 GROUP BY ALL),
    en AS (SELECT subject, visit, 'film' AS sample, k FROM fl UNION ALL SELECT subject, visit, 'haematology', 1 FROM lp
        WHERE hem_ok UNION ALL SELECT subject, visit, 'chemistry', 1 FROM lp WHERE bio_ok)"""


@query("sample_rows", f"WITH {_SAMPLES} SELECT * FROM sr")
def sample_rows(L):
    return labs.sample_rows(L.bloods, AS_OF)


@query(
    "sample_counts",
    f"""WITH {_SAMPLES} SELECT p.period, s.sample, count(sr.subject) AS n
    FROM (VALUES ('overall'), ('month'), ('week')) p(period) CROSS JOIN
        (VALUES ('film'), ('haematology'), ('chemistry')) s(sample)
    LEFT JOIN sr ON sr.period = p.period AND sr.sample = s.sample GROUP BY ALL""",
)
def sample_counts(L):
    return labs.sample_counts(L.bloods, AS_OF)


@query(
    "pending_results",
    f"""WITH {_SAMPLES}, {_PANELS} SELECT sr.* FROM sr WHERE NOT EXISTS (SELECT 1 FROM en
        WHERE en.subject = sr.subject AND en.visit = sr.visit AND en.sample = sr.sample)""",
)
def pending_results(L):
    return labs.pending_results(L.bloods, L.panel_films, L.lab_results, AS_OF)


@query(
    "entered_results",
    f"""WITH {_SAMPLES}, {_PANELS} SELECT sr.*, en.k AS results FROM sr JOIN en
        ON en.subject = sr.subject AND en.visit = sr.visit AND en.sample = sr.sample""",
)
def entered_results(L):
    return labs.entered_results(L.bloods, L.panel_films, L.lab_results, AS_OF)


@query(
    "results_matrix",
    f"""WITH {_SAMPLES}, {_PANELS}, j AS (SELECT sr.period, sr.sample, en.k FROM sr LEFT JOIN en
        ON en.subject = sr.subject AND en.visit = sr.visit AND en.sample = sr.sample),
    m(period, kind, measure) AS (VALUES ('overall', 'e', 'Expected overall'), ('overall', 'p', 'Pending overall'),
        ('month', 'e', 'Expected this month'), ('month', 'n', 'Entered this month'), ('month', 'p', 'Pending this month'),
        ('week', 'e', 'Expected this week'), ('week', 'n', 'Entered this week'), ('week', 'p', 'Pending this week')),
    x AS (SELECT measure, sample, CASE kind WHEN 'e' THEN 1 WHEN 'n' THEN coalesce(k, 0)
        ELSE CASE WHEN k IS NULL THEN 1 ELSE 0 END END AS v FROM m LEFT JOIN j ON m.period = j.period)
    SELECT measure, coalesce(sum(v) FILTER (WHERE sample = 'film'), 0)::BIGINT AS film,
        coalesce(sum(v) FILTER (WHERE sample = 'haematology'), 0)::BIGINT AS haematology,
        coalesce(sum(v) FILTER (WHERE sample = 'chemistry'), 0)::BIGINT AS chemistry,
        coalesce(sum(v) FILTER (WHERE sample IS NOT NULL), 0)::BIGINT AS total FROM x GROUP BY 1""",
)
def results_matrix(L):
    return labs.results_matrix(L.bloods, L.panel_films, L.lab_results, AS_OF)


_RECONCILE = """WITH a AS (SELECT l.subject, l.visit, b.sample_date, test, result, collection_rows
        FROM {lab_results} l JOIN (SELECT subject, visit, coalesce(hem_date, bio_date) AS sample_date,
            count(*) AS collection_rows FROM {bloods} GROUP BY ALL) b ON l.subject = b.subject AND l.visit = b.visit
        WHERE no_result_reason IS NULL AND b.sample_date IS NOT NULL),
    k AS (SELECT DISTINCT subject, sample_date, test, result FROM {lab_system}),
    bad AS (SELECT a.* FROM a LEFT JOIN (SELECT *, 1 AS hit FROM k) k ON a.subject = k.subject
        AND a.sample_date = k.sample_date AND a.test = k.test AND a.result IS NOT DISTINCT FROM k.result
        WHERE hit IS NULL)
    """


@query("lab_reconcile", _RECONCILE + "SELECT * FROM bad")
def lab_reconcile(L):
    return labs.reconcile(L.lab_results, L.bloods, L.lab_system)


@query("lab_mismatch_subjects", _RECONCILE + "SELECT DISTINCT subject, visit FROM bad")
def lab_mismatch_subjects(L):
    return labs.mismatch_subjects(labs.reconcile(L.lab_results, L.bloods, L.lab_system))


@query(
    "lab_range_check",
    "WITH r(test, age_lo, age_hi, lo, hi, subj) AS (VALUES "
    + ", ".join(f"('{t}', {a}, {b}, {lo}::DOUBLE, {hi}::DOUBLE, '{RANGE_QUERY_SUBJECT.get(t, t)}')" for t, a, b, lo, hi in LAB_RANGES)
    + """), d AS (SELECT l.*, b.birth_date, row_number() OVER (PARTITION BY l.subject, l.visit, l.test ORDER BY first_entry,
        result, no_result_reason, range_flag, significance, event_code, birth_date) AS rn
        FROM {lab_results} l LEFT JOIN {births} b ON l.subject = b.subject),
    g AS (SELECT *, ((year(first_entry) * 12 + month(first_entry)) - (year(birth_date) * 12 + month(birth_date))
        - CASE WHEN day(first_entry) < day(birth_date) THEN 1 ELSE 0 END)::INTEGER AS age_months FROM d WHERE rn = 1),
    q AS (SELECT g.*, coalesce(
        CASE WHEN NOT (result BETWEEN lo AND hi) AND range_flag IS NULL AND no_result_reason IS NULL
            THEN 'Review ' || subj || ' and/ or range' END,
        CASE WHEN range_flag IS NOT NULL AND significance IS NULL THEN 'Complete Clinical significance' END,
        CASE WHEN significance = 'Clinically Significant' AND event_code IS NULL THEN 'Complete Event code' END) AS query_text
        FROM g LEFT JOIN r ON g.test = r.test AND age_months BETWEEN age_lo AND age_hi)
    SELECT subject, visit, test, result, age_months, query_text, first_entry AS date FROM q
    WHERE visit <> 'Screening' AND query_text IS NOT NULL""",
)
def lab_range_check(L):
    return labs.range_check(L.lab_results, L.births)


@query(
    "extra_samples",
    f"""WITH s AS (SELECT coalesce(test_category, sample_type) AS category, test, {DAY} - sample_date AS d
        FROM {{extra_samples}} WHERE collected = 'Yes'),
    t AS (SELECT category, test, count(*) FILTER (WHERE d < 31) AS this_month,
        count(*) FILTER (WHERE d BETWEEN 31 AND 365) AS within_year,
        count(*) FILTER (WHERE d IS NULL OR d > 365) AS over_a_year FROM s GROUP BY ALL)
    SELECT * FROM t UNION ALL SELECT 'Total', '-', sum(this_month)::BIGINT, sum(within_year)::BIGINT,
        sum(over_a_year)::BIGINT FROM t""",
)
def extra_samples(L):
    return labs.extra_sample_table(L.extra_samples, AS_OF)


# ----------------------------------------------------------------- safety


@query(
    "open_solicited",
    """SELECT 'Local Solicited' AS kind, subject, post_dose, term, onset, ongoing FROM {local_ae} WHERE resolution IS NULL
    UNION ALL SELECT 'Systemic Solicited', subject, post_dose, term, onset, NULL FROM {systemic_ae}
    WHERE resolution IS NULL""",
)
def open_solicited(L):
    return safety.open_solicited(L.local_ae, L.systemic_ae)


@query(
    "recovering_events",
    f"""SELECT *, ({EVENT_DAY} - onset)::INTEGER AS days FROM {{systemic_ae}}
    WHERE onset IS NOT NULL AND outcome = 'Recovering / Resolving'""",
)
def recovering_events(L):
    return safety.recovering(L.systemic_ae, EVENTS_AS_OF)


SKIPPED = ["V signup"]
CHRONIC = [10040644, 10039906]


def _entries_sql(name: str, skip: str) -> str:
    return f"""{name}0 AS (SELECT v.subject, v.first_entry AS entry_date, v.visit, f.entry_status, f.entered_by
        FROM {{clinic_visits}} v JOIN {{clinic_forms}} f
        ON v.subject = f.subject AND v.visit = f.visit AND v.visit_date = f.visit_date
        WHERE f.entry_status <> 'Not Started' {skip}),
    {name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY subject, entry_date
        ORDER BY visit, entered_by, entry_status) AS rn FROM {name}0) WHERE rn = 1)"""


def _linked_sql(name: str, entries: str, where: str, chronic: str) -> str:
    return f"""{name}f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY subject, ae_code
        ORDER BY onset, first_entry, record_id) AS rn FROM {{unsolicited_ae}} {where}) WHERE rn = 1),
    {name} AS (SELECT u.*, e.visit AS linked_visit, e.entry_status,
        CASE WHEN u.term_code IN ({chronic}) THEN 'Chronic' ELSE e.entered_by END AS entered_by,
        ({EVENT_DAY} - u.onset)::INTEGER AS days
        FROM {name}f u LEFT JOIN {entries} e ON u.subject = e.subject AND u.first_entry = e.entry_date)"""


_LINKED = (
    "WITH "
    + _entries_sql("en", "AND v.visit NOT IN ('V signup')")
    + ", "
    + _linked_sql("ln", "en", "WHERE onset IS NOT NULL", "10040644, 10039906")
)
_LIST = "subject, linked_visit, ae_code, high_term, onset, resolution, severity, outcome, entered_by"
_STILL = f"""so AS (SELECT {_LIST} FROM ln WHERE outcome NOT IN ('Recovered / Resolved without sequelae', 'Fatal',
    'Lost to follow-up / Unknown') AND onset IS NOT NULL)"""
ORDER = ["onset", "first_entry", "record_id"]


def _linked(L):
    entries = records.visit_entries(L.clinic_visits, L.clinic_forms, SKIPPED)
    return safety.link_unsolicited(L.unsolicited_ae, entries, EVENTS_AS_OF, CHRONIC, ORDER)


@query("visit_entries", f"WITH {_entries_sql('en', '')} SELECT * FROM en")
def visit_entries(L):
    return records.visit_entries(L.clinic_visits, L.clinic_forms)


@query("unsolicited_linked", _LINKED + " SELECT * FROM ln")
def unsolicited_linked(L):
    return _linked(L)


@query("grade_three_list", _LINKED + f" SELECT {_LIST} FROM ln WHERE severity = 'Grade 3' AND onset IS NOT NULL")
def grade_three_list(L):
    return safety.grade_three(_linked(L))


@query("still_open_list", f"{_LINKED}, {_STILL} SELECT * FROM so")
def still_open_list(L):
    return safety.still_open(_linked(L))


@query("still_open_over_a_week", f"{_LINKED}, {_STILL} SELECT * FROM so WHERE {EVENT_DAY} - onset > 7")
def still_open_over_a_week(L):
    return safety.still_open(_linked(L), min_days=7)


@query(
    "open_events_by_team",
    f"""{_LINKED}, {_STILL}, t AS (
    SELECT *, 'one' AS team FROM so WHERE regexp_matches(entered_by, 'ff 1|ff 2')
    UNION ALL SELECT *, 'two' FROM so WHERE coalesce(regexp_matches(entered_by, 'ff 2|ff 3'), false) OR linked_visit IS NULL
    UNION ALL SELECT *, 'Chronic' FROM so WHERE regexp_matches(entered_by, 'Chronic') AND linked_visit IS NOT NULL)
    SELECT * EXCLUDE (entered_by) FROM t""",
)
def open_events_by_team(L):
    teams = [("one", ["ff 1", "ff 2"]), ("two", ["ff 2", "ff 3"])]
    return safety.open_by_team(safety.still_open(_linked(L)), teams, unlinked_team="two")


GRADES = ["Grade 1", "Grade 2", "Grade 3"]


def _grade_sql(source: str, row: str, where: str = "") -> str:
    tests = {g: f"severity = '{g}'" for g in GRADES}
    tests["Other"], tests["NA"] = f"severity NOT IN ({quoted(GRADES)})", "severity IS NULL"
    cells = ", ".join(_cell("k", test, name) for name, test in tests.items())
    return f"""WITH r AS (SELECT {row} AS k, severity FROM {{{source}}} {where}),
    t AS (SELECT * FROM r UNION ALL SELECT 'Total', severity FROM r)
    SELECT k AS {row if row.isidentifier() else 'high_term'}, {cells}, count(*) AS "Total" FROM t GROUP BY 1"""


@query("local_outcome_by_grade", _grade_sql("local_ae", "outcome", "WHERE post_dose IS NOT NULL"))
def local_outcome_by_grade(L):
    return safety.outcome_by_grade(safety.after_dose(L.local_ae), GRADES)


@query("local_term_by_grade", _grade_sql("local_ae", "term", "WHERE post_dose IS NOT NULL"))
def local_term_by_grade(L):
    return safety.term_by_grade(safety.after_dose(L.local_ae), "term")


@query("systemic_outcome_by_grade", _grade_sql("systemic_ae", "outcome", "WHERE post_dose IS NOT NULL"))
def systemic_outcome_by_grade(L):
    return safety.outcome_by_grade(safety.after_dose(L.systemic_ae), GRADES)


@query("systemic_term_by_grade", _grade_sql("systemic_ae", "term", "WHERE post_dose IS NOT NULL"))
def systemic_term_by_grade(L):
    return safety.term_by_grade(safety.after_dose(L.systemic_ae), "term", GRADES)


@query("unsolicited_outcome_by_grade", _grade_sql("unsolicited_ae", "outcome", "WHERE any_event = 'Yes'"))
def unsolicited_outcome_by_grade(L):
    return safety.outcome_by_grade(safety.reported(L.unsolicited_ae), GRADES)


@query(
    "unsolicited_term_by_grade",
    _grade_sql("unsolicited_ae", "coalesce(high_term, 'Other infections')", "WHERE any_event = 'Yes'"),
)
def unsolicited_term_by_grade(L):
    return safety.term_by_grade(safety.reported(L.unsolicited_ae), "high_term", GRADES, "Other infections")


def _grade_three_sql(by: str) -> str:
    return (
        _LINKED
        + f""", c AS (SELECT {by}, count(*) AS count FROM ln WHERE severity = 'Grade 3' GROUP BY 1)
    SELECT * FROM c UNION ALL SELECT 'Total', sum(count)::BIGINT FROM c"""
    )


@query("grade_three_by_outcome", _grade_three_sql("outcome"))
def grade_three_by_outcome(L):
    return safety.grade_three_counts(_linked(L), "outcome")


@query("grade_three_by_term", _grade_three_sql("high_term"))
def grade_three_by_term(L):
    return safety.grade_three_counts(_linked(L), "high_term")


@query(
    "closure_summary",
    _LINKED
    + ", "
    + _STILL
    + ", "
    + _entries_sql("ea", "")
    + ", "
    + _linked_sql("la", "ea", "", "10040644")
    + f""", o AS (SELECT CASE WHEN entered_by IN ('Staff 1', 'Staff 2', 'Staff 3', 'Chronic') THEN entered_by
        ELSE 'Pending Link' END AS owner, {EVENT_DAY} - onset AS d FROM so),
    oc AS (SELECT owner, count(*) AS open, nullif(count(*) FILTER (WHERE d > 7), 0) AS open_long FROM o GROUP BY 1),
    cl AS (SELECT entered_by, count(*) AS closed FROM la WHERE resolution IS NOT NULL AND {EVENT_DAY} - last_entry <= 7
        GROUP BY 1),
    j AS (SELECT owner, open, open_long, closed FROM oc LEFT JOIN cl ON owner = entered_by)
    SELECT * FROM j UNION ALL SELECT 'Total', sum(open)::BIGINT, coalesce(sum(open_long), 0)::BIGINT,
        coalesce(sum(closed), 0)::BIGINT FROM j""",
)
def closure_summary(L):
    both = safety.listed_and_every(
        L.unsolicited_ae, L.clinic_visits, L.clinic_forms, SKIPPED, CHRONIC, [10040644], ORDER
    )
    return safety.closure_summary(both, EVENTS_AS_OF, ["Staff 1", "Staff 2", "Staff 3"])


# ------------------------------------------------------------------ cases

_DRUGS = """da AS (SELECT m.*, v.visit AS timepoint FROM {medications} m LEFT JOIN {date_of_visit} v
        ON m.subject = v.subject AND m.first_entry = v.visit_date WHERE regexp_matches(generic_name, 'lumef|Lumef')),
    vr AS (SELECT subject, visit_date, visit, count(*) AS k FROM {date_of_visit} GROUP BY ALL),
    dr AS (SELECT m.*, vr.visit AS timepoint, coalesce(k, 1) AS visit_rows FROM {medications} m LEFT JOIN vr
        ON m.subject = vr.subject AND m.first_entry = vr.visit_date WHERE regexp_matches(generic_name, 'lumef|Lumef'))"""
_DOSED = """ds AS (SELECT subject, CASE visit WHEN '2B0 Vaccination' THEN '2B0' ELSE visit END AS dose, dose_date,
        CASE visit WHEN 'Dose 1' THEN 1 WHEN 'Dose 2' THEN 2 WHEN 'Dose 3' THEN 3 WHEN 'Booster' THEN 4 ELSE 5 END AS place
        FROM {vaccination})"""


def _last_dose_sql(day: str) -> str:
    """Correlated lookup of the latest dose, the earlier label on a tie."""
    return f"""(SELECT dose FROM ds WHERE ds.subject = x.subject AND ds.dose_date <= x.{day}
        ORDER BY ds.dose_date DESC, place LIMIT 1)"""


_SHARES = """, c AS (SELECT last_dose, count(*) AS n FROM k GROUP BY 1),
    p AS (SELECT last_dose, n, round_even(n * 100.0 / (SELECT sum(n) FROM c), %d)::DOUBLE AS p FROM c),
    u AS (SELECT * FROM p UNION ALL SELECT 'Total', sum(n)::BIGINT, round(sum(p), 1) FROM p)
    SELECT last_dose, n, regexp_replace(CAST(p AS VARCHAR), '\\.0$', '') || '%%' AS percentage FROM u"""


def _drugs(L):
    return cases.drug_records(L.medications, L.date_of_visit)


@query("treatment_cases", f"WITH {_DRUGS} SELECT * FROM dr WHERE indication = 'Malaria'")
def treatment_cases(L):
    return cases.treatment_cases(_drugs(L))


@query("ongoing_treatment", f"WITH {_DRUGS} SELECT * FROM dr WHERE ongoing = 'Yes'")
def ongoing_treatment(L):
    return cases.ongoing_treatment(_drugs(L))


@query(
    "treatment_last_dose",
    f"""WITH {_DRUGS}, {_DOSED}, k AS (SELECT x.subject, x.first_entry, x.brand_name, x.frequency, x.timepoint,
        {_last_dose_sql('first_entry')} AS last_dose FROM dr x WHERE indication = 'Malaria') SELECT * FROM k""",
)
def treatment_last_dose(L):
    placed = cases.with_last_dose(cases.treatment_cases(_drugs(L)), L.vaccination, "first_entry")
    return placed.select("subject", "first_entry", "brand_name", "frequency", "timepoint", "last_dose")


@query(
    "treatment_dose_shares",
    f"""WITH {_DRUGS}, {_DOSED}, k AS (SELECT {_last_dose_sql('first_entry')} AS last_dose FROM da x
        WHERE indication = 'Malaria')"""
    + _SHARES % 0,
)
def treatment_dose_shares(L):
    return cases.dose_shares(cases.treatment_cases(_drugs(L)), L.vaccination, "first_entry", 0, weight="visit_rows")


_POSITIVE = """po AS (SELECT * FROM {films} WHERE visit = 'Malaria case report'
        AND sample_type = 'Blood film for Plasmodium species' AND film_result <> 'Negative for Plasmodium species')"""
CASE_ORDER = ["sample_date", "episode", "first_entry", "record_id"]


@query(
    "film_dose_shares",
    f"""WITH {_POSITIVE}, {_DOSED}, k0 AS (SELECT {_last_dose_sql('sample_date')} AS last_dose FROM po x),
    k AS (SELECT * FROM k0 WHERE last_dose IS NOT NULL)"""
    + _SHARES % 1,
)
def film_dose_shares(L):
    return cases.dose_shares(cases.positive_films(L.films), L.vaccination, "sample_date", 1, matched_only=True)


_CASES = f"""WITH {_POSITIVE}, {_DOSED}, k AS (SELECT x.subject, x.record_id, x.sample_date, x.episode, x.first_entry,
        {_last_dose_sql('sample_date')} AS last_dose FROM po x),
    a AS (SELECT *, 'MLR-' || row_number() OVER (PARTITION BY subject ORDER BY sample_date, episode, first_entry, record_id)
        AS case_number_all FROM k),
    b AS (SELECT *, 'MLR-' || row_number() OVER (PARTITION BY subject ORDER BY sample_date, episode, first_entry, record_id)
        AS case_number FROM a WHERE last_dose IS NOT NULL)
    """


@query(
    "numbered_cases",
    _CASES + "SELECT subject, record_id, sample_date, last_dose, case_number_all, case_number FROM b",
)
def numbered_cases(L):
    numbered = cases.numbered_cases(L.films, L.vaccination, CASE_ORDER)
    return numbered.select("subject", "record_id", "sample_date", "last_dose", "case_number_all", "case_number")


@query(
    "case_number_table",
    _CASES
    + """, c AS (SELECT case_number, count(*) AS n FROM b GROUP BY 1),
    p AS (SELECT case_number, n, round_even(n * 100.0 / (SELECT sum(n) FROM c), 1)::DOUBLE AS p FROM c),
    u AS (SELECT * FROM p UNION ALL SELECT 'Total', sum(n)::BIGINT, round(sum(p), 1) FROM p)
    SELECT case_number, n, regexp_replace(CAST(p AS VARCHAR), '\\.0$', '') || '%' AS percentage FROM u""",
)
def case_number_table(L):
    return cases.case_number_table(L.films, L.vaccination)


@query(
    "film_rdt_overlap",
    f"""WITH {_POSITIVE}, rd AS (SELECT subject, visit, episode, sample_date, rdt_result AS rdt_test_result,
        first_entry AS rdt_first_entry, count(*) AS rdt_rows FROM {{films}}
        WHERE visit = 'Malaria case report' AND sample_type = 'A P. falciparum rapid diagnosis test (RDT)'
        AND rdt_result = 'Positive for Plasmodium falciparum' GROUP BY ALL)
    SELECT po.*, rdt_test_result, rdt_first_entry, rdt_rows FROM po JOIN rd USING (subject, visit, episode, sample_date)""",
)
def film_rdt_overlap(L):
    return cases.film_rdt_overlap(L.films)


# ------------------------------------------------------------ medications

_MEDS = """WITH en0 AS (SELECT v.subject, v.first_entry AS entry_date, v.visit, f.entry_status, f.entered_by
        FROM {date_of_visit} v JOIN {visit_forms} f
        ON v.subject = f.subject AND v.visit = f.visit AND v.visit_date = f.visit_date
        WHERE f.entry_status <> 'Not Started' AND v.visit NOT IN ('Day 14', 'Day 42')),
    en AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY subject, entry_date
        ORDER BY visit, entered_by, entry_status) AS rn FROM en0) WHERE rn = 1),
    mf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, episode, generic_name ORDER BY start_date,
        first_entry, indication, brand_name, ongoing, stop_date, frequency, last_entry, visit) AS rn FROM {medications})
        WHERE rn = 1),
    md AS (SELECT m.subject, e.visit, m.first_entry AS entry_date, indication, episode, generic_name, brand_name, start_date,
        ongoing, stop_date, frequency, last_entry, coalesce(e.entered_by, 'Name missing') AS entered_by
        FROM mf m LEFT JOIN en e ON m.subject = e.subject AND m.first_entry = e.entry_date
        WHERE indication IS NOT NULL AND episode IS NOT NULL),
    om AS (SELECT *, entered_by AS staff, CASE WHEN entered_by IN ('Staff 1', 'Staff 2', 'Staff 3', 'Name missing')
        THEN entered_by ELSE 'Other staff' END AS owner FROM md WHERE stop_date IS NULL)
    """


def _meds(L):
    return meds.clean_medications(
        L.medications, records.visit_entries(L.date_of_visit, L.visit_forms, ["Day 14", "Day 42"])
    )


def _open_meds(L):
    return meds.open_medications(_meds(L), ["Staff 1", "Staff 2", "Staff 3"])


@query("clean_medications", _MEDS + "SELECT * FROM md")
def clean_medications(L):
    return _meds(L)


@query(
    "medications_open_closed",
    _MEDS
    + """, c AS (SELECT CASE WHEN stop_date IS NULL THEN 'Open' ELSE 'Closed' END AS state, count(*) AS count FROM md
        GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'Total', sum(count)::BIGINT FROM c""",
)
def medications_open_closed(L):
    return meds.open_closed(_meds(L))


@query("open_medications", _MEDS + "SELECT * FROM om")
def open_medications(L):
    return _open_meds(L)


@query(
    "open_medications_summary",
    _MEDS
    + f"""SELECT owner, count(*) AS open, nullif(count(*) FILTER (WHERE {DAY} - start_date > 14), 0) AS open_long
    FROM om GROUP BY 1""",
)
def open_medications_summary(L):
    return meds.open_summary(_open_meds(L), AS_OF)


@query("open_medications_of_others", _MEDS + "SELECT * FROM om WHERE owner = 'Other staff'")
def open_medications_of_others(L):
    return meds.open_list(_open_meds(L), "Other staff")


# ---------------------------------------------------------------- extract


def _extract_sql(join: str, key: str) -> str:
    haem = ", ".join(f"h.{c}" for c in HAEMATOLOGY_COLUMNS)
    chem = ", ".join(f"c.{c}" for c in CHEMISTRY_COLUMNS)
    longs = " UNION ALL ".join(
        f"SELECT subject, sample_date, '{t}' AS test, {c} AS result FROM w"
        for c, t in {**HAEMATOLOGY_COLUMNS, **CHEMISTRY_COLUMNS}.items()
    )
    return f"""WITH h AS (SELECT * FROM {{haematology}} WHERE fk_study = 1),
    c AS (SELECT * FROM {{chemistry}} WHERE fk_study = 1),
    w AS (SELECT DISTINCT {key.format('serial_study_id')} AS subject, {key.format('date_collect')} AS sample_date, {haem}, {chem}
        FROM h {join} JOIN c ON h.serial_study_id = c.serial_study_id AND h.date_collect = c.date_collect)
    {longs}"""


@query("lab_extract", _extract_sql("FULL", "coalesce(h.{0}, c.{0})"))
def lab_extract(L):
    return extract.lab_extract(L.haematology, L.chemistry, 1)


@query("lab_extract_left", _extract_sql("LEFT", "h.{0}"))
def lab_extract_left(L):
    return extract.lab_extract(L.haematology, L.chemistry, 1, mode="left")


@query(
    "queries_still_open",
    """SELECT a.*, today_rows FROM (SELECT subject, visit, module, field, query_text, query_type FROM {queries}
        WHERE query_status IN ('Open Query', 'Answered')) a JOIN (
        SELECT subject, visit, module, field, query_text, count(*) AS today_rows FROM {queries}
        WHERE query_status = 'Open Query' GROUP BY ALL) b USING (subject, visit, module, field, query_text)""",
)
def queries_still_open(L):
    cols = extract.SNAPSHOT_KEYS
    earlier = L.queries.filter(F.col("query_status").isin("Open Query", "Answered")).select(*cols, "query_type")
    opened = L.queries.filter(F.col("query_status") == "Open Query")
    today = [
        opened.filter(F.col("query_type") == "Automatic").select(*cols),
        opened.filter(F.col("query_type") == "Manual").select(*cols),
    ]
    return extract.still_in_snapshot(earlier, today)


# ---------------------------------------------------------------- sources

_RAW_DATES = {"iso": "yyyy-MM-dd", "slashed": "dd/MM/yyyy", "named": "dd-MMM-yyyy", "stamped": "dd-MMM-yyyy HH:mm"}


def _raw(df, name: str, layouts: dict[str, str]):
    """A typed listing turned back into the text columns of its file, blanks for missing values."""
    listing = LISTINGS[name]
    places = [f.source for f in listing.fields if isinstance(f.source, int)]
    cells = {i: F.lit("") for i in range(1, max(listing.width or 0, *places, 0) + 1)}
    named = []
    for f in listing.fields:
        if f.name not in df.columns:
            value = F.lit("")
        elif f.kind == "date":
            value = F.date_format(f.name, _RAW_DATES[layouts[f.name]])
        else:
            value = F.col(f.name).cast("string")
        value = F.coalesce(value, F.lit(""))
        if isinstance(f.source, int):
            cells[f.source] = value
        else:
            named.append(value.alias(f.source))
    return df.select(*[c.alias(f"column {i}") for i, c in cells.items()], *named)


@query("conform_schedule", "SELECT * FROM {schedule}")
def conform_schedule(L):
    dates = ["window_open", "scheduled_date", "rescheduled_date", "exact_date", "window_close"]
    return conform(_raw(L.schedule, "schedule", dict.fromkeys(dates, "iso")), LISTINGS["schedule"])


@query("conform_medications", "SELECT * FROM {medications}")
def conform_medications(L):
    layouts = {"start_date": "slashed", "stop_date": "slashed", "first_entry": "stamped", "last_entry": "named"}
    return conform(_raw(L.medications, "medications", layouts), LISTINGS["medications"])


@query("conform_lab_results", "SELECT * EXCLUDE (record_id) FROM {lab_results}")
def conform_lab_results(L):
    return conform(_raw(L.lab_results, "lab_results", {"first_entry": "stamped"}), LISTINGS["lab_results"])


@query("conform_bloods", "SELECT * FROM {bloods}")
def conform_bloods(L):
    layouts = dict.fromkeys(["hem_date", "bio_date", "dbs_date"], "named")
    return conform(_raw(L.bloods, "bloods", layouts), LISTINGS["bloods"])


_SQL_KINDS = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "date": "DATE"}


def _loaded(name: str, listed: str, made: dict[str, tuple] | None = None, where: str = "", extra: str = ""):
    """Register the loading of a listing: text columns as in its file, conformed and cleaned.

    `listed` names the fields the derived listing has, `made` the fields that
    get another raw value (Spark SQL) and what they are in the end (checking SQL).
    """
    made = made or {}
    cells = []
    for f in LISTINGS[name].fields:
        if f.name in made:
            cells.append(f'{made[f.name][1]} AS "{f.name}"')
        elif f.name in listed.split():
            cells.append(f'CAST("{f.name}" AS {_SQL_KINDS[f.kind]}) AS "{f.name}"')
        else:
            cells.append(f'CAST(NULL AS {_SQL_KINDS[f.kind]}) AS "{f.name}"')

    def build(L):
        df = getattr(L, name).withColumns({c: F.expr(value) for c, (value, _) in made.items()})
        dates = {f.name: "named" if f.layouts[0].startswith("d-") else "iso" for f in LISTINGS[name].fields if f.kind == "date"}
        return clean(conform(_raw(df, name, dates), LISTINGS[name]), name)

    query(f"load_{name}", f"SELECT {', '.join(cells)}{extra} FROM {{{name}}} {where}")(build)


_loaded("vaccination", "subject visit dose_date")
_loaded("eligibility", "subject visit earlier_vaccine birth_defect underweight long_illness recent_vaccine immune_condition other details")
_loaded("participants", "subject group current_status site consent_v6 consent_v7 consent_v6_one consent_v6_two consent_v7_one consent_v7_two")
_loaded(
    "randomisation", "subject rand",
    {"visit": ("CASE WHEN subject % 7 <> 0 THEN 'Screening' ELSE 'Visit 1' END", "'Screening'")}, "WHERE subject % 7 <> 0",
)
_loaded("end_of_study", "subject completion_date")
_loaded("date_of_visit", "subject visit visit_date first_entry")
_loaded(
    "queries", "subject visit module field query_type query_status query_id",
    {"query_text": ("concat(query_text, '\ufffd!\ufffd')", "query_text || '_!' || chr(65533)")},
)
_loaded("visit_forms", "subject visit module visit_date entry_status entered_by ecrf_signoff source_signoff")
_loaded("films", "subject visit episode sample_date sample_type film_result rdt_result first_entry")
_loaded("lab_system", "subject sample_date test result")
_loaded("births", "subject birth_date")
_loaded("extra_samples", "subject collected sample_date test_category sample_type test", where="WHERE collected = 'Yes'")
_loaded(
    "local_ae", "subject term onset ongoing resolution severity outcome",
    {"post_dose": ("dose_code", "CASE dose_code WHEN '1' THEN 'Dose 1' WHEN '2' THEN 'Dose 2' WHEN '3' THEN 'Dose 3' END")},
    extra=", CASE WHEN dose_code IN ('1', '2', '3') THEN CAST(dose_code AS INTEGER) END AS post_dose_rank",
)
_loaded(
    "systemic_ae", "subject term onset resolution severity outcome",
    {"post_dose": ("post_dose", "CASE post_dose WHEN 'Booster 1' THEN 'Booster 1' END")},
    extra=", CASE post_dose WHEN 'Booster 1' THEN 4 END AS post_dose_rank",
)
_loaded("unsolicited_ae", "subject any_event ae_code term_code high_term onset resolution severity outcome first_entry last_entry")
_loaded("dosing", "subject visit")


# -------------------------------------------------- files written and read back


def _folder(df) -> str:
    return f"{shared_dir(df.sparkSession)}/job-{uuid.uuid4().hex}"


@query(
    "load_quoted_lines",
    """SELECT subject, visit, module, field, query_text || chr(10) || '"_", then' || chr(10) || chr(10) || 'more' AS query_text,
        query_type, query_status, query_id FROM {queries}""",
)
def load_quoted_lines(L):
    """Query texts with line ends and quotes in them, through a file and back."""
    raw = _raw(L.queries.withColumn("query_text", F.concat("query_text", F.lit('\n"\ufffd", then\n\nmore'))), "queries", {})
    folder = _folder(raw)
    raw.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{folder}/{LISTINGS['queries'].file}")
    return load(raw.sparkSession, folder, "queries")


def _consent_lists(L):
    versions, answers = ("v6", "v7"), ("Yes", "No", "Pending")
    return {f"consent_{v}_{a.lower()}": status.consent_list(L.participants, v, a).withColumn("team", F.col("site")) for v in versions for a in answers}


_CONSENT_SQL = " UNION ALL ".join(
    f"""SELECT 'consent_{v}_{a.lower()}' AS list, coalesce(site, 'none') AS team, count(*) AS n FROM {{participants}}
        WHERE current_status = 'On Active Follow up' AND coalesce(consent_{v}, 'Pending') = '{a}' GROUP BY ALL"""
    for v in ("v6", "v7")
    for a in ("Yes", "No", "Pending")
)


def _run(L):
    required = _required(L)
    lists = {**_consent_lists(L), "required_eos": required, "pending_eos": status.eos_pending(required, L.end_of_study)}
    folder = _folder(L.participants)
    return folder, write_run(lists, folder, "2001-01-01")


@query(
    "worklist_run",
    _REQUIRED
    + f"""SELECT * FROM ({_CONSENT_SQL}) UNION ALL SELECT 'required_eos', 'all', count(*) FROM req
    UNION ALL SELECT 'pending_eos', 'all', count(*) FROM req WHERE subject NOT IN (SELECT subject FROM {{end_of_study}})""",
)
def worklist_run(L):
    """All lists of a run in one write; what is counted are the rows of its files."""
    return _run(L)[1].select("list", "team", "n")


@query(
    "worklist_read_back",
    _REQUIRED
    + """SELECT CAST(subject AS VARCHAR) AS subject, "group", other, current_status, site, time, 'all' AS team FROM req
    WHERE subject NOT IN (SELECT subject FROM {end_of_study})""",
)
def worklist_read_back(L):
    return read_run(L.participants.sparkSession, _run(L)[0], "pending_eos")


@query("lab_extract_in_steps", _extract_sql("FULL", "coalesce(h.{0}, c.{0})"))
def lab_extract_in_steps(L):
    """The laboratory tables as Parquet, their extract written up to a date, then brought up to all of it, and loaded."""
    folder = _folder(L.haematology)
    L.haematology.write.parquet(f"{folder}/{HAEMATOLOGY_TABLE}.parquet")
    L.chemistry.write.parquet(f"{folder}/{CHEMISTRY_TABLE}.parquet")
    spark = L.haematology.sparkSession
    whole = extract.lab_extract(*read_lab_tables(spark, folder), 1, by_date=True)
    update_extract(whole.filter(F.col("sample_date") <= date(1997, 6, 30)), folder, by_date=True)
    update_extract(whole, folder, by_date=True)
    return load(spark, folder, "lab_system")
