"""Trial-like listings derived from the driver tables.

One SQL text per listing, in the dialect Spark and the checking engine share,
so both sides start from the same relation. Names in braces are driver tables
or other listings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from studyloom.fixed_values import CHEMISTRY_TESTS, HAEMATOLOGY_TESTS, VISIT_LEVELS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_VISIT = "split_part('" + "|".join([*VISIT_LEVELS, "Extra visit"]) + "', '|', CAST(o_orderkey % 32 AS INT) + 1)"
_TEST = "split_part('" + "|".join([*HAEMATOLOGY_TESTS, *CHEMISTRY_TESTS]) + "', '|', CAST(l_partkey % 16 AS INT) + 1)"

LISTINGS = {
    "participants": """
        SELECT c_custkey AS subject,
               CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 'Group C'
                    WHEN c_custkey % 2 = 0 THEN 'Group A' ELSE 'Group B' END AS group,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'On Active Follow up'
                    WHEN 'BUILDING' THEN 'On Active Follow up'
                    WHEN 'FURNITURE' THEN 'Completed follow up'
                    WHEN 'HOUSEHOLD' THEN 'Loss to follow up'
                    ELSE CASE c_custkey % 5 WHEN 0 THEN 'Consent withdrawal' WHEN 1 THEN 'Blood volume Issues'
                         WHEN 2 THEN 'Terminated due to dosing error' WHEN 3 THEN 'Terminated due to PI discretion'
                         ELSE 'SAE resulting to death' END END AS current_status,
               CASE WHEN c_nationkey < 20 THEN concat('Site ', CAST(c_nationkey % 4 AS STRING)) END AS site,
               CASE WHEN c_acctbal < 2000 THEN 'No' WHEN c_acctbal < 6000 THEN 'Yes' END AS consent_v6,
               CASE c_custkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS consent_v7,
               CASE WHEN c_acctbal < 2000 THEN 'No' WHEN c_acctbal < 6000 THEN 'Yes' END AS consent_v6_one,
               CASE WHEN c_acctbal < 6000 THEN concat('2023-01-0', CAST(c_custkey % 9 + 1 AS STRING)) END AS consent_v6_two,
               CASE c_custkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS consent_v7_one,
               CASE WHEN c_custkey % 3 <> 2 THEN concat('2023-05-0', CAST(c_custkey % 9 + 1 AS STRING)) END AS consent_v7_two
        FROM {customer}""",
    "vaccination": """
        SELECT o_custkey AS subject,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Dose 1' WHEN '2-HIGH' THEN 'Dose 2'
                    WHEN '3-MEDIUM' THEN 'Dose 3' WHEN '4-NOT SPECIFIED' THEN 'Booster'
                    ELSE '2B0 Vaccination' END AS visit,
               CAST(MIN(o_orderdate) AS DATE) AS dose_date
        FROM {orders} GROUP BY 1, 2""",
    "eligibility": """
        SELECT o_custkey AS subject, o_orderkey AS record_id,
               CASE WHEN o_orderkey % 97 <> 0 THEN 'Screening' END AS visit,
               CASE WHEN o_orderkey % 101 = 0 THEN 'Yes' ELSE 'No' END AS earlier_vaccine,
               CASE WHEN o_orderkey % 103 = 0 THEN 'Yes' ELSE 'No' END AS birth_defect,
               CASE WHEN o_orderkey % 107 = 0 THEN 'Yes' ELSE 'No' END AS underweight,
               CASE WHEN o_orderkey % 79 = 0 THEN 'Yes' WHEN o_orderkey % 3 = 0 THEN 'No' END AS long_illness,
               CASE WHEN o_orderkey % 113 = 0 THEN 'Yes' ELSE 'No' END AS recent_vaccine,
               CASE WHEN o_orderkey % 127 = 0 THEN 'Yes' WHEN o_orderkey % 2 = 0 THEN 'No' END AS immune_condition,
               CASE WHEN o_orderkey % 61 = 0 THEN 'Closure of enrolment'
                    WHEN o_orderkey % 67 = 0 THEN 'Consent withdrawal' END AS other,
               CASE WHEN o_orderkey % 59 = 0 THEN 'another vaccine given'
                    WHEN o_orderkey % 53 = 0 THEN 'HIV care' END AS details
        FROM {orders}""",
    "randomisation": """
        SELECT c_custkey AS subject,
               CASE WHEN c_nationkey > 7 THEN concat('R', CAST(c_custkey AS STRING)) END AS rand
        FROM {customer}""",
    "end_of_study": """
        SELECT c_custkey AS subject, DATE '2000-06-01' + CAST(c_custkey % 200 AS INT) AS completion_date
        FROM {customer} WHERE c_mktsegment IN ('FURNITURE', 'BUILDING')""",
    "schedule": f"""
        SELECT o_custkey AS subject, {_VISIT} AS visit_code,
               CAST(o_orderdate AS DATE) AS window_open, CAST(o_orderdate AS DATE) AS scheduled_date,
               CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 10 END AS rescheduled_date,
               CASE WHEN o_orderstatus <> 'P' THEN CAST(first_ship AS DATE) END AS exact_date,
               CAST(o_orderdate AS DATE) + 45 AS window_close,
               CASE WHEN o_custkey % 29 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'Group A' ELSE 'Group B' END AS group,
               concat('Site ', CAST(o_custkey % 6 AS STRING)) AS site
        FROM {{orders}} LEFT JOIN
             (SELECT l_orderkey, MIN(l_shipdate) AS first_ship FROM {{lineitem}} GROUP BY l_orderkey) s
             ON o_orderkey = l_orderkey""",
    "date_of_visit": f"""
        SELECT o_custkey AS subject,
               CASE WHEN o_orderkey % 10 = 0 THEN concat('Unscheduled - ', CAST(o_orderkey % 20 AS STRING))
                    ELSE {_VISIT} END AS visit,
               CAST(o_orderdate AS DATE) AS visit_date,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INT) AS first_entry
        FROM {{orders}}""",
    "visit_forms": f"""
        SELECT o_custkey AS subject, {_VISIT} AS visit, concat('Form ', substr(o_orderpriority, 1, 1)) AS module,
               CAST(MIN(o_orderdate) AS DATE) AS visit_date,
               CASE MIN(o_orderkey) % 4 WHEN 0 THEN 'Not Started' WHEN 1 THEN 'Incomplete'
                    ELSE 'Complete' END AS entry_status,
               CASE WHEN MIN(o_orderkey) % 11 <> 0
                    THEN concat('Staff ', CAST(MIN(o_orderkey) % 7 AS STRING)) END AS entered_by,
               CASE WHEN MIN(o_totalprice) < 200000 THEN 'Pending' ELSE 'Signed' END AS source_signoff,
               CASE WHEN MIN(o_orderkey) % 2 = 0 THEN 'Pending' ELSE 'Signed' END AS ecrf_signoff
        FROM {{orders}} GROUP BY 1, 2, 3""",
    "queries": f"""
        SELECT o_custkey AS subject,
               CASE WHEN o_orderkey % 13 = 0 THEN 'Screening' WHEN o_orderkey % 17 = 0 THEN 'Pre-Booster'
                    WHEN o_orderkey % 19 = 0 THEN 'B 14' ELSE {_VISIT} END AS visit,
               concat('Form ', substr(o_orderpriority, 1, 1)) AS module,
               CASE l_linenumber WHEN 1 THEN 'Visit date' WHEN 2 THEN 'Date of vaccination' WHEN 3 THEN 'Weight (kg)'
                    ELSE concat('Item ', CAST(l_linenumber AS STRING)) END AS field,
               CASE l_returnflag WHEN 'A' THEN 'Difference between dates (>2 days); check!'
                    WHEN 'N' THEN 'Visit Date is missing.' ELSE 'Please confirm + explain: 5% off' END AS query_text,
               CASE l_linestatus WHEN 'F' THEN 'Automatic' ELSE 'Manual' END AS query_type,
               CASE WHEN l_quantity <= 20 THEN 'Resolved' WHEN l_quantity <= 25 THEN 'Data Deleted'
                    WHEN l_quantity <= 30 THEN 'CDM Override' WHEN l_quantity <= 35 THEN 'Answered'
                    WHEN l_quantity <= 48 THEN 'Open Query' ELSE 'Draft' END AS query_status,
               concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING),
                      '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS query_id
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "bloods": """
        SELECT l_suppkey AS subject, CASE l_linenumber WHEN 7 THEN 'Screening'
                    ELSE concat('Visit ', CAST(l_linenumber AS STRING)) END AS visit,
               CASE WHEN MIN(l_orderkey) % 3 <> 0 THEN 'Yes' ELSE 'No' END AS hem,
               CASE WHEN MIN(l_orderkey) % 3 <> 0 THEN CAST(MAX(l_shipdate) AS DATE) - 30 END AS hem_date,
               CASE WHEN MIN(l_orderkey) % 4 <> 0 THEN 'Yes' END AS bio,
               CASE WHEN MIN(l_orderkey) % 4 <> 0 THEN CAST(MAX(l_shipdate) AS DATE) - 20 END AS bio_date,
               CASE WHEN MIN(l_orderkey) % 2 = 0 THEN 'Yes' ELSE 'No' END AS dbs,
               CASE WHEN MIN(l_orderkey) % 2 = 0 THEN CAST(MAX(l_shipdate) AS DATE) - 40 END AS dbs_date
        FROM {lineitem} GROUP BY l_suppkey, l_linenumber""",
    "lab_results": f"""
        SELECT l_suppkey AS subject, CASE l_linenumber WHEN 7 THEN 'Screening'
                    ELSE concat('Visit ', CAST(l_linenumber AS STRING)) END AS visit,
               {_TEST} AS test,
               CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_partkey % 16 = 0 THEN l_quantity * 20
                    WHEN l_partkey % 16 IN (6, 7, 8, 9, 10) THEN l_quantity / 8 ELSE l_quantity END AS result,
               CASE WHEN l_orderkey % 18 = 0 THEN 'Clotted' END AS no_result_reason,
               CASE WHEN l_returnflag = 'R' THEN 'High' END AS range_flag,
               CASE WHEN l_linestatus = 'F' THEN 'Clinically Significant' END AS significance,
               CASE WHEN l_tax > 0.03 THEN concat('E', CAST(l_orderkey AS STRING)) END AS event_code,
               CAST(l_shipdate AS DATE) AS first_entry, l_orderkey AS record_id
        FROM {{lineitem}}""",
    "lab_system": """
        SELECT l.subject, CASE WHEN record_id % 7 = 0 THEN b.sample_date + 1 ELSE b.sample_date END AS sample_date,
               test, CASE WHEN record_id % 5 = 0 THEN result + 1 ELSE result END AS result
        FROM {lab_results} l JOIN
             (SELECT subject, visit, COALESCE(hem_date, bio_date) AS sample_date FROM {bloods}) b
             ON l.subject = b.subject AND l.visit = b.visit""",
    "births": """
        SELECT s_suppkey AS subject, DATE '1986-01-15' + CAST((s_suppkey * 37) % 4200 AS INT) AS birth_date
        FROM {supplier}""",
    "films": """
        SELECT o_custkey AS subject,
               CASE WHEN o_orderkey % 8 < 7 THEN 'Malaria case report' ELSE 'Visit 1' END AS visit,
               concat('E', CAST(o_orderkey % 5 AS STRING)) AS episode, CAST(o_orderdate AS DATE) AS sample_date,
               CASE l_linestatus WHEN 'F' THEN 'Blood film for Plasmodium species'
                    ELSE 'A P. falciparum rapid diagnosis test (RDT)' END AS sample_type,
               CASE WHEN l_linestatus = 'F' THEN CASE l_returnflag WHEN 'A' THEN 'Negative for Plasmodium species'
                    WHEN 'N' THEN 'Positive for Plasmodium species' END END AS film_result,
               CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN 'Positive for Plasmodium falciparum'
                    ELSE 'Negative' END END AS rdt_result,
               CAST(l_shipdate AS DATE) AS first_entry, l_partkey AS record_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "panel_films": """
        SELECT l_suppkey AS subject, concat('Visit ', CAST(l_linenumber AS STRING)) AS visit,
               'Blood film for Plasmodium species' AS sample_type,
               CASE l_returnflag WHEN 'A' THEN 'Negative' WHEN 'N' THEN 'Positive' END AS film_result
        FROM {lineitem}""",
    "extra_samples": """
        SELECT o_custkey AS subject, CASE WHEN o_orderkey % 3 <> 0 THEN 'Yes' ELSE 'No' END AS collected,
               CASE WHEN o_orderkey % 12 <> 5 THEN CAST(o_orderdate AS DATE) END AS sample_date,
               CASE o_orderkey % 4 WHEN 0 THEN 'Microbiology' WHEN 1 THEN 'Serology, blood' END AS test_category,
               concat('Sample ', CAST(o_orderkey % 2 AS STRING)) AS sample_type,
               concat('Test, ', substr(o_orderpriority, 1, 1)) AS test
        FROM {orders}""",
    "local_ae": """
        SELECT user_id AS subject, CAST(event_id % 6 + 1 AS STRING) AS dose_code,
               CASE event_id % 6 WHEN 0 THEN 'Dose 1' WHEN 1 THEN 'Dose 2' WHEN 2 THEN 'Dose 3' END AS post_dose,
               event_type AS term, CAST(ts AS DATE) AS onset,
               CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) + 4 END AS resolution,
               CASE WHEN event_id % 17 <> 0 THEN concat('Grade ', CAST(event_id % 4 + 1 AS STRING)) END AS severity,
               CASE event_id % 5 WHEN 0 THEN 'Recovering / Resolving' WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Not recovered'
                    ELSE 'Recovered / Resolved without sequelae' END AS outcome,
               CASE WHEN event_id % 7 = 0 THEN 'Yes' ELSE 'No' END AS ongoing
        FROM {events}""",
    "systemic_ae": """
        SELECT user_id AS subject,
               CASE event_id % 6 WHEN 0 THEN 'Dose 1' WHEN 1 THEN 'Dose 2' WHEN 2 THEN 'Booster 1' END AS post_dose,
               concat('S ', event_type) AS term, CAST(ts AS DATE) AS onset,
               CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) + 2 END AS resolution,
               CASE WHEN event_id % 17 <> 0 THEN concat('Grade ', CAST(event_id % 4 + 1 AS STRING)) END AS severity,
               CASE event_id % 4 WHEN 0 THEN 'Recovering / Resolving' WHEN 1 THEN 'Fatal'
                    ELSE 'Recovered / Resolved without sequelae' END AS outcome
        FROM {events}""",
    "unsolicited_ae": """
        SELECT user_id AS subject, CASE WHEN event_id % 10 <> 3 THEN 'Yes' ELSE 'No' END AS any_event,
               concat('AE', CAST(event_id % 40 AS STRING)) AS ae_code,
               CASE event_id % 9 WHEN 0 THEN 10040644 WHEN 1 THEN 10039906 WHEN 2 THEN 10061273
                    ELSE 10000000 + event_id % 9 END AS term_code,
               CASE WHEN event_type <> 'error' THEN concat('T ', event_type) END AS high_term,
               CASE WHEN event_id % 23 <> 0 THEN CAST(ts AS DATE) END AS onset,
               CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 9 END AS resolution,
               CASE WHEN event_id % 17 <> 0 THEN concat('Grade ', CAST(event_id % 4 + 1 AS STRING)) END AS severity,
               CASE event_id % 6 WHEN 0 THEN 'Recovering / Resolving' WHEN 1 THEN 'Not recovered' WHEN 2 THEN 'Fatal'
                    WHEN 3 THEN 'Lost to follow-up / Unknown'
                    ELSE 'Recovered / Resolved without sequelae' END AS outcome,
               CAST(ts AS DATE) AS first_entry, CAST(ts AS DATE) + CAST(event_id % 30 AS INT) AS last_entry,
               event_id AS record_id
        FROM {events}""",
    "clinic_visits": """
        SELECT CASE WHEN event_type IN ('view', 'click', 'signup') THEN user_id ELSE user_id + 1000000000 END AS subject,
               concat('V ', event_type) AS visit, CAST(ts AS DATE) AS visit_date,
               CAST(ts AS DATE) + CAST(event_id % 2 AS INT) AS first_entry
        FROM {events}""",
    "clinic_forms": """
        SELECT CASE WHEN event_type <> 'purchase' THEN user_id ELSE user_id + 2000000000 END AS subject,
               concat('V ', event_type) AS visit, CAST(ts AS DATE) AS visit_date,
               CASE event_id % 5 WHEN 0 THEN 'Not Started' WHEN 1 THEN 'Incomplete' ELSE 'Complete' END AS entry_status,
               CASE WHEN event_id % 13 <> 0
                    THEN concat('Staff ', CAST(event_id % 6 AS STRING)) END AS entered_by
        FROM {events}""",
    "medications": """
        SELECT o_custkey AS subject, concat('Visit ', CAST(l_linenumber AS STRING)) AS visit,
               CASE l_returnflag WHEN 'A' THEN 'Malaria' WHEN 'N' THEN 'Fever' END AS indication,
               CASE WHEN l_linenumber < 7 THEN concat('E', CAST(l_linenumber AS STRING)) END AS episode,
               CASE l_partkey % 5 WHEN 0 THEN 'Artemether-lumefantrine' WHEN 1 THEN 'Lumefantrine'
                    WHEN 2 THEN 'Paracetamol' WHEN 3 THEN 'Amoxicillin' END AS generic_name,
               concat('Brand ', CAST(l_partkey AS STRING)) AS brand_name, CAST(l_shipdate AS DATE) AS start_date,
               CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'No' END AS ongoing,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 3 END AS stop_date,
               concat(CAST(l_suppkey AS STRING), ' x ', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS frequency,
               CAST(o_orderdate AS DATE) AS first_entry, CAST(l_shipdate AS DATE) AS last_entry
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "dosing": """
        SELECT o_custkey AS subject,
               CASE o_orderpriority WHEN '1-URGENT' THEN '    Dose 1' WHEN '2-HIGH' THEN 'Dose 2'
                    WHEN '3-MEDIUM' THEN 'Dose 3' WHEN '4-NOT SPECIFIED' THEN 'Booster' ELSE 'Booster 2' END AS visit
        FROM {orders}
        UNION ALL
        SELECT c_custkey AS subject, CASE WHEN c_custkey % 2 = 0 THEN '    Dose 1' ELSE 'Dose 2' END AS visit
        FROM {customer}""",
    "haematology": """
        SELECT l_suppkey AS serial_study_id, CAST(l_shipdate AS DATE) AS date_collect,
               CASE WHEN l_linenumber < 6 THEN 1 ELSE 2 END AS fk_study,
               l_quantity AS wbc, l_discount AS rbc, l_tax AS hgb, l_quantity + 1 AS hct, l_quantity + 2 AS mcv,
               l_extendedprice AS plt, l_quantity / 2 AS ne, l_quantity / 4 AS ly, l_tax * 2 AS mo_1,
               CASE WHEN l_returnflag = 'A' THEN l_tax END AS eo_1, l_discount * 2 AS ba_1, l_quantity / 8 AS ne_1,
               l_quantity / 16 AS ly_1
        FROM {lineitem} WHERE l_linestatus = 'F'""",
    "chemistry": """
        SELECT l_suppkey AS serial_study_id, CAST(l_shipdate AS DATE) AS date_collect,
               CASE WHEN l_linenumber < 6 THEN 1 ELSE 2 END AS fk_study,
               l_quantity AS ALT, l_discount AS T_Bilirubin, l_extendedprice AS Plasma_Creatinine
        FROM {lineitem} WHERE l_linestatus = 'O'""",
}


def _needs(sql: str) -> list[str]:
    found = re.findall(r"\{(\w+)\}", sql)
    return list(dict.fromkeys(n for n in found if n in TABLES or n in LISTINGS))


class Listings:
    """Listing DataFrames over one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in LISTINGS):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
            else:
                sql = LISTINGS[name]
                self._made[name] = self._spark.sql(sql, **{n: getattr(self, n) for n in _needs(sql)})
        return self._made[name]


def with_listings(body: str) -> str:
    """SQL for the checker: the listings named in braces as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in LISTINGS and name not in order:
            for n in _needs(LISTINGS[name]):
                visit(n)
            order.append(name)

    for name in _needs(body):
        visit(name)

    def plain(sql: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES or m[1] in LISTINGS else m[0], sql)

    ctes = ",\n".join(f"{n} AS ({plain(LISTINGS[n])})" for n in order)
    body = plain(body).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
