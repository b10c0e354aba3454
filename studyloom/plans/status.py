"""Follow-up status tables, end-of-study reconciliation, consent, dosing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.fixed_values import ACTIVE, ARMS, DOSING_LEVELS
from studyloom.functions import with_level
from studyloom.operators.crosstab import add_total_col, add_total_row, count_by, crosstab_pct
from studyloom.operators.joins import anti, join_ns
from studyloom.operators.reshape import order_columns, to_wide


def site_arm_table(participants: DataFrame, arms: Sequence[str] = ARMS, active_only: bool = False) -> DataFrame:
    """Participants by site and arm as "p% (n)"."""
    rows = participants.filter(F.col("current_status") == ACTIVE) if active_only else participants
    return crosstab_pct(rows, "site", "group", arms)


def required_eos_summary(required: DataFrame) -> DataFrame:
    """Required records by status and time, totals both ways."""
    counts = count_by(required, "current_status", "time", name="freq")
    table = to_wide(
        counts, ["current_status"], "time", "freq", {"Before Enr": "before_enr", "After Enr": "after_enr"}
    )
    total = add_total_row(table, "current_status", ["before_enr", "after_enr"])
    return add_total_col(total, ["before_enr", "after_enr"], "total").orderBy(
        F.coalesce(F.col("current_status") == "Total", F.lit(False)), *order_columns(["before_enr", "-after_enr"])
    )


def eos_pending(required: DataFrame, end_of_study: DataFrame) -> DataFrame:
    """Required but not recorded."""
    return anti(required, end_of_study, "subject")


def eos_not_required(end_of_study: DataFrame, required: DataFrame) -> DataFrame:
    """Recorded but not required."""
    return anti(end_of_study, required, "subject")


def _with_consent(participants: DataFrame, version: str) -> DataFrame:
    col = f"consent_{version}"
    active = participants.filter(F.col("current_status") == ACTIVE)
    return active.withColumn(col, F.coalesce(col, F.lit("Pending")))


def consent_counts(participants: DataFrame, version: str) -> DataFrame:
    """Active participants by answer to one consent version."""
    return count_by(_with_consent(participants, version), f"consent_{version}", name="count")


def consent_list(participants: DataFrame, version: str, answer: str) -> DataFrame:
    """Active participants with one answer: Yes, No or Pending; an answer comes with both columns of its version."""
    col = f"consent_{version}"
    shown = ["subject", "group", "site"] + ([f"{col}_one", f"{col}_two"] if answer != "Pending" else ["current_status"])
    return _with_consent(participants, version).filter(F.col(col) == answer).select(*shown)


def _dose_names(vaccination: DataFrame) -> DataFrame:
    booster_2 = F.when(F.col("visit") == "2B0 Vaccination", "Booster 2").otherwise(F.col("visit"))
    return vaccination.withColumn("visit", F.trim(booster_2))


def dosed_vs_vaccinated(dosing: DataFrame, vaccination: DataFrame) -> DataFrame:
    """Doses given against vaccinations recorded, per dose of the dosing summary."""
    dosed = count_by(with_level(dosing, "visit", DOSING_LEVELS), "visit", "visit_rank", name="dosed")
    given = count_by(with_level(_dose_names(vaccination), "visit", DOSING_LEVELS), "visit", name="vaccinated")
    return join_ns(dosed, given, "visit").orderBy(*order_columns(["visit_rank"])).drop("visit_rank")


def dosed_not_vaccinated(dosing: DataFrame, vaccination: DataFrame, doses: tuple[str, ...] = ("Dose 1", "Dose 2")) -> DataFrame:
    """Dosing rows without a vaccination of the same dose; padding is ignored."""
    dosed = dosing.withColumn("visit", F.trim("visit")).filter(F.col("visit").isin(*doses))
    given = _dose_names(vaccination).filter(F.col("visit").isin(*doses))
    return anti(dosed, given, ["subject", "visit"])
