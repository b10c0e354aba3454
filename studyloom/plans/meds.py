"""Concomitant medications: linked records, open lists and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.functions import not_in, null_if_zero
from studyloom.operators.crosstab import add_total_row, count_by, count_where
from studyloom.operators.reshape import Order, arrange
from studyloom.plans.records import link_records

MED_ORDER: tuple[Order, ...] = (
    "start_date", "first_entry", "indication", "brand_name", "ongoing", "stop_date", "frequency", "last_entry", "visit",
)
NO_NAME = "Name missing"


def clean_medications(medications: DataFrame, entries: DataFrame, order: Sequence[Order] = MED_ORDER) -> DataFrame:
    """One row per subject, episode and drug with the staff that entered it."""
    linked = link_records(medications, entries, ["subject", "episode", "generic_name"], order)
    return linked.filter(F.col("indication").isNotNull() & F.col("episode").isNotNull()).select(
        "subject",
        F.col("linked_visit").alias("visit"),
        F.col("first_entry").alias("entry_date"),
        "indication",
        "episode",
        "generic_name",
        "brand_name",
        "start_date",
        "ongoing",
        "stop_date",
        "frequency",
        "last_entry",
        F.coalesce("entered_by", F.lit(NO_NAME)).alias("entered_by"),
    )


def open_closed(meds: DataFrame) -> DataFrame:
    state = F.when(F.col("stop_date").isNotNull(), "Closed").otherwise("Open")
    return add_total_row(count_by(meds.withColumn("state", state), "state", name="count"), "state", ["count"])


def open_medications(meds: DataFrame, roster: Sequence[str], other: str = "Other staff") -> DataFrame:
    """Medications without stop date by owner; staff off the roster are folded together."""
    owner = F.when(not_in("entered_by", [*roster, NO_NAME]), F.lit(other)).otherwise(F.col("entered_by"))
    return meds.filter(F.col("stop_date").isNull()).withColumns({"staff": F.col("entered_by"), "owner": owner})


def open_summary(opened: DataFrame, as_of: date, open_days: int = 14) -> DataFrame:
    tests = {"open": F.lit(True), "open_long": F.datediff(F.lit(as_of), "start_date") > open_days}
    counts = count_where(opened, ["owner"], tests).withColumn("open_long", null_if_zero("open_long"))
    return arrange(counts, "-open", "owner")


def open_list(opened: DataFrame, owner: str) -> DataFrame:
    return opened.filter(F.col("owner") == owner)
