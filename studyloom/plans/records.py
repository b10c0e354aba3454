"""Which visit entry a dated record belongs to, and who entered it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.functions import not_in
from studyloom.operators.joins import join_ns
from studyloom.operators.reshape import Order, first_per, picks_per

ENTRY_ORDER = ("visit", "entered_by", "entry_status")


def _entered_forms(date_of_visit: DataFrame, started: DataFrame) -> DataFrame:
    """Visits with the first form of each by staff, one row per visit and entry day."""
    keys = ["subject", "visit", "visit_date"]
    forms = first_per(started.select(*keys, "entry_status", "entered_by"), keys, ["entered_by", "entry_status"])
    visits = date_of_visit.select(*keys, F.col("first_entry").alias("entry_date")).distinct()
    return join_ns(visits, forms, keys, "inner").select("subject", "entry_date", "visit", "entry_status", "entered_by")


def visit_entries(date_of_visit: DataFrame, visit_forms: DataFrame, skip_visits: Sequence[str] = ()) -> DataFrame:
    """One visit per subject and entry day: the first by visit name, then by staff.

    A later step keeps a single visit per linked record anyway. Taking the
    first here, in the same order, gives the same rows and keeps the joins
    one to one however many forms a visit has.
    """
    started = visit_forms.filter(F.col("entry_status") != "Not Started")
    if skip_visits:
        started = started.filter(not_in("visit", skip_visits))
    entries = _entered_forms(date_of_visit, started)
    return first_per(entries, ["subject", "entry_date"], ENTRY_ORDER)


def visit_entries_by_rule(
    date_of_visit: DataFrame, visit_forms: DataFrame, skips: Mapping[str, Sequence[str]]
) -> DataFrame:
    """One row per subject and entry day with, for each rule, what `visit_entries` picks when that rule's visits are skipped."""
    started = visit_forms.filter(F.col("entry_status") != "Not Started")
    entries = _entered_forms(date_of_visit, started)
    return picks_per(entries, ["subject", "entry_date"], ENTRY_ORDER, {rule: not_in("visit", skip) for rule, skip in skips.items()})


def link_records(
    records: DataFrame, entries: DataFrame, keys: Sequence[str], order: Sequence[Order], entry_col: str = "first_entry"
) -> DataFrame:
    """First record per key, with the visit entered on the same day by the same subject."""
    one_each = first_per(records, keys, order)
    visits = entries.select("subject", "entry_date", F.col("visit").alias("linked_visit"), "entry_status", "entered_by")
    return join_ns(one_each, visits, ["subject", (entry_col, "entry_date")])
