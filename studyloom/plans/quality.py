"""Data queries, record completeness, sign-off and protocol deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.fixed_values import QUERY_STATUS_LEVELS, QUERY_TYPES, VISIT_CODE_MAP, VISIT_LEVELS
from studyloom.functions import date_text, matches_text, recode, strip_punctuation, to_number, with_level
from studyloom.operators.crosstab import add_total_row, count_by, crosstab
from studyloom.operators.joins import exclude_pairs, join_ns
from studyloom.operators.reshape import Order, arrange, first_per


def query_table(queries: DataFrame, types: Sequence[str] = QUERY_TYPES) -> DataFrame:
    """Queries by status and type with totals, statuses in display order."""
    table = crosstab(queries, "query_status", "query_type", types)
    levels = [*QUERY_STATUS_LEVELS, "Total"]
    ranked = with_level(table.withColumn("__label", F.col("query_status")), "__label", levels)
    # A status outside the list comes just before the total.
    place = F.when(F.col("query_status") == "Total", len(levels)).otherwise(F.coalesce("__label_rank", F.lit(len(levels) - 0.5)))
    return ranked.orderBy(place, F.asc_nulls_last("query_status")).drop("__label", "__label_rank")


def query_totals(queries: DataFrame) -> DataFrame:
    """All, automatic, manual and open queries as one row."""
    return queries.agg(
        F.count(F.lit(1)).alias("generated"),
        F.count_if(F.col("query_type") == "Automatic").alias("automatic"),
        F.count_if(F.col("query_type") == "Manual").alias("manual"),
        F.count_if(F.col("query_status") == "Open Query").alias("open"),
    )


def open_queries(queries: DataFrame, date_of_visit: DataFrame, visit_forms: DataFrame) -> DataFrame:
    """Open queries with visit date and entering staff, free of punctuation.

    Fails when an open query matches two form records.
    """
    opened = queries.filter(F.col("query_status") == "Open Query").select(
        "subject", "visit", "module", "field", "query_text", "query_id"
    )
    # Only dates are taken over, so repeated ones need not be paired.
    visits = date_of_visit.select("subject", "visit", "visit_date").distinct()
    dated = join_ns(opened, visits, ["subject", "visit"])
    forms = visit_forms.select("subject", "visit", "module", "entered_by")
    entered = join_ns(dated, forms, ["subject", "visit", "module"], expect="m:1")
    listed = entered.distinct().drop("query_id")
    return strip_punctuation(
        listed.select(
            "subject",
            "visit",
            date_text("visit_date").alias("visit_date"),
            "module",
            "field",
            "query_text",
            F.coalesce("entered_by", F.lit("Pending Entry")).alias("entered_by"),
        )
    )


def open_by_module(opened: DataFrame) -> DataFrame:
    return arrange(count_by(opened, "module", name="count"), "-count", "module")


def incomplete_records(visit_forms: DataFrame, known: Sequence[tuple] = ()) -> DataFrame:
    """Incomplete forms, less the (subject, visit) pairs known to stay so."""
    rows = visit_forms.filter(F.col("entry_status") == "Incomplete").select(
        "subject", "visit", "visit_date", "module", "entry_status", "entered_by"
    )
    return exclude_pairs(rows, ["subject", "visit"], known)


def signoff_pending(visit_forms: DataFrame, stage: str = "source") -> DataFrame:
    """Started forms waiting for the investigator at the source or the case-report form."""
    waiting = (F.col("entry_status") != "Not Started") & (F.col("source_signoff") == "Pending")
    if stage == "ecrf":
        waiting = waiting & (F.col("ecrf_signoff") == "Pending")
    elif stage != "source":
        raise ValueError(f"unknown stage {stage}")
    return visit_forms.filter(waiting)


def signoff_totals(visit_forms: DataFrame) -> DataFrame:
    """Forms waiting at either stage as one row."""
    source = (F.col("entry_status") != "Not Started") & (F.col("source_signoff") == "Pending")
    return visit_forms.agg(
        F.count_if(source).alias("source_pending"),
        F.count_if(source & (F.col("ecrf_signoff") == "Pending")).alias("ecrf_pending"),
    )


def out_of_window(schedule: DataFrame) -> DataFrame:
    """Visits done after their window closed."""
    return schedule.filter(F.datediff("exact_date", "window_close") > 0)


def _out_by_code(schedule: DataFrame) -> DataFrame:
    ranked = with_level(out_of_window(schedule), "visit_code", VISIT_LEVELS)
    return count_by(ranked, "visit_code", "visit_code_rank", name="local")


def _in_visit_order(table: DataFrame, sums: Sequence[str]) -> DataFrame:
    return add_total_row(table, "visit_code", sums, order=[F.asc_nulls_last("visit_code_rank")]).drop("visit_code_rank")


def out_of_window_counts(schedule: DataFrame) -> DataFrame:
    """Visits out of window per code, in visit order, total last."""
    return _in_visit_order(_out_by_code(schedule), ["local"])


def deviations(queries: DataFrame, order: Sequence[Order] = ("query_id",)) -> DataFrame:
    """Visit-date queries that speak of a deviation, one per subject and visit."""
    rows = queries.filter(
        F.col("field").isin("Visit date", "Date of vaccination")
        & (F.col("visit") != "Screening")
        & ~matches_text("visit", "Unscheduled|Pre-vacc")
        & matches_text("query_text", "Difference between|Visit Date is missing.")
    )
    one_each = first_per(rows, ["subject", "visit"], order)
    return one_each.select(
        to_number("subject").cast("long").alias("subject"),
        recode("visit", VISIT_CODE_MAP).alias("visit_code"),
        "module",
        "field",
        "query_text",
        "query_status",
    )


def deviation_table(found: DataFrame, schedule: DataFrame) -> DataFrame:
    """Deviations seen in queries next to visits out of window, per visit code."""
    both = join_ns(count_by(found, "visit_code", name="source"), _out_by_code(schedule), "visit_code")
    ranks = with_level(both.drop("visit_code_rank").withColumn("__code", F.col("visit_code")), "__code", VISIT_LEVELS)
    return _in_visit_order(ranks.withColumnRenamed("__code_rank", "visit_code_rank").drop("__code"), ["source", "local"])


def open_deviations(found: DataFrame) -> DataFrame:
    return found.filter(F.col("query_status") == "Open Query")
