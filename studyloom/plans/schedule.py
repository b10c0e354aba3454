"""Visit schedule: status table, worklists, the weeks before and after."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.fixed_values import ARMS, IMMUNOLOGY_VISITS, VISIT_LEVELS
from studyloom.functions import (
    has_text,
    null_if_zero,
    weekday_name,
    weekday_order,
    weekday_rank,
    with_level,
)
from studyloom.operators.crosstab import add_total_row, count_where, crosstab, percent_text
from studyloom.operators.reshape import Order, arrange, first_per, to_long

STATUS_NAMES = {"scheduled": "Scheduled", "actual": "Actual", "due": "Due visit", "missed": "Missed"}


def status_rules(as_of: date, rule: str) -> dict[str, Column]:
    """Status tests of one schedule row.

    The printed table and the chart differ: a window closing on the as-of day
    is still due in the table and missed in the chart, and only the chart
    looks at rescheduled dates. Both are kept.
    """
    today = F.lit(as_of)
    scheduled, closes = F.col("scheduled_date"), F.col("window_close")
    done, open_ = F.col("exact_date").isNotNull(), F.col("exact_date").isNull()
    if rule == "table":
        return {
            "scheduled": (scheduled <= today) | done,
            "actual": done,
            "due": (scheduled <= today) & open_ & (closes >= today),
            "missed": (closes < today) & open_ & (scheduled < today),
        }
    if rule == "chart":
        planned = F.coalesce("rescheduled_date", "scheduled_date") <= today
        return {
            "scheduled": planned,
            "actual": planned & done,
            "due": planned & open_ & (closes > today),
            "missed": planned & open_ & (closes <= today),
        }
    raise ValueError(f"unknown rule {rule}")


def visit_table(schedule: DataFrame, as_of: date, enrolled: int) -> DataFrame:
    """Scheduled, done, due and missed per visit code, with rates and totals."""
    ranked = with_level(schedule, "visit_code", VISIT_LEVELS)
    counts = count_where(ranked, ["visit_code", "visit_code_rank"], status_rules(as_of, "table"))
    counts = counts.filter(F.col("scheduled") > 0).withColumns(
        {c: null_if_zero(c) for c in ("actual", "due", "missed")}
    )
    counts = counts.withColumn("actual_vs_enrolled", percent_text(F.col("actual"), F.lit(enrolled), 0))
    table = add_total_row(counts, "visit_code", ["scheduled", "actual", "due", "missed"])
    table = table.withColumn("success_rate", percent_text(F.col("actual"), F.col("scheduled"), 1))
    return arrange(table, "visit_code_rank", F.col("visit_code") == "Total").drop("visit_code_rank")


def visit_status_long(schedule: DataFrame, as_of: date) -> DataFrame:
    """One row per planned visit and status it has, for charting."""
    rules = status_rules(as_of, "chart")
    flagged = schedule.filter(rules["scheduled"]).select(
        "subject",
        "visit_code",
        "group",
        *[F.when(test, F.lit(STATUS_NAMES[name])).alias(name) for name, test in rules.items()],
    )
    keys = ["subject", "visit_code", "group"]
    return to_long(flagged, keys, list(rules), "name", "status", drop_null=True).drop("name")


def visit_status_counts(schedule: DataFrame, as_of: date) -> DataFrame:
    """Bar heights: rows per arm, visit code and status, counted before the rows are spread."""
    rules = {STATUS_NAMES[n]: test for n, test in status_rules(as_of, "chart").items()}
    counts = count_where(schedule, ["group", "visit_code"], rules)
    return to_long(counts, ["group", "visit_code"], list(rules), "status", "n").filter("n > 0")


def missed_visits(schedule: DataFrame, as_of: date) -> DataFrame:
    rows = schedule.filter(status_rules(as_of, "table")["missed"])
    return rows.select("subject", "visit_code", "scheduled_date", "group", "site")


def due_visits(schedule: DataFrame, as_of: date) -> DataFrame:
    rows = schedule.filter(status_rules(as_of, "table")["due"])
    return rows.select("subject", "visit_code", "scheduled_date", "group", "site")


def rescheduled_visits(schedule: DataFrame) -> DataFrame:
    return schedule.filter(F.col("rescheduled_date").isNotNull())


def unscheduled_visits(date_of_visit: DataFrame, as_of: date | None = None, last_days: int = 7) -> DataFrame:
    """Unscheduled visits, or with `as_of` only those of the days before it."""
    rows = date_of_visit.filter(has_text("visit", "Unscheduled"))
    if as_of is None:
        return rows
    since = as_of - timedelta(days=last_days)
    return rows.filter((F.col("visit_date") >= F.lit(since)) & (F.col("visit_date") < F.lit(as_of)))


def sites_by_arm(
    schedule: DataFrame, arms: Sequence[str] = ARMS, order: tuple[Order, ...] = ("scheduled_date", "visit_code", "site", "group")
) -> DataFrame:
    """Participants by site and arm, each counted once by its first schedule row."""
    one_each = first_per(schedule, ["subject"], order)
    return crosstab(one_each, "site", "group", arms)


def last_week_visits(schedule: DataFrame, as_of: date) -> DataFrame:
    """Visits done in the seven days before `as_of`; later ones pass too, only that day does not."""
    rows = schedule.filter(
        (F.col("exact_date") != F.lit(as_of)) & (F.col("exact_date") > F.lit(as_of - timedelta(days=8)))
    )
    return rows.withColumn("weekday", weekday_name("exact_date"))


def weekday_table(rows: DataFrame, by: list[str], day: str, as_of: date) -> DataFrame:
    """Per group the count and percentage of each weekday, starting at the as-of weekday."""
    rank = weekday_rank(day, as_of)
    names = weekday_order(as_of)
    counts = rows.groupBy(*by).agg(
        F.count(day).alias("n"), *[F.count_if(rank == i).alias(f"n_{d.lower()}") for i, d in enumerate(names)]
    )
    ratio = {
        f"pct_{d.lower()}": F.round(
            F.try_divide(F.col(f"n_{d.lower()}").cast("decimal(20,0)") * 100, F.col("n").cast("decimal(20,0)")), 1
        ).cast("double")
        for d in names
    }
    return counts.withColumns(ratio)


def next_week_visits(schedule: DataFrame, as_of: date, days: int = 6) -> DataFrame:
    """Open visits planned or replanned within `days` of `as_of`, one per subject and visit."""
    first, last = F.lit(as_of), F.lit(as_of + timedelta(days=days))
    soon = F.col("scheduled_date").between(first, last) | F.col("rescheduled_date").between(first, last)
    rows = schedule.filter(soon & F.col("exact_date").isNull()).select(
        "subject",
        "visit_code",
        F.coalesce("rescheduled_date", "scheduled_date").alias("target_date"),
        "site",
        "group",
    )
    one_each = first_per(rows, ["subject", "visit_code"], ["target_date", "site", "group"])
    return one_each.withColumn("weekday", weekday_name("target_date"))


def immunology_due(
    schedule: DataFrame, as_of: date, within: int = 8, group: str = "Group A", visits: list[str] = IMMUNOLOGY_VISITS
) -> DataFrame:
    """Open visits with an immunology sample, overdue ones included."""
    rows = schedule.withColumn("target_date", F.coalesce("rescheduled_date", "scheduled_date")).filter(
        F.col("visit_code").isin(visits)
        & (F.col("group") == group)
        & (F.datediff("target_date", F.lit(as_of)) <= within)
        & F.col("exact_date").isNull()
    )
    return rows.select("subject", "visit_code", "target_date", "group", "site").withColumn(
        "weekday", weekday_name("target_date")
    )
