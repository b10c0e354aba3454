"""Adverse events: worklists, links to visit entries, tables and closure."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.fixed_values import CHRONIC_CODES, CLOSED_OUTCOMES, GRADES, RECOVERING
from studyloom.functions import either_text, null_if_zero, with_level
from studyloom.operators.crosstab import add_total_row, count_by, count_where, crosstab
from studyloom.operators.joins import join_ns, split_by_pattern
from studyloom.operators.reshape import Order, arrange, picks_per, union_fill
from studyloom.plans.records import link_records, visit_entries_by_rule

AE_ORDER: tuple[Order, ...] = (
    "onset", "first_entry", "severity", "outcome", "resolution", "term_code", "high_term", "last_entry",
)


def open_solicited(local_ae: DataFrame, systemic_ae: DataFrame) -> DataFrame:
    """Solicited events without a resolution date, tagged by kind."""
    cols = ["subject", "post_dose", "term", "onset", "ongoing"]

    def part(events: DataFrame, kind: str) -> DataFrame:
        return events.filter(F.col("resolution").isNull()).select(
            F.lit(kind).alias("kind"), *[c for c in cols if c in events.columns]
        )

    return union_fill(part(local_ae, "Local Solicited"), part(systemic_ae, "Systemic Solicited"))


def recovering(events: DataFrame, as_of: date) -> DataFrame:
    """Events still recovering, with their age in days."""
    rows = events.filter(F.col("onset").isNotNull() & (F.col("outcome") == RECOVERING))
    return rows.withColumn("days", F.datediff(F.lit(as_of), "onset"))


def link_unsolicited(
    events: DataFrame,
    entries: DataFrame,
    as_of: date,
    chronic: Sequence[int] = CHRONIC_CODES,
    order: Sequence[Order] = AE_ORDER,
    dated_only: bool = True,
) -> DataFrame:
    """One row per subject and event code with the visit and staff that entered it."""
    rows = events.filter(F.col("onset").isNotNull()) if dated_only else events
    linked = link_records(rows, entries, ["subject", "ae_code"], order)
    owner = F.when(F.col("term_code").isin(list(chronic)), "Chronic").otherwise(F.col("entered_by"))
    return linked.withColumns({"entered_by": owner, "days": F.datediff(F.lit(as_of), "onset")})


LIST_COLUMNS = ["subject", "linked_visit", "ae_code", "high_term", "onset", "resolution", "severity", "outcome", "entered_by"]


def grade_three(linked: DataFrame) -> DataFrame:
    return linked.filter((F.col("severity") == "Grade 3") & F.col("onset").isNotNull()).select(*LIST_COLUMNS)


def still_open(linked: DataFrame, min_days: int | None = None) -> DataFrame:
    """Events whose outcome is not final; `min_days` keeps only older ones."""
    rows = linked.filter(~F.col("outcome").isin(CLOSED_OUTCOMES) & F.col("onset").isNotNull())
    if min_days is not None:
        rows = rows.filter(F.col("days") > min_days)
    return rows.select(*LIST_COLUMNS)


def open_by_team(
    opened: DataFrame, teams: Sequence[tuple[str, Sequence[str]]], unlinked_team: str | None = None
) -> DataFrame:
    """Open events listed under each team whose patterns match the staff name.

    Unlinked events go to `unlinked_team` as well; chronic ones form a list of
    their own when linked.
    """
    unlinked = F.col("linked_visit").isNull()
    tests = []
    for team, patterns in teams:
        hit = either_text("entered_by", patterns)
        tests.append((team, hit | unlinked if team == unlinked_team else hit))
    tests.append(("Chronic", either_text("entered_by", ["Chronic"]) & ~unlinked))
    return split_by_pattern(opened, "entered_by", tests)


def outcome_by_grade(events: DataFrame, grades: Sequence[str] = GRADES) -> DataFrame:
    return crosstab(events, "outcome", "severity", grades)


def term_by_grade(events: DataFrame, term: str = "term", grades: Sequence[str] = GRADES, missing: str | None = None) -> DataFrame:
    """Events by term and grade, most of grade 2 first; `missing` names the row of events without a term."""
    rows = events.withColumn(term, F.coalesce(term, F.lit(missing))) if missing else events
    table = crosstab(rows, term, "severity", grades)
    last = F.coalesce(F.col(term) == "Total", F.lit(False))
    return table.orderBy(last, F.desc_nulls_last(f"`{list(grades)[min(1, len(grades) - 1)]}`"), F.asc_nulls_last(term))


def after_dose(events: DataFrame) -> DataFrame:
    """Solicited events with a listed dose."""
    return events.filter(F.col("post_dose").isNotNull())


def reported(events: DataFrame) -> DataFrame:
    """Unsolicited records that do report an event."""
    return events.filter(F.col("any_event") == "Yes")


def grade_three_counts(linked: DataFrame, by: str) -> DataFrame:
    """Grade 3 events by outcome or term, most frequent first, total last."""
    counts = count_by(linked.filter(F.col("severity") == "Grade 3"), by, name="count")
    table = add_total_row(counts, by, ["count"])
    return arrange(table, F.coalesce(F.col(by) == "Total", F.lit(False)), "-count", by)


LINKED_COLUMNS = ["subject", "ae_code", "term_code", "onset", "resolution", "outcome", "first_entry", "last_entry"]


def listed_and_every(
    events: DataFrame,
    date_of_visit: DataFrame,
    visit_forms: DataFrame,
    skip_visits: Sequence[str] = (),
    chronic: Sequence[int] = CHRONIC_CODES,
    every_chronic: Sequence[int] | None = None,
    order: Sequence[str] = AE_ORDER,
) -> DataFrame:
    """Events picked and linked under two rules in one pass, as rows tagged by `rule`.

    `listed` is what `link_unsolicited` gives for dated events and visits that
    are not skipped, `every` what it gives for all events and all visits.
    """
    fields = [c for c in events.columns if c in LINKED_COLUMNS or c in order]
    picks = picks_per(events.select(*fields), ["subject", "ae_code"], order, {"listed": F.col("onset").isNotNull(), "every": F.lit(True)})
    both = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("event")) for rule in ("listed", "every")])
    picked = picks.select("subject", "ae_code", F.explode(both).alias("p")).filter(F.col("p.event").isNotNull())
    picked = picked.select("subject", "ae_code", "p.rule", "p.event.*")
    entries = visit_entries_by_rule(date_of_visit, visit_forms, {"listed": skip_visits, "every": ()})
    linked = join_ns(picked, entries.withColumnsRenamed({"listed": "__listed", "every": "__every"}), ["subject", ("first_entry", "entry_date")])
    own = F.col("rule") == "listed"
    codes = {True: list(chronic), False: list(chronic if every_chronic is None else every_chronic)}
    is_chronic = F.when(own, F.col("term_code").isin(codes[True])).otherwise(F.col("term_code").isin(codes[False]))
    entry = F.when(own, F.col("__listed")).otherwise(F.col("__every"))
    return linked.withColumns(
        {"linked_visit": entry["visit"], "entered_by": F.when(is_chronic, F.lit("Chronic")).otherwise(entry["entered_by"])}
    ).drop("__listed", "__every")


def closure_summary(
    both: DataFrame,
    as_of: date,
    roster: Sequence[str],
    pending: str = "Pending Link",
    open_days: int = 7,
    closed_days: int = 7,
) -> DataFrame:
    """Open, long-open and recently closed events per owner, totals last.

    `both` comes from `listed_and_every`: open events are counted among the
    listed ones, closed ones among all. The owners are those with open events.
    """
    owners = [*roster, "Chronic"]
    listed = F.col("rule") == "listed"
    opened = F.coalesce(listed & ~F.col("outcome").isin(CLOSED_OUTCOMES), F.lit(False))
    recent = F.datediff(F.lit(as_of), "last_entry") <= closed_days
    closed = F.coalesce(~listed & F.col("resolution").isNotNull() & recent, F.lit(False))
    owner = F.when(listed & ~F.coalesce(F.col("entered_by").isin(owners), F.lit(False)), F.lit(pending)).otherwise(F.col("entered_by"))
    long_open = opened & (F.datediff(F.lit(as_of), "onset") > open_days)
    rows = both.filter(opened | closed).withColumn("owner", owner)
    table = count_where(rows, ["owner"], {"open": opened, "open_long": long_open, "closed": closed}).filter("open > 0")
    table = table.withColumns({c: null_if_zero(c) for c in ("open_long", "closed")})
    ranked = with_level(table.withColumn("__owner", F.col("owner")), "__owner", [*sorted(roster), pending, "Chronic"])
    total = add_total_row(ranked.drop("__owner"), "owner", ["open", "open_long", "closed"], order=["__owner_rank"])
    return total.drop("__owner_rank")
