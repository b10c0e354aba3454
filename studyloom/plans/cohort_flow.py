"""Participant flow: analysis base, exclusion reasons, all named cohorts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.fixed_values import (
    ACTIVE,
    COHORT_LABELS,
    COMPLETED,
    DOSE_COLUMNS,
    EXCLUDED_STATUS,
    LOST,
    NOT_ENROLLED_STATUS,
    WITHDRAWAL_STATUSES,
)
from studyloom.functions import has_text, not_in
from studyloom.operators.cohort import counts_long, reason_index, with_label
from studyloom.operators.joins import join_ns
from studyloom.operators.reshape import presence_wide
from studyloom.session import steady


def analysis_base(
    eligibility: DataFrame,
    vaccination: DataFrame,
    participants: DataFrame,
    randomisation: DataFrame,
    test_subjects: Iterable[int] = (),
) -> DataFrame:
    """Eligibility rows with dose flags, follow-up status and randomisation number."""
    base = eligibility
    if test_subjects := list(test_subjects):
        base = base.filter(not_in("subject", test_subjects))
    # All three joins share one shuffle of the row table. When a subject turns
    # out to be hot the session settings let Spark split it join by join.
    doses = presence_wide(vaccination, ["subject"], "visit", DOSE_COLUMNS)
    base = join_ns(base, doses, "subject")
    base = join_ns(base, participants, "subject")
    return join_ns(base, randomisation.select("subject", "rand"), "subject")


def exclusion_reasons(strict: bool = False, not_rand: Column | None = None) -> list[tuple[str, Column]]:
    """Reasons in the order they are tried; `not_rand` says who is not randomised, those without `rand` if not given.

    Two reasons take an eligibility answer of Yes even from a randomised
    subject, because "and" binds before "or" in the rule; `strict` asks for
    "not randomised" on both halves.
    """
    not_rand = F.col("rand").isNull() if not_rand is None else not_rand

    def either(flag: str, pattern: str) -> Column:
        yes, said = F.col(flag) == "Yes", has_text("details", pattern)
        return (yes | said) & not_rand if strict else yes | (said & not_rand)

    return [
        ("earlier_vaccine", (F.col("earlier_vaccine") == "Yes") & not_rand),
        ("birth_defect", (F.col("birth_defect") == "Yes") & not_rand),
        ("underweight", (F.col("underweight") == "Yes") & not_rand),
        ("long_illness", (F.col("long_illness") == "Yes") & not_rand),
        ("recent_vaccine", either("recent_vaccine", "vaccine")),
        ("immune_condition", either("immune_condition", "HIV")),
        ("closure", (F.col("other") == "Closure of enrolment") & not_rand),
        ("early_withdrawal", (F.col("other") == "Consent withdrawal") & not_rand),
    ]


def row_cohorts(arm_threshold: int) -> dict[str, str]:
    """Cohorts that are a plain SQL test on a screened row."""
    arms = {"a": f"subject <= {int(arm_threshold)}", "b": f"subject > {int(arm_threshold)}"}
    status = "current_status = '{}'".format
    active, lost = status(ACTIVE), status(LOST)
    withdrawn = f"current_status IN ({', '.join(repr(s) for s in WITHDRAWAL_STATUSES)})"
    plain = {
        "enr": "dose_1 IS NOT NULL",
        "recvac1": "dose_1 IS NOT NULL",
        "on_active_fu": active,
        "pi_discretion": status("Terminated due to PI discretion"),
        "consent_withdrawal": status("Consent withdrawal"),
        "blood_volume": status("Blood volume Issues"),
        "vac_error": status("Terminated due to dosing error"),
        "fup_done": status(COMPLETED),
        "ltfup": lost,
        "sae_death": status("SAE resulting to death"),
        "withdrawal": withdrawn,
    }
    by_arm = {
        "vac_grp": "dose_1 IS NOT NULL", "group_{}_enr": "dose_1 IS NOT NULL", "active": active, "ltf": lost,
        "withdrawal": withdrawn,
    }
    for i, column in enumerate(DOSE_COLUMNS.values(), 1):
        plain[f"vacc{i}"] = f"{column} IS NOT NULL"
        if i > 1:
            by_arm[f"vac{i}_grp"] = f"{column} IS NOT NULL"
    for v in ("v6", "v7"):
        plain[f"consent_{v}_yes"] = by_arm[v] = f"consent_{v} = 'Yes'"
        plain[f"consent_{v}_no"] = f"consent_{v} = 'No'"
        plain[f"consent_{v}_yet"] = f"consent_{v} IS NULL AND {active}"
    split = {
        name.format(arm) if "{}" in name else f"{name}_{arm}": f"{test} AND {in_arm}"
        for name, test in by_arm.items()
        for arm, in_arm in arms.items()
    }
    return plain | split


def flow_counts(base: DataFrame, arm_threshold: int, strict: bool = False) -> DataFrame:
    """Rows of every cohort with label and box text.

    One shuffle on the subject: its first reason and all cohort counts come
    out of the same partial aggregate, and adding up subjects needs no join.
    """
    screened = F.col("visit").isNotNull()
    reasons = exclusion_reasons(strict)
    rows = base.withColumns({"__in": screened, "__idx": F.when(screened, reason_index(reasons))})
    cohorts = row_cohorts(arm_threshold)
    per_subject = rows.groupBy("subject").agg(
        F.expr("min(__idx)").alias("__first"),
        F.expr("count(1)").alias("full"),
        F.expr("count_if(__in)").alias("screened"),
        F.expr("coalesce(bool_or(__in AND dose_1 IS NOT NULL), false)").alias("__enrolled"),
        *[F.expr(f"count_if(__idx = {i})").alias(name) for i, (name, _) in enumerate(reasons, 1)],
        *[F.expr(f"count_if(__in AND {test})").alias(name) for name, test in cohorts.items()],
    )
    sums = {"full": "full", "screened": "screened"}
    sums |= {name: f"CASE WHEN __first = {i} THEN {name} END" for i, (name, _) in enumerate(reasons, 1)}
    sums["randomized"] = "CASE WHEN __first IS NULL THEN screened END"
    sums["excluded"] = "CASE WHEN __first IS NOT NULL THEN screened END"
    sums["rand_no_enr"] = "CASE WHEN __first IS NULL AND NOT __enrolled THEN screened END"
    sums |= {name: name for name in cohorts}
    totals = {name: F.expr(f"coalesce(sum({value}), 0)") for name, value in sums.items()}
    return with_label(counts_long(per_subject, totals), COHORT_LABELS)


def subject_profile(
    answers: DataFrame, vaccination: DataFrame, participants: DataFrame, randomisation: DataFrame
) -> DataFrame:
    """What a subject's rows have in common: first_reason, enrolled and the participant columns.

    `answers` holds subject, `if_not` and `if_rand`: the place of the first
    reason a row meets if the subject is not randomised and if it is. Each
    listing enters as a narrow aggregate per subject before the joins. A
    subject listed several times as participant or randomised comes several
    times.
    """
    met = answers.groupBy("subject").agg(F.min("if_not").alias("if_not"), F.min("if_rand").alias("if_rand"))
    rand = randomisation.groupBy("subject").agg(
        F.count(F.lit(1)).alias("rand_rows"), F.bool_or(F.col("rand").isNull()).alias("some_not"), F.bool_or(F.col("rand").isNotNull()).alias("some_rand")
    )
    first_dose = next(visit for visit, column in DOSE_COLUMNS.items() if column == "dose_1")
    dosed = vaccination.filter(F.col("visit") == first_dose).select("subject", F.lit(True).alias("enrolled")).distinct()
    out = join_ns(join_ns(met, rand, "subject"), dosed, "subject")
    # Without a randomisation row, or beside one without a number, the answers count as those of one not randomised.
    some_not = F.coalesce("some_not", F.lit(True))
    first = F.least(F.when(some_not, F.col("if_not")), F.when(F.col("some_rand"), F.col("if_rand")))
    out = out.select("subject", first.alias("first_reason"), F.coalesce("enrolled", F.lit(False)).alias("enrolled"), F.coalesce("rand_rows", F.lit(1)).alias("rand_rows"))
    out = join_ns(out, participants, "subject")
    return out.withColumn("rand_rows", F.explode(F.sequence(F.lit(1).cast("long"), "rand_rows"))).drop("rand_rows")


def required_eos(
    eligibility: DataFrame,
    vaccination: DataFrame,
    participants: DataFrame,
    randomisation: DataFrame,
    test_subjects: Iterable[int] = (),
    strict: bool = False,
) -> DataFrame:
    """Screening rows that need an end-of-study record, tagged before or after enrolment.

    A row that belongs to several of the cohorts is listed once for each. The
    rows and the profile of their subjects come from one narrow table that is
    written once, so every listing is read once.
    """
    screened = eligibility.filter(F.col("visit").isNotNull())
    if test_subjects := list(test_subjects):
        screened = screened.filter(not_in("subject", test_subjects))
    places = {name: reason_index(exclusion_reasons(strict, F.lit(free))) for name, free in (("if_not", True), ("if_rand", False))}
    answers = steady(screened.select("subject", "other", *[place.alias(name) for name, place in places.items()]))
    profile = subject_profile(answers, vaccination, participants.select("subject", "group", "current_status", "site"), randomisation)
    rows = join_ns(answers.select("subject", "other"), profile, "subject", "inner")
    gone = F.col("first_reason").isNotNull()
    status = F.col("current_status")
    tags = F.array_compact(
        F.array(
            F.when(gone, F.lit(EXCLUDED_STATUS)),
            F.when(~gone & ~F.col("enrolled"), F.lit(NOT_ENROLLED_STATUS)),
            F.when(status.isin(LOST, COMPLETED, *WITHDRAWAL_STATUSES), status),
        )
    )
    return rows.select(
        "subject",
        "group",
        "other",
        F.explode(tags).alias("current_status"),
        "site",
        F.when(F.col("site").isNull(), "Before Enr").otherwise("After Enr").alias("time"),
    )
