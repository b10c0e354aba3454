"""Ordered exclusion and overlapping cohorts.

A subject leaves at the first reason any of its rows meets. Walking the
reasons with one anti join each gives the same split as one minimum per
subject, which is what is computed here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.operators.joins import join_agg

Reasons = Sequence[tuple[str, Column]]


def reason_index(reasons: Reasons) -> Column:
    """1-based position of the first reason the row itself meets, else null."""
    return F.coalesce(*[F.when(test, F.lit(i)) for i, (_, test) in enumerate(reasons, 1)])


def with_first_reason(df: DataFrame, key: str, reasons: Reasons, **extra: Column) -> DataFrame:
    """Add to every row its own reason `__idx` and its subject's `first_reason`.

    `extra` aggregates per subject are added too. The minimum is taken by a
    partial aggregate and joined back, not by a window, so the rows of one
    very large subject need not meet in one task.
    """
    rows = df.withColumn("__idx", reason_index(reasons))
    return join_agg(rows, rows, key, {"first_reason": F.min("__idx"), **extra})


def waterfall(df: DataFrame, key: str, reasons: Reasons) -> DataFrame:
    """Every row with `excluded` (its subject left) and `reason` (the row counts for it)."""
    names = F.lit([name for name, _ in reasons])
    return with_first_reason(df, key, reasons).withColumns(
        {
            "excluded": F.col("first_reason").isNotNull(),
            "reason": F.when(F.col("__idx") == F.col("first_reason"), names[F.col("__idx") - 1]),
        }
    ).drop("__idx", "first_reason")


def waterfall_counts(df: DataFrame, key: str, reasons: Reasons) -> DataFrame:
    """Row counts per reason, plus `excluded` and `remaining`, with no join.

    Rows are counted per subject and first own reason while the subject
    minimum is taken; one more pass over subjects adds them up.
    """
    names = [name for name, _ in reasons]
    # Counting by row reason inside the subject aggregate keeps one shuffle.
    idx = reason_index(reasons)
    per_subject = df.withColumn("__idx", idx).groupBy(key).agg(
        F.min("__idx").alias("__first"),
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col("__idx") == i).alias(f"__r{i}") for i in range(1, len(names) + 1)],
    )
    gone = F.col("__first").isNotNull()
    sums = {n: F.sum(F.when(F.col("__first") == i, F.col(f"__r{i}"))) for i, n in enumerate(names, 1)}
    sums["excluded"] = F.sum(F.when(gone, F.col("__rows")))
    sums["remaining"] = F.sum(F.when(~gone, F.col("__rows")))
    return counts_long(per_subject, {n: F.coalesce(s, F.lit(0)) for n, s in sums.items()})


def counts_long(df: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
    """One aggregate row turned into (cohort, n) rows."""
    row = df.agg(*[a.alias(n) for n, a in aggregates.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in aggregates)
    return row.select(F.expr(f"stack({len(aggregates)}, {pairs})").alias("cohort", "n"))


def with_label(counts: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Add the display label and the text "label (n = ..)"."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    label = F.coalesce(table[F.col("cohort")], F.col("cohort"))
    return counts.withColumns(
        {"label": label, "text": F.concat(label, F.lit(" (n = "), F.col("n").cast("string"), F.lit(")"))}
    )


def cohort_counts(df: DataFrame, cohorts: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Rows per cohort from one aggregation; cohorts may overlap."""
    counts = counts_long(df, {name: F.count_if(test) for name, (_, test) in cohorts.items()})
    return with_label(counts, {name: label for name, (label, _) in cohorts.items()})


def cohort_members(df: DataFrame, name: str, test: Column) -> DataFrame:
    return df.filter(test).select(F.lit(name).alias("cohort"), "*")


def cohort_rows(df: DataFrame, cohorts: Mapping[str, Column], name: str = "cohort") -> DataFrame:
    """Rows of several cohorts in one scan; a row in two cohorts appears twice."""
    tags = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in cohorts.items()]))
    return df.withColumn(name, F.explode(tags))


def arm(col: str, threshold: int, low: str = "Group A", high: str = "Group B") -> Column:
    """Study arm from an id range."""
    return F.when(F.col(col) <= threshold, low).when(F.col(col) > threshold, high)
