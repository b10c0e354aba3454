"""Samples, result completeness, reconciliation and range checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.fixed_values import (
    CHEMISTRY_TESTS,
    FILM,
    HAEMATOLOGY_TESTS,
    LAB_RANGES,
    MISSING_CODE_TEXT,
    MISSING_SIGNIFICANCE_TEXT,
    RANGE_QUERY_SUBJECT,
    SIGNIFICANT,
)
from studyloom.functions import months_complete, recode, to_number
from studyloom.operators.cohort import counts_long
from studyloom.operators.crosstab import add_total_col, add_total_row, count_by, count_where
from studyloom.operators.joins import anti, band_join, inline_table, join_agg, join_ns
from studyloom.operators.reshape import Order, first_per, union_fill, union_same

# Sample flag column of each sample type.
SAMPLE_FLAGS = {"film": "dbs", "haematology": "hem", "chemistry": "bio"}
PANELS = {"haematology": HAEMATOLOGY_TESTS, "chemistry": CHEMISTRY_TESTS}


def period_rules(as_of: date) -> dict[str, str]:
    """SQL tests: a sample row is recent when any of its three dates is; future dates pass too."""
    def within(days: int) -> str:
        # The smallest distance decides; missing dates are skipped.
        gaps = ", ".join(f"datediff(DATE'{as_of.isoformat()}', {c})" for c in ("hem_date", "bio_date", "dbs_date"))
        return f"coalesce(least({gaps}) < {days}, false)"

    return {"overall": "true", "month": within(30), "week": within(7)}


def _sample_tests(as_of: date) -> dict[tuple[str, str], Column]:
    return {
        (period, kind): F.expr(f"coalesce({flag} = 'Yes', false) AND {rule}")
        for period, rule in period_rules(as_of).items()
        for kind, flag in SAMPLE_FLAGS.items()
    }


def sample_rows(bloods: DataFrame, as_of: date) -> DataFrame:
    """Collected samples as rows per period and sample type, from one scan."""
    tags = [
        F.when(test, F.struct(F.lit(p).alias("period"), F.lit(k).alias("sample")))
        for (p, k), test in _sample_tests(as_of).items()
    ]
    tagged = bloods.withColumn("__tag", F.explode(F.array_compact(F.array(*tags))))
    return tagged.select("__tag.period", "__tag.sample", *bloods.columns)


def sample_counts(bloods: DataFrame, as_of: date) -> DataFrame:
    """Samples collected per period and sample type."""
    names = {f"{p}|{k}": F.count_if(t) for (p, k), t in _sample_tests(as_of).items()}
    counts = counts_long(bloods, names)
    return counts.select(
        F.substring_index("cohort", "|", 1).alias("period"), F.substring_index("cohort", "|", -1).alias("sample"), "n"
    )


def complete_panel(
    results: DataFrame,
    keys: Sequence[str],
    test_col: str,
    result_col: str,
    panels: Mapping[str, Sequence[str]],
    order: Sequence[Order],
) -> DataFrame:
    """One row per key with a flag per panel: every test of it has a result.

    Of repeated results of one test only the first in `order` counts.
    """
    one_each = first_per(results, [*keys, test_col], order)
    has_result = F.col(result_col).isNotNull()
    flags = []
    for name, tests in panels.items():
        # Repeats are gone, so a panel is complete when as many rows have a result as it has tests.
        filled = F.count_if(F.col(test_col).isin(list(tests)) & has_result)
        flags.append((filled == len(set(tests))).alias(name))
    return one_each.groupBy(*keys).agg(*flags)


def _lab_panels(labs: DataFrame, order: Sequence[Order]) -> DataFrame:
    # A stated reason for a missing result counts as a result.
    shown = labs.withColumn("shown", F.coalesce(F.col("result").cast("string"), "no_result_reason"))
    return complete_panel(shown, ["subject", "visit"], "test", "shown", PANELS, order)


def _films(films: DataFrame) -> DataFrame:
    rows = films.filter((F.col("sample_type") == FILM) & F.col("film_result").isNotNull())
    return rows.groupBy("subject", "visit").agg(F.count(F.lit(1)).alias("film"))


LAB_ORDER: tuple[Order, ...] = ("first_entry", "result", "no_result_reason")


def results_matrix(
    bloods: DataFrame, films: DataFrame, labs: DataFrame, as_of: date, lab_order: Sequence[Order] = LAB_ORDER
) -> DataFrame:
    """Expected, entered and pending results per period and sample type.

    Samples, film counts and panel flags are stacked and grouped once by
    subject and visit, which does the work of two joins. A film sample counts
    once per film result it has.
    """
    tests = _sample_tests(as_of)
    names = {pair: f"__{'_'.join(pair)}" for pair in tests}
    keys = ["subject", "visit"]
    samples = bloods.select(*keys, *[t.cast("long").alias(names[p]) for p, t in tests.items()])
    results = [_films(films), _lab_panels(labs, lab_order)]
    kinds = list(SAMPLE_FLAGS)
    joined = (
        union_fill(samples, *results)
        .groupBy(*keys)
        .agg(
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names.values()],
            *[F.coalesce(F.max(F.col(k).cast("long")), F.lit(0)).alias(k) for k in kinds],
        )
    )
    found = {k: F.col(k) for k in kinds}
    measures = {
        "Expected": lambda n, hit: F.sum(n),
        "Entered": lambda n, hit: F.sum(n * hit),
        "Pending": lambda n, hit: F.sum(F.when(hit == 0, n).otherwise(0)),
    }
    plan = [("Expected", "overall"), ("Pending", "overall")]
    plan += [(m, p) for p in ("month", "week") for m in ("Expected", "Entered", "Pending")]
    wording = {"overall": "overall", "month": "this month", "week": "this week"}
    cells = joined.agg(
        *[
            F.coalesce(measures[m](F.col(names[(p, k)]), found[k]), F.lit(0)).alias(f"{m}_{p}_{k}")
            for m, p in plan
            for k in SAMPLE_FLAGS
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{m} {wording[p]}").alias("measure"), *[F.col(f"{m}_{p}_{k}").alias(k) for k in SAMPLE_FLAGS]
            )
            for m, p in plan
        ]
    )
    return add_total_col(cells.select(F.inline(rows)), list(SAMPLE_FLAGS), "total")


def _entered(films: DataFrame, labs: DataFrame, lab_order: Sequence[Order]) -> DataFrame:
    """Subject, visit and sample type with complete results, and how many results."""
    complete = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in PANELS]))
    panels = _lab_panels(labs, lab_order).select(
        "subject", "visit", F.explode(complete).alias("sample"), F.lit(1).cast("long").alias("results")
    )
    film_rows = _films(films).select("subject", "visit", F.lit("film").alias("sample"), F.col("film").alias("results"))
    return union_same(panels, film_rows)


def pending_results(
    bloods: DataFrame, films: DataFrame, labs: DataFrame, as_of: date, lab_order: Sequence[Order] = LAB_ORDER
) -> DataFrame:
    """Collected samples without results, per period and sample type."""
    return anti(sample_rows(bloods, as_of), _entered(films, labs, lab_order), ["subject", "visit", "sample"])


def entered_results(
    bloods: DataFrame, films: DataFrame, labs: DataFrame, as_of: date, lab_order: Sequence[Order] = LAB_ORDER
) -> DataFrame:
    """Collected samples with complete results; `results` counts the films read."""
    return join_ns(sample_rows(bloods, as_of), _entered(films, labs, lab_order), ["subject", "visit", "sample"], "inner")


def source_results(labs: DataFrame, bloods: DataFrame) -> DataFrame:
    """Entered results with the sample date from the collection record.

    `collection_rows` says how many collection records of the visit have that
    date, instead of repeating the result for each.
    """
    dates = bloods.select("subject", "visit", F.coalesce("hem_date", "bio_date").alias("sample_date"))
    dated = count_by(
        dates.filter(F.col("sample_date").isNotNull()), "subject", "visit", "sample_date", name="collection_rows"
    )
    rows = labs.filter(F.col("no_result_reason").isNull())
    joined = join_ns(rows, dated, ["subject", "visit"], "inner")
    return joined.select("subject", "visit", "sample_date", "test", "result", "collection_rows")


def reconcile(labs: DataFrame, bloods: DataFrame, lab_system: DataFrame) -> DataFrame:
    """Entered results with no equal record in the laboratory system."""
    keys = ["subject", "sample_date", "test", "result"]
    mine = source_results(labs, bloods).withColumn("result", to_number("result"))
    theirs = lab_system.select(
        to_number("subject").cast("long").alias("subject"),
        F.col("sample_date").cast("date").alias("sample_date"),
        "test",
        to_number("result").alias("result"),
    )
    return anti(mine, theirs, keys)


def mismatch_subjects(mismatched: DataFrame) -> DataFrame:
    return mismatched.select("subject", "visit").distinct()


def _bands(df: DataFrame, ranges: Sequence[tuple[str, int, int, float, float]] | DataFrame) -> DataFrame:
    """The range list as a table, with the words a review text uses for the test."""
    if isinstance(ranges, DataFrame):
        cols = [F.col("test").alias("r_test"), *(F.col(c).cast("int").alias(c) for c in ("age_lo", "age_hi")), *(F.col(c).cast("double").alias(c) for c in ("lo", "hi"))]
        return ranges.select(*cols, recode("test", RANGE_QUERY_SUBJECT).alias("subject_text"))
    rows = [(t, int(a), int(b), float(lo), float(hi), RANGE_QUERY_SUBJECT.get(t, t)) for t, a, b, lo, hi in ranges]
    return inline_table(df, rows, "r_test string, age_lo int, age_hi int, lo double, hi double, subject_text string")


def _mean_width(bands: Sequence[tuple[int, int]]) -> int:
    return max(1, round(sum(b - a + 1 for a, b in bands) / max(1, len(bands))))


def range_check(
    labs: DataFrame,
    births: DataFrame,
    ranges: Sequence[tuple[str, int, int, float, float]] | DataFrame = LAB_RANGES,
    screening: str = "Screening",
    order: Sequence[Order] = (
        "first_entry", "result", "no_result_reason", "range_flag", "significance", "event_code",
    ),
) -> DataFrame:
    """Results to review: outside the age band's range, or incompletely assessed.

    Of several birth dates of a subject the earliest counts. The range list, rows
    or a table (test, age_lo, age_hi, lo, hi), may have any length: bands are filed
    by test and cell of months, and a result meets those of its cell only.
    """
    one_each = first_per(labs, ["subject", "visit", "test"], order)
    dated = join_agg(one_each, births, "subject", {"birth_date": F.min("birth_date")})
    aged = dated.withColumn("age_months", months_complete("birth_date", "first_entry"))
    width = None if isinstance(ranges, DataFrame) else _mean_width([(a, b) for _, a, b, *_ in ranges])
    banded = band_join(aged, _bands(aged, ranges), [("test", "r_test")], "age_months", "age_lo", "age_hi", width)
    no_range = F.col("range_flag").isNull()
    outside = ~F.col("result").between(F.col("lo"), F.col("hi")) & no_range & F.col("no_result_reason").isNull()
    text = F.coalesce(
        F.when(outside, F.concat(F.lit("Review "), "subject_text", F.lit(" and/ or range"))),
        F.when(~no_range & F.col("significance").isNull(), F.lit(MISSING_SIGNIFICANCE_TEXT)),
        F.when((F.col("significance") == SIGNIFICANT) & F.col("event_code").isNull(), F.lit(MISSING_CODE_TEXT)),
    )
    return (
        banded.withColumn("query_text", text)
        .filter((F.col("visit") != screening) & F.col("query_text").isNotNull())
        .select("subject", "visit", "test", "result", "age_months", "query_text", F.col("first_entry").alias("date"))
    )


def extra_sample_table(samples: DataFrame, as_of: date) -> DataFrame:
    """Additional samples by category, test and age, with totals.

    A sample without a date counts as over a year old.
    """
    days = F.datediff(F.lit(as_of), "sample_date")
    age = F.when(days < 31, "month").when(days.between(31, 365), "year").otherwise("older")
    rows = samples.filter(F.col("collected") == "Yes").select(
        F.coalesce("test_category", "sample_type").alias("category"), "test", age.alias("age")
    )
    tests = {
        "this_month": F.col("age") == "month",
        "within_year": F.col("age") == "year",
        "over_a_year": F.col("age") == "older",
    }
    counts = count_where(rows, ["category", "test"], tests, keep_any=True)
    return add_total_row(counts, "category", list(tests), order=[F.asc_nulls_last("category"), F.asc_nulls_last("test")])
