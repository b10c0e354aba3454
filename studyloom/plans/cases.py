"""Treatment cases and laboratory-confirmed cases, by the dose before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.fixed_values import CASE_DOSES, CASE_VISIT, FILM, FILM_NEGATIVE, RDT, RDT_POSITIVE
from studyloom.functions import has_text, numeric_suffix, with_level
from studyloom.operators.asof import last_of_labels
from studyloom.operators.crosstab import add_total_row, count_by, share
from studyloom.operators.joins import join_ns
from studyloom.operators.reshape import Order, arrange, number_counts, number_within


def drug_records(medications: DataFrame, date_of_visit: DataFrame, drug_pattern: str = "lumef|Lumef") -> DataFrame:
    """Medication records of the treatment drug, with the visits of that day.

    Equal visit records are one row here; `visit_rows` says how many there
    are, so that counts can weigh them without listing every pair.
    """
    drugs = medications.filter(has_text("generic_name", drug_pattern))
    visits = count_by(
        date_of_visit.select("subject", "visit_date", F.col("visit").alias("timepoint")),
        "subject", "visit_date", "timepoint", name="visit_rows",
    )
    joined = join_ns(drugs, visits, ["subject", ("first_entry", "visit_date")])
    return joined.withColumn("visit_rows", F.coalesce("visit_rows", F.lit(1)))


def treatment_cases(drugs: DataFrame, indication: str = "Malaria") -> DataFrame:
    return drugs.filter(F.col("indication") == indication)


def ongoing_treatment(drugs: DataFrame) -> DataFrame:
    return drugs.filter(F.col("ongoing") == "Yes")


def _case_doses(vaccination: DataFrame) -> DataFrame:
    name = F.when(F.col("visit") == "2B0 Vaccination", "2B0").otherwise(F.col("visit"))
    return vaccination.select("subject", "dose_date", name.alias("dose"))


def with_last_dose(cases: DataFrame, vaccination: DataFrame, case_date: str) -> DataFrame:
    """Add `last_dose`, null for a case before every dose, and `days_since`."""
    return last_of_labels(cases, _case_doses(vaccination), "subject", case_date, "dose_date", "dose", CASE_DOSES)


def dose_shares(
    cases: DataFrame, vaccination: DataFrame, case_date: str, digits: int = 0, matched_only: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Cases per last dose with rounded percentages and a total row.

    Cases are counted per subject and day first, so a subject with very many
    of them still enters the join as a few rows. `weight` names a column that
    says how many cases a row stands for.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    days = cases.groupBy("subject", case_date).agg(size.alias("rows"))
    placed = with_last_dose(days, vaccination, case_date)
    if matched_only:
        placed = placed.filter(F.col("last_dose").isNotNull())
    return share_table(placed, "last_dose", digits, weight=F.col("rows"))


def share_table(rows: DataFrame, by: str, digits: int, weight: Column | None = None) -> DataFrame:
    """Share per dose in dose order; the total row sums the rounded percentages."""
    rank = f"{by}_rank"
    shares = with_level(share(rows, by, digits, weight), by, CASE_DOSES)
    table = add_total_row(shares, by, ["n", "percentage"])
    return _percent_text(arrange(table, rank, F.col(by) == "Total"), digits).drop(rank)


def _percent_text(table: DataFrame, digits: int) -> DataFrame:
    text = F.regexp_replace(F.bround("percentage", digits).cast("string"), r"\.0$", "")
    return table.withColumn("percentage", F.concat(text, F.lit("%")))


def positive_films(films: DataFrame) -> DataFrame:
    """Case-report films that are not negative."""
    result = F.col("film_result")
    return films.filter(
        (F.col("visit") == CASE_VISIT) & (F.col("sample_type") == FILM) & result.isNotNull() & (result != FILM_NEGATIVE)
    )


def positive_rdts(films: DataFrame) -> DataFrame:
    return films.filter(
        (F.col("visit") == CASE_VISIT) & (F.col("sample_type") == RDT) & (F.col("rdt_result") == RDT_POSITIVE)
    )


def film_rdt_overlap(films: DataFrame) -> DataFrame:
    """Positive films with each positive rapid test of the same episode and day.

    Equal rapid tests are one row; `rdt_rows` says how many there are.
    """
    keys = ["subject", "visit", "episode", "sample_date"]
    tests = positive_rdts(films).select(*keys, F.col("rdt_result").alias("rdt_test_result"), F.col("first_entry").alias("rdt_first_entry"))
    counted = count_by(tests, *keys, "rdt_test_result", "rdt_first_entry", name="rdt_rows")
    return join_ns(positive_films(films), counted, keys, "inner")


CASE_ORDER: tuple[Order, ...] = ("sample_date", "episode", "film_result", "first_entry")


def numbered_cases(
    films: DataFrame, vaccination: DataFrame, order: Sequence[Order] = CASE_ORDER, prefix: str = "MLR-"
) -> DataFrame:
    """Laboratory cases after a dose, numbered within the subject by sample date.

    `case_number_all` counts every case, `case_number` only those after a dose.
    """
    placed = with_last_dose(positive_films(films), vaccination, "sample_date")
    matched = F.col("last_dose").isNotNull()
    numbers = {"case_number_all": None, "case_number": matched}
    return number_within(placed, "subject", order, numbers, prefix).filter(matched)


def case_number_table(films: DataFrame, vaccination: DataFrame, digits: int = 1, prefix: str = "MLR-") -> DataFrame:
    """How many subjects reached each case number, cases before any dose left out.

    Cases enter as counts per subject and day; no row is numbered for this.
    """
    days = positive_films(films).groupBy("subject", "sample_date").agg(F.count(F.lit(1)).alias("rows"))
    matched = with_last_dose(days, vaccination, "sample_date").filter(F.col("last_dose").isNotNull())
    counts = number_counts(matched, "subject", "place", weight=F.col("rows"))
    shares = share(counts, "place", digits, weight=F.col("n"))
    labelled = shares.withColumn("case_number", F.concat(F.lit(prefix), F.col("place").cast("string")))
    table = add_total_row(labelled, "case_number", ["n", "percentage"])
    ordered = arrange(table, numeric_suffix("case_number", len(prefix) + 1).asc_nulls_last())
    return _percent_text(ordered, digits).drop("place")
