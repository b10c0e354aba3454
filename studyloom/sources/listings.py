"""Study listings: CSV extracts read as text and conformed to typed columns.

Columns are found by header name, so a file that gains a column still loads.
Where only the place of a column is known the place is given instead, and
where every header is replaced the file must have exactly that many columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.fixed_values import POST_DOSE_CODES, POST_DOSE_LABELS
from studyloom.functions import blank_to_null, not_in, parse_date, recode, replace_first, to_number, with_level
from studyloom.operators.reshape import first_per
from studyloom.sources.quoted import read_quoted_csv

# Date layouts of the extracts.
ISO = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"]
DAY_MONTH_NAME = ["d-MMM-yyyy", "d-MMM-yyyy H:mm", *ISO]
DAY_FIRST = ["d M yyyy", *ISO]
YEAR_FIRST = ["yyyy M d", *ISO]
SLASHED = ["d/M/yyyy", *ISO]
DASHED = ["d-M-yyyy H:mm", "d-M-yyyy"]


@dataclass(frozen=True)
class Field:
    """One output column: a header name or a 1-based place, and its type."""

    name: str
    source: str | int
    kind: str = "string"
    layouts: tuple[str, ...] = ()


def text(name: str, source: str | int) -> Field:
    return Field(name, source)


def number(name: str, source: str | int) -> Field:
    return Field(name, source, "double")


def whole(name: str, source: str | int) -> Field:
    return Field(name, source, "long")


def day(name: str, source: str | int, layouts: list[str]) -> Field:
    return Field(name, source, "date", tuple(layouts))


@dataclass(frozen=True)
class Listing:
    file: str
    fields: tuple[Field, ...]
    # Number of columns of a file whose headers are all replaced by place.
    width: int | None = None
    # Columns that must have a value, and columns limited to some values.
    required: tuple[str, ...] = ()
    keep: Mapping[str, str] = field(default_factory=dict)
    # Whether people type text into it, which may hold line ends.
    free_text: bool = False


_ENTRY = (day("first_entry", "First Data Time", DAY_MONTH_NAME), day("last_entry", "Last Data Time", DAY_MONTH_NAME))


def _solicited(kind: str) -> tuple[Field, ...]:
    return (
        whole("subject", "Subject"),
        text("visit", "VISIT"),
        text("post_dose", f"{kind} solicited adverse event observed post dose"),
        text("term", f"{kind} solicited adverse event term"),
        day("onset", "Date of onset", DAY_MONTH_NAME),
        text("ongoing", "Ongoing"),
        day("resolution", "Date of resolution", DAY_MONTH_NAME),
        text("severity", "Severity grade"),
        text("outcome", "Outcome"),
        *_ENTRY,
    )


LISTINGS: dict[str, Listing] = {
    "vaccination": Listing(
        "Study Vaccination Listing.csv",
        (whole("subject", "Subject"), text("visit", "VISIT"), day("dose_date", "Date of vaccination", DAY_MONTH_NAME)),
    ),
    "eligibility": Listing(
        "Eligibility Assessment Listing.csv",
        (
            whole("subject", 2), text("visit", 3), text("earlier_vaccine", 11), text("birth_defect", 15),
            text("underweight", 19), text("long_illness", 20), text("recent_vaccine", 22), text("immune_condition", 24),
            text("other", 25), text("details", 26),
        ),
        width=29,
        free_text=True,
    ),
    "participants": Listing(
        "participants.csv",
        (
            whole("subject", "screenId"), text("group", "group"), text("current_status", "currentStatus"),
            text("site", "Site"), text("consent_v6", "consentV6_0Accept"), text("consent_v7", "consentV7_0Accept"),
            # The two columns of each consent version, of which one is its answer.
            text("consent_v6_one", 13), text("consent_v6_two", 14), text("consent_v7_one", 15), text("consent_v7_two", 16),
        ),
    ),
    "randomisation": Listing(
        "Visit Completed v_s SDV.csv",
        (whole("subject", "Subject Id"), text("rand", 3), text("visit", "VISITNAME")),
        keep={"visit": "Screening"},
    ),
    "end_of_study": Listing(
        "End Of Study Listing.csv",
        (
            whole("site_id", "Site ID"), whole("subject", "Subject"), text("visit", "VISIT"),
            day("completion_date", "Protocol completion or discontinuation date", DAY_MONTH_NAME),
            text("reason", "Reason for completion or discontinuation"), *_ENTRY,
        ),
        required=("completion_date",),
        free_text=True,
    ),
    "date_of_visit": Listing(
        "Date Of Visit Listing.csv",
        (
            whole("subject", "Subject"), text("visit", "VISIT"), day("visit_date", "Visit date", DAY_MONTH_NAME),
            *_ENTRY,
        ),
    ),
    "schedule": Listing(
        "group_schedule_village.csv",
        (
            whole("subject", "screenID"), text("visit_code", "visitCode"), day("window_open", "windowOpen", DAY_FIRST),
            day("scheduled_date", "scheduledDate", DAY_FIRST), day("rescheduled_date", "rescheduledDate", DAY_FIRST),
            day("exact_date", "exactDate", DAY_FIRST), day("window_close", "windowClose", DAY_FIRST),
            text("group", "group"), text("site", "Site"),
        ),
    ),
    "queries": Listing(
        "QueryReports.csv",
        (
            whole("subject", "Subject ID"), text("visit", "Visit"), text("module", "Module Name"),
            text("field", "Field Name"), text("query_text", "Query Text"), text("query_type", "Query Type"),
            text("query_status", "Query Status"), text("query_id", "Query ID"),
        ),
        free_text=True,
    ),
    "visit_forms": Listing(
        "Visit Completed v_s SDV_2.csv",
        (
            whole("subject", "Subject Id"), text("visit", "VISITNAME"), text("module", "FORMNAME"),
            day("visit_date", "VISDAT", YEAR_FIRST), text("entry_status", "EntryStatus"),
            text("entered_by", "Entered By"), day("entered_on", "Entered Date-Time", YEAR_FIRST),
            text("ecrf_signoff", "Investigator Sign Off Status"),
            text("source_signoff", "eSource - Investigator Sign Off Status"),
        ),
    ),
    "bloods": Listing(
        "Blood Sample Collection Listing.csv",
        (
            whole("subject", 2), text("visit", 3), text("hem", 4), day("hem_date", 5, DAY_MONTH_NAME), text("bio", 9),
            day("bio_date", 10, DAY_MONTH_NAME), text("dbs", 15), day("dbs_date", 16, DAY_MONTH_NAME),
        ),
    ),
    "films": Listing(
        "Blood Sample For Plasmodium Species Results Listing.csv",
        (
            whole("subject", 2), text("visit", 3), text("episode", 4), day("sample_date", 5, DAY_MONTH_NAME),
            text("sample_type", 6), text("film_result", 7), text("rdt_result", 21), day("first_entry", 22, DAY_MONTH_NAME),
        ),
        width=23,
    ),
    "lab_results": Listing(
        "Haematology And Biochemistry Listing.csv",
        (
            whole("subject", 2), text("visit", 3), text("test", 6), number("result", 8),
            text("no_result_reason", "Reason for No Result"), text("range_flag", 12), text("significance", 13),
            text("event_code", 14), day("first_entry", "First Data Time", DAY_MONTH_NAME),
        ),
    ),
    "lab_system": Listing(
        "lab system results.csv",
        (
            whole("subject", "Subject"), day("sample_date", "sampledate", ISO), text("test", "Test"),
            number("result", "Result"),
        ),
    ),
    "births": Listing(
        "Demographics Listing.csv",
        (whole("subject", "Subject"), day("birth_date", "Date of Birth", [*DAY_FIRST, *DAY_MONTH_NAME])),
    ),
    "extra_samples": Listing(
        "Sample For Additional Laboratory Listing.csv",
        (
            whole("subject", "Subject"), text("visit", "VISIT"),
            text("collected", "Was sample collected for additional analysis?"),
            day("sample_date", "Date of sample collection", DAY_MONTH_NAME), text("test_category", "Test Category"),
            text("sample_type", "Type of sample"), text("test", "Test name"),
        ),
        keep={"collected": "Yes"},
    ),
    "local_ae": Listing(
        "Local Solicited Adverse Event Listing.csv", _solicited("Local"), required=("outcome",)
    ),
    "systemic_ae": Listing(
        "Systemic Solicited Adverse Event Listing.csv", _solicited("Systemic"), required=("outcome",)
    ),
    "unsolicited_ae": Listing(
        "Unsolicited Adverse Event Listing.csv",
        (
            whole("subject", "Subject"), text("any_event", "Did the subject experience any unsolicited adverse event?"),
            text("ae_code", "Unsolicited adverse event code"),
            whole("term_code", "Adverse Event Preferred Term Code"),
            text("high_term", "Adverse Event High Level Term"), day("onset", "Date of onset", DAY_MONTH_NAME),
            day("resolution", "Date of resolution", DAY_MONTH_NAME), text("severity", "Severity grade"),
            text("outcome", "Outcome"), *_ENTRY,
        ),
        required=("outcome",),
        free_text=True,
    ),
    "medications": Listing(
        "Prior Or Concomitant Medications Listing.csv",
        (
            whole("subject", "Subject"), text("visit", "VISIT"), text("indication", "Indication"),
            text("episode", "Event code / Episode number"), text("generic_name", "Generic Name / Active Ingredients"),
            text("brand_name", 8), day("start_date", "Start date", SLASHED), text("ongoing", "Ongoing"),
            day("stop_date", "Stop date", SLASHED), text("frequency", 17), *_ENTRY,
        ),
        free_text=True,
    ),
    "dosing": Listing("Dosing Summary.csv", (whole("subject", "Participant Id"), text("visit", "VISIT"))),
}


def read_csv(spark: SparkSession, path: str, quoted_lines: bool = False) -> DataFrame:
    """All columns as text; large files are split either way. `quoted_lines` keeps line ends inside quotes, headers apart."""
    plain = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    return read_quoted_csv(spark, path, plain.columns) if quoted_lines else plain


def _typed(col: Column, source: T.DataType, wanted: Field) -> Column:
    if wanted.kind == "date":
        if isinstance(source, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return col.cast("date")
        return parse_date(col, list(wanted.layouts))
    if wanted.kind == "long":
        return F.trim(col.cast("string")).try_cast("bigint")
    if wanted.kind == "double":
        return to_number(col)
    return col.cast("string")


def conform(raw: DataFrame, listing: Listing) -> DataFrame:
    """Blank text to null, then typed columns under their own names."""
    if listing.width is not None and len(raw.columns) != listing.width:
        raise ValueError(f"{listing.file}: {len(raw.columns)} columns, expected {listing.width}")
    # Headers may repeat or hold dots, so work goes by unique place names.
    headers = raw.columns
    types = [f.dataType for f in raw.schema.fields]
    placed = blank_to_null(raw.toDF(*[f"c{i}" for i in range(1, len(headers) + 1)]))
    columns = []
    for f in listing.fields:
        if isinstance(f.source, int):
            place = f.source
        else:
            found = [i for i, h in enumerate(headers, 1) if h == f.source]
            if not found:
                raise ValueError(f"{listing.file}: no column {f.source!r}")
            place = found[0]
        if place > len(headers):
            raise ValueError(f"{listing.file}: no column {place}")
        columns.append(_typed(F.col(f"c{place}"), types[place - 1], f).alias(f.name))
    out = placed.select(*columns)
    for name in listing.required:
        out = out.filter(F.col(name).isNotNull())
    for name, value in listing.keep.items():
        out = out.filter(F.col(name) == value)
    return out


def load(
    spark: SparkSession,
    folder: str,
    name: str,
    test_subjects: Iterable[int] = (),
    site_merges: Mapping[str, str] | None = None,
    bad_symbol: str = "\ufffd",
    path: str | None = None,
    quoted_lines: bool | None = None,
) -> DataFrame:
    """One conformed listing with the cleaning that belongs to it; line ends inside quotes are looked for in listings of free text."""
    quoted_lines = LISTINGS[name].free_text if quoted_lines is None else quoted_lines
    raw = read_csv(spark, path or f"{folder}/{LISTINGS[name].file}", quoted_lines)
    return clean(conform(raw, LISTINGS[name]), name, test_subjects, site_merges, bad_symbol)


def clean(
    df: DataFrame,
    name: str,
    test_subjects: Iterable[int] = (),
    site_merges: Mapping[str, str] | None = None,
    bad_symbol: str = "\ufffd",
) -> DataFrame:
    """The cleaning that belongs to one conformed listing."""
    test_subjects = list(test_subjects)
    if test_subjects and name in ("eligibility", "randomisation"):
        df = df.filter(not_in("subject", test_subjects))
    if name == "randomisation":
        df = first_per(df, ["subject"], ["rand"])
    elif name == "schedule" and site_merges:
        df = df.withColumn("site", recode("site", site_merges))
    elif name == "queries":
        df = replace_first(df, "query_text", bad_symbol, "_")
    elif name in ("local_ae", "systemic_ae"):
        df = with_level(df, "post_dose", POST_DOSE_CODES, POST_DOSE_LABELS)
    return df
