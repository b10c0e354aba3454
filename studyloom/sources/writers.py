"""Worklist output. Lists are sorted here, where a person will read them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.operators.reshape import arrange
from studyloom.session import shared_dir
from studyloom.sources.listings import LISTINGS

# Worklist name -> reading order. Lists kept per staff member are one list
# written by team.
WORKLISTS: dict[str, tuple[str, ...]] = {
    "consent_v6_yes": ("subject",),
    "consent_v6_no": ("subject",),
    "consent_v6_pending": ("subject",),
    "consent_v7_yes": ("subject",),
    "consent_v7_no": ("subject",),
    "consent_v7_pending": ("subject",),
    "signoff_pending_source": ("subject", "visit", "module"),
    "signoff_pending_ecrf": ("subject", "visit", "module"),
    "pending_film": ("subject", "visit"),
    "pending_haematology": ("subject", "visit"),
    "pending_chemistry": ("subject", "visit"),
    "open_medications": ("subject", "episode", "generic_name"),
    "mismatched_results": ("subject", "sample_date", "test"),
    "ongoing_treatment": ("subject", "start_date"),
    "scheduled_next_week": ("target_date", "site", "group", "visit_code", "subject"),
    "out_of_range_results": ("subject", "date", "visit", "test"),
    "open_events": ("subject", "ae_code"),
    "open_queries": ("subject", "visit", "module", "field"),
    "grade_three_events": ("subject", "ae_code"),
    "required_eos": ("group", "other", "subject"),
    "pending_eos": ("group", "current_status", "subject"),
}


#: Rows of a run that one task sorts and writes, about.
ROWS_PER_TASK = 400_000


def write_worklist(df: DataFrame, folder: str, name: str, max_rows_per_file: int = 1_000_000) -> str:
    """One named CSV list in its reading order, as a folder of header files."""
    order = [c for c in WORKLISTS.get(name, ()) if c in df.columns]
    rows = arrange(df, *order) if order else df
    path = f"{folder}/{name}"
    rows.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", max_rows_per_file).csv(path)
    return path


def write_by_team(
    df: DataFrame, folder: str, name: str, team_col: str = "team", max_rows_per_file: int = 1_000_000
) -> str:
    """One folder per team from a single pass; a large team just gets more files."""
    path = f"{folder}/{name}"
    order = [c for c in WORKLISTS.get(name, ()) if c in df.columns]
    # A team's rows meet in as few tasks as their size asks for, so files are neither tiny nor one task's burden.
    rows = df.hint("rebalance", F.col(team_col)).sortWithinPartitions(team_col, *order)
    rows.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", max_rows_per_file).partitionBy(
        team_col
    ).csv(path)
    return path


def extract_columns(df: DataFrame) -> DataFrame:
    """The long laboratory extract under the headers its listing is loaded by."""
    return df.select(
        F.col("subject").alias("Subject"), F.col("sample_date").alias("sampledate"), F.col("test").alias("Test"),
        F.col("result").alias("Result"),
    )


def write_extract(df: DataFrame, folder: str) -> str:
    """The long laboratory extract, where `load(.., "lab_system")` finds it."""
    path = f"{folder}/{LISTINGS['lab_system'].file}"
    extract_columns(df).write.mode("overwrite").option("header", True).csv(path)
    return path


# ------------------------------------------------ all lists of a run at once


def _line(columns: Sequence[Column]) -> Column:
    return F.to_csv(F.struct(*columns), {"emptyValue": '""', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})


def _place(df: DataFrame, order: Sequence[str]) -> Column:
    """The reading order of a list as an array that sorts alike for all lists: missing values last, numbers as numbers."""
    parts = []
    for c in order:
        number = isinstance(df.schema[c].dataType, T.NumericType)
        n = F.col(f"`{c}`").cast("decimal(38,9)") if number else F.lit(None).cast("decimal(38,9)")
        t = F.lit(None).cast("string") if number else F.col(f"`{c}`").cast("string")
        parts.append(F.struct(F.col(f"`{c}`").isNull().alias("missing"), n.alias("n"), t.alias("t")))
    return F.array(*parts) if parts else F.array().cast("array<struct<missing:boolean,n:decimal(38,9),t:string>>")


def write_run(lists: Mapping[str, DataFrame], folder: str, run: str, team_col: str = "team", max_rows_per_file: int = 1_000_000) -> DataFrame:
    """All worklists of a run in one job: folder/lists/run=../list=../team=../ holds CSV files of that list's own columns.

    A list with the column `team_col` is kept by team, others under the team
    "all". Rows come in the list's reading order. Once the files are written
    their rows are counted, and the counts become the run's manifest. A run
    without one is not finished and no reader sees it, so the lists of a run
    that broke off are never mixed with older ones. Gives back the manifest:
    list, team, columns, n.
    """
    if not lists:
        raise ValueError("a run needs a list")
    spark = next(iter(lists.values())).sparkSession
    tagged, headers = [], []
    for name, df in lists.items():
        shown = [c for c in df.columns if c != team_col]
        team = F.coalesce(F.col(team_col).cast("string"), F.lit("none")) if team_col in df.columns else F.lit("all")
        order = [c for c in WORKLISTS.get(name, ()) if c in shown]
        tagged.append(df.select(F.lit(name).alias("list"), team.alias("team"), _place(df, order).alias("place"), _line([F.col(f"`{c}`") for c in shown]).alias("value")))
        headers.append((name, ",".join(shown)))
    # Bytes of a shuffle say little about the memory a sort takes, as lists compress well: tasks are cut by rows, which are written once to be counted.
    kept, all_rows = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}", reduce(DataFrame.union, tagged)
    all_rows.write.parquet(kept)
    rows = spark.read.schema(all_rows.schema).parquet(kept)
    tasks = -(-rows.count() // ROWS_PER_TASK)
    # A team's rows meet in as few tasks as their number asks for; equal places are told apart by the row.
    order = "list", "team", "place"
    rows = rows.repartitionByRange(max(tasks, 1), *order, F.xxhash64("value")).sortWithinPartitions(*order)
    path = f"{folder}/lists/run={run}"
    rows.drop("place").write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file).partitionBy("list", "team").text(path)
    written = spark.read.schema("value string, list string, team string").text(path)
    counts = written.groupBy("list", "team").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame(headers, "list string, columns string")
    counts.join(F.broadcast(known), "list").select("list", "team", "columns", "n").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest/run={run}")
    return run_manifest(spark, folder, run)


def run_manifest(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    """Lists, teams, columns and rows of a finished run, the last by name unless one is given."""
    every = spark.read.schema("list string, team string, columns string, n bigint, run string").json(f"{folder}/manifest")
    last = every.agg(F.max("run")).scalar() if run is None else F.lit(run)
    return every.filter(F.col("run") == last).drop("run")


def read_run(spark: SparkSession, folder: str, name: str, run: str | None = None) -> DataFrame:
    """One list of a finished run as text columns, with its team."""
    found = run_manifest(spark, folder, run).filter(F.col("list") == name).first()
    if found is None:
        raise ValueError(f"no finished run holds the list {name}")
    run = run or spark.read.schema("list string, run string").json(f"{folder}/manifest").agg(F.max("run")).first()[0]
    names = found["columns"].split(",")
    lines = spark.read.schema("value string, team string").text(f"{folder}/lists/run={run}/list={name}")
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), {"escape": '"'})
    return lines.select(cells.alias("r"), "team").select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)], "team")


# --------------------------------------------------- extract as a standing hand-over

TAKEN = "lab_extract_taken"


def last_taken(spark: SparkSession, folder: str) -> date | None:
    """The latest sample date the standing extract holds, None before its first run."""
    try:
        return spark.read.schema("sample_date date").parquet(f"{folder}/{TAKEN}").agg(F.max("sample_date")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


#: Dates that one task of the extract writes side by side; rows of further ones are sorted first.
OPEN_DATES = 100


@contextmanager
def _lean_write(spark: SparkSession):
    """Less disk for a write by dates: a task writes a file per date at a time, so that its rows need no sorting, and what was shuffled for the write goes with its end."""
    ours = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_DATES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key, None) for key in ours}
    for key, value in ours.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def update_extract(df: DataFrame, folder: str, late_days: int = 30, by_date: bool = False) -> str:
    """Bring the standing laboratory extract up to `df`; it lies by sample date where `load(.., "lab_system")` finds it.

    Only dates from `late_days` before the last date taken on are read from
    `df` and written, each date as a whole in place of the old one; samples
    without a date are always among them. The date is noted after the files
    are there, so a run that breaks off is simply done again. `by_date` says
    that the rows of a date lie together already; else they are brought together.
    """
    spark = df.sparkSession
    path, since = f"{folder}/{LISTINGS['lab_system'].file}", last_taken(spark, folder)
    if since is not None:
        df = df.filter(F.col("sample_date").isNull() | (F.col("sample_date") >= F.lit(since - timedelta(days=late_days))))
    # The latest date is taken down as the rows are written: the extract is not worked out a second time for it.
    latest = Observation()
    df = df.observe(latest, F.max("sample_date").alias("sample_date"))
    rows = extract_columns(df)
    rows = rows if by_date else rows.hint("rebalance", F.col("sampledate"))
    with _lean_write(spark):
        rows.write.mode("overwrite").option("header", True).option("partitionOverwriteMode", "dynamic").partitionBy("sampledate").csv(path)
    taken = latest.get.get("sample_date")
    if taken is not None:
        spark.createDataFrame([(taken,)], "sample_date date").write.mode("append").parquet(f"{folder}/{TAKEN}")
    return path
