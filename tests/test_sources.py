import csv
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from studyloom.fixed_values import CHEMISTRY_COLUMNS, HAEMATOLOGY_COLUMNS
from studyloom.plans.extract import lab_extract
from studyloom.sources import writers
from studyloom.sources import (
    LISTINGS,
    WORKLISTS,
    conform,
    last_taken,
    load,
    quoted_records,
    read_csv,
    read_lab_tables,
    read_lab_tables_jdbc,
    read_run,
    run_manifest,
    update_extract,
    write_by_team,
    write_extract,
    write_run,
    write_worklist,
)

# A date in the first layout of each list, all meaning 5 January 2021.
SAMPLES = {
    "yyyy-MM-dd": "2021-01-05", "d-MMM-yyyy": "05-Jan-2021", "d M yyyy": "05 01 2021", "yyyy M d": "2021 01 05",
    "d/M/yyyy": "05/01/2021", "d-M-yyyy H:mm": "05-01-2021 10:00",
}


def _write(path, header, *data):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *data])


def _row(listing, header, **values):
    out = [""] * len(header)
    for f in listing.fields:
        at = f.source - 1 if isinstance(f.source, int) else header.index(f.source)
        default = {"date": SAMPLES[f.layouts[0]] if f.layouts else "", "long": "7", "double": "1.5"}.get(f.kind, "text")
        out[at] = values.get(f.name, default)
    return out


def _header(listing):
    width = listing.width or max([f.source for f in listing.fields if isinstance(f.source, int)] + [0])
    header = [f"column {i}" for i in range(1, width + 1)]
    return header + [f.source for f in listing.fields if isinstance(f.source, str)]


@pytest.mark.parametrize("name", list(LISTINGS))
def test_every_listing_loads(spark, tmp_path, name):
    listing = LISTINGS[name]
    header = _header(listing)
    fixed = {**listing.keep, "post_dose": "1"}
    blank = ["7" if c == "" else "" for c in header]
    _write(tmp_path / listing.file, header, _row(listing, header, **fixed), _row(listing, header, **fixed), blank)
    df = load(spark, str(tmp_path), name)
    kinds = {"string": "string", "long": "bigint", "double": "double", "date": "date"}
    typed = dict(df.dtypes)
    assert all(typed[f.name] == kinds[f.kind] for f in listing.fields)
    first = df.first().asDict()
    for f in listing.fields:
        if f.kind == "date":
            assert first[f.name] == date(2021, 1, 5), f.name
        elif f.kind == "long":
            assert first[f.name] == 7
        elif f.name in listing.keep:
            assert first[f.name] == listing.keep[f.name]
        elif f.name == "post_dose":
            assert (first["post_dose"], first["post_dose_rank"]) == ("Dose 1", 1)
    # A blank row only survives where no column is required; repeated rows stay, but for one per subject.
    kept = 2 + (not listing.required and not listing.keep)
    assert df.count() == (1 if name == "randomisation" else kept)


def test_columns_are_found_by_name(spark, tmp_path):
    _write(tmp_path / "a.csv", ["new", "Date of vaccination", "VISIT", "Subject"], ["x", "5-Jan-2021", "", "12"], ["x", "31-Feb-2021", "Dose 1", "n/a"])
    df = load(spark, str(tmp_path), "vaccination", path=str(tmp_path / "a.csv"))
    assert rows(df) == [(12, None, date(2021, 1, 5)), (None, "Dose 1", None)]
    with pytest.raises(ValueError, match="no column 'Subject'"):
        conform(df.withColumnRenamed("subject", "id"), LISTINGS["vaccination"])


def test_replaced_headers_need_the_exact_width(spark, tmp_path):
    _write(tmp_path / "e.csv", ["a"] * 28, ["x"] * 28)
    with pytest.raises(ValueError, match="28 columns, expected 29"):
        load(spark, str(tmp_path), "eligibility", path=str(tmp_path / "e.csv"))


def test_cleaning_belonging_to_a_listing(spark, tmp_path):
    listing = LISTINGS["queries"]
    header = _header(listing)
    _write(tmp_path / listing.file, header, _row(listing, header, query_text='5 �g, "x"� y'))
    assert load(spark, str(tmp_path), "queries").first().query_text == '5 _g, "x"� y'
    listing = LISTINGS["schedule"]
    header = _header(listing)
    _write(tmp_path / listing.file, header, _row(listing, header, site="Old"), _row(listing, header, exact_date=""))
    df = load(spark, str(tmp_path), "schedule", site_merges={"Old": "New"})
    assert rows(df, "site", "exact_date") == [("New", date(2021, 1, 5)), ("text", None)]
    listing = LISTINGS["eligibility"]
    header = _header(listing)
    _write(tmp_path / listing.file, header, *[_row(listing, header, subject=s) for s in ("1", "2", "")])
    assert rows(load(spark, str(tmp_path), "eligibility", test_subjects=[2]), "subject") == [(1,), (None,)]


def test_outcome_levels(spark, tmp_path):
    listing = LISTINGS["local_ae"]
    header = _header(listing)
    _write(tmp_path / listing.file, header, *[_row(listing, header, post_dose=d) for d in ("2", "Booster 2", "9")], _row(listing, header, outcome=""))
    assert rows(load(spark, str(tmp_path), "local_ae"), "post_dose") == [("Booster 2",), ("Dose 2",), (None,)]


def test_typed_input_conforms_too(frame):
    raw = frame("Subject long, VISIT string, `Date of vaccination` date", (1, "Dose 1", "2021-01-05"))
    assert rows(conform(raw, LISTINGS["vaccination"])) == [(1, "Dose 1", date(2021, 1, 5))]


def test_worklists(spark, frame, tmp_path):
    df = frame("subject long, group string, other string, team string", (2, "B", "x,y", "t1"), (1, None, "q", "t2"), (3, "A", None, "t1"))
    path = write_worklist(df, str(tmp_path), "required_eos")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["subject", "group", "other", "team"]
    assert rows(back, "subject", "other") == [("1", "q"), ("2", "x,y"), ("3", None)]
    teams = spark.read.option("header", True).csv(write_by_team(df, str(tmp_path), "open_events"))
    assert rows(teams, "team", "subject") == [("t1", "2"), ("t1", "3"), ("t2", "1")]
    assert len(WORKLISTS) == 21
    # Writing again replaces the list.
    assert spark.read.option("header", True).csv(write_worklist(df.limit(1), str(tmp_path), "required_eos")).count() == 1


def test_lab_tables_and_extract(spark, frame, tmp_path):
    def table(name, columns):
        schema = "serial_study_id long, date_collect date, fk_study int, " + ", ".join(f"{c} double" for c in columns)
        frame(schema, (1, "2021-01-01", 1, *[2.0] * len(columns))).write.parquet(str(tmp_path / f"{name}.parquet"))

    table("report_haematology", HAEMATOLOGY_COLUMNS)
    table("report_clinical_chemistry", CHEMISTRY_COLUMNS)
    haem, chem = read_lab_tables(spark, str(tmp_path))
    long = lab_extract(haem, chem, 1)
    write_extract(long, str(tmp_path))
    # What one end of the pipeline writes the other one loads.
    back = load(spark, str(tmp_path), "lab_system")
    assert back.columns == ["subject", "sample_date", "test", "result"] and back.count() == 16
    assert rows(back) == rows(long)


def test_a_jdbc_read_must_be_split(spark):
    with pytest.raises(ValueError):
        read_lab_tables_jdbc(spark, "jdbc:none", "s")


TEXTS = ["plain", "two\nlines", 'a "quoted"\n\n"word"', "", "x,y", 'ends with "', "\n", "tail\r\nwith return", "é\n" * 40, '""', " padded "]


@pytest.mark.parametrize("split", ["64b", "300b", "128m"])
def test_quoted_line_ends_in_files_of_many_splits(spark, tmp_path, split):
    """Every reading of a file gives Python's own records, however it is split."""
    data = [[str(i), TEXTS[i % len(TEXTS)], f"k{i}"] for i in range(150)]
    for name in ("a.csv", "b.csv"):
        _write(tmp_path / name, ["id", "text", "key"], *data)
    size, cost = (spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        df = read_csv(spark, str(tmp_path), quoted_lines=True)
        assert df.columns == ["id", "text", "key"]
        got = sorted((tuple(c or "" for c in r) for r in df.collect()), key=lambda r: (int(r[0]), r))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == [tuple(r) for r in data for _ in "ab"]


def test_quotes_that_do_not_pair_up_do_not_swallow_the_file(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,5" pipe\n2,x\n')
    assert rows(read_csv(spark, str(tmp_path), quoted_lines=True), "a") == [("1",), ("2",)]
    (tmp_path / "q.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path), quoted_lines=True).count() == 0


def test_a_query_text_with_a_line_end_is_one_row(spark, tmp_path):
    listing = LISTINGS["queries"]
    header = _header(listing)
    _write(tmp_path / listing.file, header, _row(listing, header, query_text="one\ntwo", query_status="Open Query"), _row(listing, header))
    assert rows(load(spark, str(tmp_path), "queries"), "query_text", "query_status") == [("one\ntwo", "Open Query"), ("text", "text")]
    assert load(spark, str(tmp_path), "queries", quoted_lines=False).count() == 3


def test_lists_of_a_run_are_written_and_read_together(spark, frame, tmp_path):
    a = frame("subject long, group string, other string, team string", (10, "B", 'x,"y"', "t1"), (9, None, "q", "t2"), (3, "A", None, "t1"), (4, "A", "", None))
    b = frame("subject long, note string", (2, "n"), (1, None))
    manifest = write_run({"required_eos": a, "open_events": b, "none": b.limit(0)}, str(tmp_path), "r1")
    assert rows(manifest, "list", "team", "n") == [("open_events", "all", 2), ("required_eos", "none", 1), ("required_eos", "t1", 2), ("required_eos", "t2", 1)]
    back = read_run(spark, str(tmp_path), "required_eos")
    assert back.columns == ["subject", "group", "other", "team"]
    assert rows(back) == [("10", "B", 'x,"y"', "t1"), ("3", "A", None, "t1"), ("4", "A", None, "none"), ("9", None, "q", "t2")]
    # Lists keep their own columns and their reading order.
    files = sorted((tmp_path / "lists/run=r1/list=required_eos/team=t1").glob("part*"))
    assert "".join(f.read_text() for f in files).splitlines() == ["3,A,", '10,B,"x,""y"""']
    with pytest.raises(ValueError, match="no finished run"):
        read_run(spark, str(tmp_path), "other")


def test_a_run_that_broke_off_is_not_seen(spark, frame, tmp_path):
    b = frame("subject long, note string", (2, "n"), (1, None))
    write_run({"open_events": b}, str(tmp_path), "r1")
    broken = b.withColumn("note", F.when(F.col("subject") == 1, F.raise_error(F.lit("lost"))).otherwise("n"))
    with pytest.raises(Exception, match="lost"):
        write_run({"open_events": broken}, str(tmp_path), "r2")
    assert read_run(spark, str(tmp_path), "open_events").count() == 2
    write_run({"open_events": b.limit(1)}, str(tmp_path), "r3")
    assert rows(run_manifest(spark, str(tmp_path)), "n") == [(1,)] and rows(run_manifest(spark, str(tmp_path), "r1"), "n") == [(2,)]


def test_a_second_extract_rewrites_only_what_may_have_changed(spark, frame, tmp_path):
    schema = "subject long, sample_date date, test string, result double"
    old = [(1, "2021-01-01", "WBC", 1.0), (1, "2021-03-01", "WBC", 2.0), (2, "2021-03-05", "HGB", 3.0), (3, None, "HGB", 4.0)]
    folder = str(tmp_path)
    assert last_taken(spark, folder) is None
    path = update_extract(frame(schema, *old), folder)
    assert last_taken(spark, folder) == date(2021, 3, 5)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / path.split("/")[-1]).rglob("part*.csv")}
    before = files()
    new = [(1, "2021-01-01", "WBC", 9.0), (2, "2021-03-05", "HGB", 3.5), (2, "2021-03-05", "WBC", 6.0), (4, "2021-04-01", "WBC", 7.0), (3, None, "HGB", 4.5)]
    update_extract(frame(schema, *new), folder, late_days=1)
    kept = {f for f in before if files().get(f) == before[f]}
    assert {f.split("sampledate=")[1].split("/")[0] for f in kept} == {"2021-01-01", "2021-03-01"}
    back = load(spark, folder, "lab_system")
    assert rows(back, "subject", "test", "result", "sample_date") == sorted(
        [(1, "WBC", 1.0, date(2021, 1, 1)), (1, "WBC", 2.0, date(2021, 3, 1)), (2, "HGB", 3.5, date(2021, 3, 5)), (2, "WBC", 6.0, date(2021, 3, 5)), (3, "HGB", 4.5, None), (4, "WBC", 7.0, date(2021, 4, 1))],
        key=lambda r: [(v is None, str(v)) for v in r],
    )
    update_extract(frame(schema, *new).limit(0), folder)
    assert last_taken(spark, folder) == date(2021, 4, 1) and load(spark, folder, "lab_system").count() == 6


def test_records_are_pieced_together_without_shuffling_whole_lines(spark, tmp_path):
    """One split a file: no shuffle at all; many splits: only the records over their ends are."""
    _write(tmp_path / "a.csv", ["id", "text"], *[[str(i), "one\n\ntwo"] for i in range(50)])
    records = quoted_records(spark, str(tmp_path))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert rows(records, "number", "record") == sorted([(1, "id,text"), *[(i + 2, f'{i},"one\n\ntwo"') for i in range(50)]], key=lambda r: str(r[0]))
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_a_list_of_many_rows_is_sorted_by_several_tasks(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "ROWS_PER_TASK", 100)
    long = frame("subject long, note string", *[(i * 7 % 1000, "n") for i in range(1000)])
    manifest = write_run({"open_events": long, "open_queries": long.limit(5)}, str(tmp_path), "r1")
    assert rows(manifest, "list", "n") == [("open_events", 1000), ("open_queries", 5)]
    files = [f.read_text().splitlines() for f in (tmp_path / "lists/run=r1/list=open_events/team=all").glob("part*")]
    assert len(files) > 5 and max(map(len, files)) <= 400
    # Files follow on each other in the reading order.
    assert [int(line.split(",")[0]) for f in sorted(files, key=lambda f: int(f[0].split(",")[0])) for line in f] == list(range(1000))
    assert read_run(spark, str(tmp_path), "open_events").count() == 1000


def test_the_extract_is_worked_out_once_per_update(spark, frame, tmp_path):
    """What an update reads is read by one job: the latest date comes from the rows as they are written."""
    seen = spark.sparkContext.accumulator(0)

    def mark(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    data = frame("subject long, sample_date date, test string, result double", *[(i, f"2021-01-{i:02}", "WBC", 1.0) for i in range(1, 29)], (3, None, "HGB", 4.0))
    update_extract(data.mapInArrow(mark, data.schema), str(tmp_path))
    assert seen.value == 29 and last_taken(spark, str(tmp_path)) == date(2021, 1, 28)


def test_the_extract_is_dealt_out_by_date_before_it_is_long(spark, frame, monkeypatch):
    """Only wide rows are shuffled to put dates together, and the long ones are written as they come, unsorted."""
    from types import SimpleNamespace

    from workload.job_queries import lab_extract_in_steps

    def table(columns, *keys):
        schema = "serial_study_id long, date_collect date, fk_study int, " + ", ".join(f"{c} double" for c in columns)
        return frame(schema, *[(i, d, 1, *[float(n)] * len(columns)) for n, (i, d) in enumerate(keys)])

    haem = table(HAEMATOLOGY_COLUMNS, (1, "1997-05-20"), (2, "1997-06-30"), (3, "1998-01-01"), (None, "1997-01-01"), (4, None))
    chem = table(CHEMISTRY_COLUMNS, (2, "1997-06-30"), (5, "1996-01-01"), (3, "1998-01-01"), (6, "1999-01-01"))
    seen = []
    made = writers.extract_columns
    monkeypatch.setattr(writers, "extract_columns", lambda df: seen.append(made(df)) or seen[-1])
    back = rows(lab_extract_in_steps(SimpleNamespace(haematology=haem, chemistry=chem)))
    assert back == rows(lab_extract(haem, chem, 1)) and len(back) == 7 * 16
    for df in seen:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Expand") < plan.index("RebalancePartitions") and plan.count("RebalancePartitions") == 1
    assert len(seen) == 2 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_a_task_with_more_dates_than_it_writes_side_by_side(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "OPEN_DATES", 3)
    data = frame("subject long, sample_date date, test string, result double", *[(i, f"2021-01-{i % 28 + 1:02}", "WBC", float(i)) for i in range(200)], (1, None, "WBC", 5.0))
    update_extract(data.coalesce(1), str(tmp_path), by_date=True)
    assert rows(load(spark, str(tmp_path), "lab_system"), "subject", "sample_date", "test", "result") == rows(data)
    assert len(list(tmp_path.rglob("part*.csv"))) == 29
