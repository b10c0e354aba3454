from studyloom.sources.labdb import read_lab_tables, read_lab_tables_jdbc
from studyloom.sources.listings import LISTINGS, clean, conform, load, read_csv
from studyloom.sources.quoted import quoted_records, read_quoted_csv
from studyloom.sources.writers import (
    WORKLISTS,
    last_taken,
    read_run,
    run_manifest,
    update_extract,
    write_by_team,
    write_extract,
    write_run,
    write_worklist,
)

__all__ = [
    "LISTINGS",
    "WORKLISTS",
    "clean",
    "conform",
    "last_taken",
    "load",
    "read_csv",
    "read_lab_tables",
    "read_lab_tables_jdbc",
    "read_quoted_csv",
    "read_run",
    "quoted_records",
    "run_manifest",
    "update_extract",
    "write_by_team",
    "write_extract",
    "write_run",
    "write_worklist",
]
