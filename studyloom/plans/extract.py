"""Laboratory system extract and comparison of query snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.fixed_values import CHEMISTRY_COLUMNS, HAEMATOLOGY_COLUMNS
from studyloom.operators.joins import full_outer, join_agg, join_ns
from studyloom.operators.reshape import to_long, union_fill

#: Parts that dates are dealt into, small ones being joined again: with fewer a task of many rows would hold many dates.
DATE_PARTS = 200
LAB_KEYS = ["serial_study_id", "date_collect"]


def lab_extract(haematology: DataFrame, chemistry: DataFrame, study: int, mode: str = "full", by_date: bool = False) -> DataFrame:
    """Both laboratory tables of one study joined on subject and date, long form.

    Equal rows are listed once. They are dropped before the join, so they are
    never paired, and the joined rows then differ on their own.

    `mode="left"` drops chemistry without haematology, as a study filter on
    the haematology table alone does.

    `by_date` puts the rows of a date together, as `update_extract` writes
    them. That is done before they are made long, when there are sixteen times
    fewer of them, each date named once.
    """
    haem = haematology.filter(F.col("fk_study") == study).select(*LAB_KEYS, *HAEMATOLOGY_COLUMNS).distinct()
    chem = chemistry
    if "fk_study" in chemistry.columns:
        chem = chem.filter(F.col("fk_study") == study)
    chem = chem.select(*LAB_KEYS, *CHEMISTRY_COLUMNS).distinct()
    if mode == "full":
        wide = full_outer(haem, chem, LAB_KEYS)
    elif mode == "left":
        wide = join_ns(haem, chem, LAB_KEYS, "left", null_safe=False)
    else:
        raise ValueError(f"unknown mode {mode}")
    names = {**HAEMATOLOGY_COLUMNS, **CHEMISTRY_COLUMNS}
    renamed = wide.select(
        F.col("serial_study_id").alias("subject"),
        F.col("date_collect").alias("sample_date"),
        *[F.col(c).cast("double").alias(t) for c, t in names.items()],
    )
    if by_date:
        renamed = renamed.hint("rebalance", DATE_PARTS, F.col("sample_date"))
    return to_long(renamed, ["subject", "sample_date"], list(names.values()), "test", "result")


SNAPSHOT_KEYS = ["subject", "visit", "module", "field", "query_text"]


def still_in_snapshot(
    earlier: DataFrame, today: Sequence[DataFrame], keys: Sequence[str] = tuple(SNAPSHOT_KEYS)
) -> DataFrame:
    """Rows of the earlier snapshot that are still in today's lists, and how often they are."""
    return join_agg(earlier, union_fill(*today), list(keys), {"today_rows": F.count(F.lit(1))}, "inner")
