"""The two laboratory system tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from studyloom.fixed_values import CHEMISTRY_COLUMNS, HAEMATOLOGY_COLUMNS

HAEMATOLOGY_TABLE = "report_haematology"
CHEMISTRY_TABLE = "report_clinical_chemistry"
_KEYS = ["serial_study_id", "date_collect"]


def read_lab_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Haematology and chemistry from Parquet copies."""
    return (
        spark.read.parquet(f"{folder}/{HAEMATOLOGY_TABLE}.parquet"),
        spark.read.parquet(f"{folder}/{CHEMISTRY_TABLE}.parquet"),
    )


def read_lab_tables_jdbc(
    spark: SparkSession,
    url: str,
    schema: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 16,
    predicates: Sequence[str] = (),
    **options: str,
) -> tuple[DataFrame, DataFrame]:
    """The same tables over JDBC; filters on them are pushed to the database.

    The read is split into `partitions` range queries over a numeric
    `partition_column` within `bounds`, or into one query per predicate; one of
    the two must be given. Credentials go in `options`.
    """
    if not predicates and not (partition_column and bounds):
        raise ValueError("give a partition column with bounds, or predicates")

    def table(name: str, columns: list[str]) -> DataFrame:
        where = f"{schema}.{name}"
        if predicates:
            rows = spark.read.jdbc(url, where, predicates=list(predicates), properties=options)
        else:
            split = {"partitionColumn": partition_column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
            reader = spark.read.format("jdbc").options(url=url, dbtable=where, pushDownPredicate="true")
            rows = reader.options(**split).options(**options).load()
        return rows.select(*_KEYS, "fk_study", *columns)

    return table(HAEMATOLOGY_TABLE, list(HAEMATOLOGY_COLUMNS)), table(CHEMISTRY_TABLE, list(CHEMISTRY_COLUMNS))
