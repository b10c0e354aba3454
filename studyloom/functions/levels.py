"""Ordered categories: a short list of allowed values with display labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.nulls import as_column


def _literal_map(pairs: Mapping) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))


def with_level(
    df: DataFrame, col: str, levels: Sequence[str] | DataFrame, labels: Sequence[str] | None = None
) -> DataFrame:
    """Relabel `col` and add `<col>_rank` (1..n); unlisted values become null in both.

    A long list of levels is given as a table (level, label, rank) and joined.
    """
    value = F.col(col).cast("string")
    if isinstance(levels, DataFrame):
        table = levels.select(F.col("level").alias("__level"), F.col("label").alias("__label"), F.col("rank").alias(f"{col}_rank"))
        joined = df.join(table, value == F.col("__level"), "left")
        return joined.withColumn(col, F.col("__label")).drop("__level", "__label")
    names = list(labels) if labels is not None else list(levels)
    if len(names) != len(levels):
        raise ValueError("levels and labels differ in length")
    rank = _literal_map({v: i for i, v in enumerate(levels, 1)})[value]
    out = df.withColumn(f"{col}_rank", rank)
    return out.withColumn(col, _literal_map(dict(zip(levels, names)))[value])


def recode(col: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep all others, null included."""
    value = as_column(col)
    return F.coalesce(_literal_map(mapping)[value], value)


def numeric_suffix(col: Column | str, start: int) -> Column:
    """Whole number read from position `start` to the end; null when there is none."""
    return F.substr(as_column(col), F.lit(start)).try_cast("bigint")
