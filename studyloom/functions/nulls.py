"""Null-aware predicates and text cleaning, all as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Punctuation and symbols of every script, not only ASCII.
PUNCTUATION = r"[\p{P}\p{S}]"


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become null in text columns; other types are untouched."""
    return df.select(
        *[
            F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def replace_first(df: DataFrame, col: str, symbol: str, repl: str = "") -> DataFrame:
    """Replace the first literal occurrence of `symbol` in one column."""
    if not symbol:
        raise ValueError("symbol must not be empty")
    at = F.instr(F.col(col), F.lit(symbol))
    return df.withColumn(
        col,
        F.when(at > 0, F.overlay(F.col(col), F.lit(repl), at, F.lit(len(symbol)))).otherwise(F.col(col)),
    )


def not_in(col: Column | str, values: Iterable) -> Column:
    """True when the value is not listed; a null value counts as not listed."""
    return ~F.coalesce(as_column(col).isin(list(values)), F.lit(False))


def has_text(col: Column | str, pattern: str) -> Column:
    """Regex test where null text is simply no match."""
    return F.coalesce(as_column(col).rlike(pattern), F.lit(False))


def matches_text(col: Column | str, pattern: str) -> Column:
    """Regex test that stays null on null text, so a filter drops it either way round."""
    return as_column(col).rlike(pattern)


def either_text(col: Column | str, patterns: Iterable[str]) -> Column:
    """True when any of the regexes matches; null text matches none."""
    return has_text(col, "|".join(f"(?:{p})" for p in patterns))


def any_present(*cols: Column | str) -> Column:
    return F.coalesce(*[F.when(as_column(c).isNotNull(), F.lit(True)) for c in cols], F.lit(False))


def all_present(*cols: Column | str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & as_column(c).isNotNull()
    return out


def keep_present(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which every listed column has a value."""
    return df.filter(all_present(*cols))


def null_if_zero(col: Column | str) -> Column:
    return F.nullif(as_column(col), F.lit(0))


def strip_punctuation(df: DataFrame) -> DataFrame:
    """Every column as text without punctuation."""
    return df.select(
        *[F.regexp_replace(F.col(f"`{c}`").cast("string"), PUNCTUATION, "").alias(c) for c in df.columns]
    )


def to_number(col: Column | str) -> Column:
    """Text to double; null when it is not a number."""
    text = F.trim(as_column(col).cast("string"))
    # A trailing d or f is a Java literal suffix, not part of a number.
    return F.when(~text.rlike(r"(?i)[0-9.][df]$"), text.try_cast("double"))
