from studyloom.functions.dates import (
    date_text,
    days_between,
    months_complete,
    parse_date,
    weekday_name,
    weekday_order,
    weekday_rank,
)
from studyloom.functions.levels import numeric_suffix, recode, with_level
from studyloom.functions.nulls import (
    all_present,
    any_present,
    blank_to_null,
    either_text,
    has_text,
    keep_present,
    matches_text,
    not_in,
    null_if_zero,
    replace_first,
    strip_punctuation,
    to_number,
)

__all__ = [
    "all_present",
    "any_present",
    "blank_to_null",
    "date_text",
    "days_between",
    "either_text",
    "has_text",
    "keep_present",
    "matches_text",
    "months_complete",
    "not_in",
    "null_if_zero",
    "numeric_suffix",
    "parse_date",
    "recode",
    "replace_first",
    "strip_punctuation",
    "to_number",
    "weekday_name",
    "weekday_order",
    "weekday_rank",
    "with_level",
]
