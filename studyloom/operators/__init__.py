from studyloom.operators.asof import last_before, last_of_labels
from studyloom.operators.cohort import (
    arm,
    cohort_counts,
    cohort_members,
    cohort_rows,
    waterfall,
    waterfall_counts,
)
from studyloom.operators.crosstab import (
    add_total_col,
    add_total_row,
    count_by,
    count_where,
    crosstab,
    crosstab_long,
    crosstab_pct,
    percent_text,
    share,
    shares_long,
)
from studyloom.operators.joins import (
    anti,
    band_join,
    exclude_pairs,
    full_outer,
    inline_table,
    join_agg,
    join_ns,
    matching,
    split_by_pattern,
    split_by_team,
)
from studyloom.operators.reshape import (
    arrange,
    facets,
    first_per,
    number_counts,
    number_within,
    picks_per,
    presence_wide,
    to_long,
    to_wide,
    union_distinct,
    union_fill,
    union_same,
)

__all__ = [
    "add_total_col",
    "add_total_row",
    "anti",
    "arm",
    "arrange",
    "band_join",
    "cohort_counts",
    "cohort_members",
    "cohort_rows",
    "count_by",
    "count_where",
    "crosstab",
    "crosstab_long",
    "crosstab_pct",
    "exclude_pairs",
    "facets",
    "first_per",
    "full_outer",
    "inline_table",
    "join_agg",
    "join_ns",
    "last_before",
    "last_of_labels",
    "matching",
    "number_counts",
    "number_within",
    "percent_text",
    "picks_per",
    "presence_wide",
    "share",
    "shares_long",
    "split_by_pattern",
    "split_by_team",
    "to_long",
    "to_wide",
    "union_distinct",
    "union_fill",
    "union_same",
    "waterfall",
    "waterfall_counts",
]
