"""Counts, cross-tabs, totals and shares.

Each function first counts with a partial aggregate, so everything after the
first shuffle is as small as the printed table.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_NAME = "NA"
OTHER_NAME = "Other"


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_where(
    df: DataFrame, by: Sequence[str], tests: Mapping[str, Column], keep_any: bool = False, zero_as_null: bool = False
) -> DataFrame:
    """One count per test and group; `keep_any` drops groups where all are 0."""
    counts = df.groupBy(*by).agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    if keep_any:
        hit = F.lit(False)
        for name in tests:
            hit = hit | (F.col(f"`{name}`") > 0)
        counts = counts.filter(hit)
    if zero_as_null:
        counts = counts.withColumns({name: F.nullif(F.col(f"`{name}`"), F.lit(0)) for name in tests})
    return counts


def _free(name: str, taken: Collection[str]) -> str:
    """The name, or the name with as many stars as it takes to be free."""
    while name in taken:
        name += "*"
    return name


def _cells(col: str, values: Sequence) -> dict[str, Column]:
    """A test per column of the table: the listed values, then all others, then the missing ones."""
    names = {}
    for v in values:
        if v is not None:
            names[v] = _free(str(v), names.values())
    missing = _free(MISSING_NAME, names.values())
    is_missing, listed = F.col(col).isNull(), F.col(col).isin(list(names)) if names else F.lit(False)
    tests = {missing if v is None else names[v]: is_missing if v is None else F.col(col) == v for v in values}
    tests[_free(OTHER_NAME, [*names.values(), missing])] = F.col(col).isNotNull() & ~listed
    tests.setdefault(missing, is_missing)
    return tests


def crosstab_long(df: DataFrame, row: str, col: str, name: str = "n") -> DataFrame:
    """Counts of `row` by `col` as rows, totals both ways and over all included.

    No list of values is needed and no value can be taken for a total, another
    value or a missing one: `row_total` and `col_total` say which rows are
    totals, and values stay as they are. Rows are counted once by a partial
    aggregate; totals add up the counts.
    """
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("__n"))
    table = counts.cube(row, col).agg(
        F.sum("__n").alias(name), (F.grouping(row) == 1).alias("row_total"), (F.grouping(col) == 1).alias("col_total")
    )
    return table.select(row, col, "row_total", "col_total", name)


def shares_long(table: DataFrame, row: str, col: str, name: str = "n") -> DataFrame:
    """Add each cell's percentage of its column to a table of `crosstab_long`, half rounded up; null where the column is empty."""
    whole = table.filter("row_total").select(F.col(col).alias("__col"), F.col("col_total").alias("__ct"), F.col(name).alias("__whole"))
    same = table[col].eqNullSafe(whole["__col"]) & (table["col_total"] == whole["__ct"])
    part = F.col(name).cast("decimal(20,0)") * 100 / F.nullif("__whole", F.lit(0)).cast("decimal(20,0)")
    return table.join(whole, same, "left").withColumn("percentage", F.round(part, 0).cast("long")).drop("__col", "__ct", "__whole")


def _spread(counts: DataFrame, row: str, tests: Mapping[str, Column], rollup: bool) -> DataFrame:
    """One row per value of `row`, all rows of it in `__all`; `__level` 1 is the total."""
    cells = [F.sum(F.when(test, F.col("__n"))).alias(name) for name, test in tests.items()]
    cells.append(F.sum("__n").alias("__all"))
    if rollup:
        return counts.rollup(row).agg(*cells, F.grouping_id().alias("__level"))
    return counts.groupBy(row).agg(*cells, F.lit(0).alias("__level"))


def crosstab(
    df: DataFrame,
    row: str,
    col: str,
    values: Sequence,
    totals: Sequence[str] = ("row", "col"),
    label: str = "Total",
    total_name: str = "Total",
) -> DataFrame:
    """Counts of `row` by `col`, null where a combination never occurs.

    `values` gives the columns and their order. Rows with another value of `col`
    are counted under Other and rows without one under NA, at the end unless
    listed (None lists NA), so that cells add up to the totals over all rows. Where
    a listed value has one of these names, or that of the totals, the later column
    gets a star ("Other*"). `crosstab_long` needs no list. Rows of the table come in order of `row`, the total last.
    """
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("__n"))
    tests = _cells(col, values)
    table = _spread(counts, row, tests, "row" in totals).orderBy("__level", F.asc_nulls_last(row))
    is_total = F.col("__level") == 1
    out = [F.when(is_total, F.lit(label)).otherwise(F.col(row).cast("string")).alias(row)]
    out += [F.when(is_total, F.coalesce(f"`{n}`", F.lit(0))).otherwise(F.col(f"`{n}`")).alias(n) for n in tests]
    if "col" in totals:
        out.append(F.coalesce("__all", F.lit(0)).alias(_free(total_name, tests)))
    return table.select(*out)


def crosstab_pct(df: DataFrame, row: str, col: str, values: Sequence, label: str = "Total") -> DataFrame:
    """Cells as "p% (n)" of their column, totals both ways, half rounded up; columns and order as in `crosstab`."""
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("__n"))
    tests = _cells(col, values)
    table = _spread(counts, row, tests, True)
    is_total = F.col("__level") == 1
    table = table.select(
        F.when(is_total, F.lit(label)).otherwise(F.col(row).cast("string")).alias(row),
        *[F.coalesce(f"`{n}`", F.lit(0)).alias(n) for n in tests],
        F.coalesce("__all", F.lit(0)).alias(_free("Total", tests)),
        is_total.alias("__total"),
    )
    # The total row is one row, so the lookup is a scalar per column.
    shown = [*tests, _free("Total", tests)]
    sums = table.filter("__total").select(F.struct(*[F.col(f"`{n}`") for n in shown]).alias("s")).scalar()
    table = table.withColumn("__s", sums).orderBy("__total", F.asc_nulls_last(row))
    out = [F.col(row)]
    for n in shown:
        part, whole = F.col(f"`{n}`"), F.col("__s")[n]
        percent = F.round(part.cast("decimal(20,0)") * 100 / F.nullif(whole, F.lit(0)).cast("decimal(20,0)"), 0).cast("long")
        text = F.coalesce(F.concat(percent.cast("string"), F.lit("%")), F.lit("-"))
        out.append(F.concat(text, F.lit(" ("), part.cast("string"), F.lit(")")).alias(n))
    return table.select(*out)


def percent_text(part: Column, whole: Column, digits: int) -> Column:
    """Share as percent text, half to even; null when either side is missing."""
    ratio = F.try_divide(part.cast("decimal(20,0)") * 100, whole.cast("decimal(20,0)"))
    return F.concat(F.bround(ratio, digits).cast(f"decimal(20,{digits})").cast("string"), F.lit("%"))


def _percent(part: Column, whole: Column, digits: int) -> Column:
    ratio = part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)")
    return F.bround(ratio, digits).cast("double")


def share(df: DataFrame, by: str, digits: int = 0, weight: Column | None = None) -> DataFrame:
    """Rows per group and their rounded percentage of all rows."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(by).agg(size.alias("n"))
    everything = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percentage", _percent(F.col("n"), everything, digits))


def add_total_row(
    df: DataFrame, label_col: str, sums: Sequence[str], label: str = "Total", order: Sequence[Column | str] = ()
) -> DataFrame:
    """Append a row of column sums; rows of the table stay as they are, repeated labels included.

    Missing cells stay missing and count as 0 in the sum; other text columns
    show "-" in the total row. Rows come in `order`, by label if none is given,
    the total last.
    """
    others = [c for c in df.columns if c not in sums]
    # Every row is a group of its own beside the one of all rows, so nothing is computed twice.
    table = df.withColumn("__row", F.monotonically_increasing_id()).rollup("__row").agg(
        *[F.sum(F.col(f"`{c}`")).alias(c) for c in sums],
        *[F.min(F.col(f"`{c}`")).alias(c) for c in others],
        F.grouping_id().alias("__level"),
    )
    table = table.orderBy("__level", *(order or [F.asc_nulls_last(label_col)]))
    is_total = F.col("__level") == 1
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    cells = []
    for c in df.columns:
        if c == label_col:
            cells.append(F.when(is_total, F.lit(label)).otherwise(F.col(f"`{c}`").cast("string")).alias(c))
        elif c in sums:
            cells.append(F.when(is_total, F.coalesce(f"`{c}`", F.lit(0))).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            filler = F.lit("-") if c in text else F.lit(None)
            cells.append(F.when(is_total, filler).otherwise(F.col(f"`{c}`")).alias(c))
    return table.select(*cells)


def add_total_col(df: DataFrame, cols: Sequence[str], name: str = "Total") -> DataFrame:
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(f"`{c}`", F.lit(0))
    return df.withColumn(name, total)
