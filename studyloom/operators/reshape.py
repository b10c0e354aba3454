"""Wide and long layouts, first row per key, numbering, unions, ordering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.session import steady

Order = str | Column


def order_columns(order: Sequence[Order]) -> list[Column]:
    """Sort keys with missing values last; a leading minus sorts a column downwards."""
    out = []
    for o in order:
        if isinstance(o, Column):
            out.append(o)
        elif o.startswith("-"):
            out.append(F.desc_nulls_last(o[1:]))
        else:
            out.append(F.asc_nulls_last(o))
    return out


def arrange(df: DataFrame, *order: Order) -> DataFrame:
    return df.orderBy(*order_columns(order))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Order]) -> DataFrame:
    """The first row of each key in an explicit order, all columns kept.

    Spark cuts every key to one row per map task before the shuffle, so a hot
    key costs no more than any other.
    """
    spec = Window.partitionBy(*keys).orderBy(*order_columns(order))
    return df.withColumn("__rn", F.row_number().over(spec)).filter("__rn = 1").drop("__rn")


def to_wide(
    df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str] | Mapping[str, str]
) -> DataFrame:
    """One column per listed name; a missing combination stays null.

    `names` may map a name to its column name. Plain conditional aggregates
    need one shuffle where a pivot needs two.
    """
    columns = names if isinstance(names, Mapping) else {n: n for n in names}
    return df.groupBy(*keys).agg(
        *[F.min(F.when(F.col(name) == n, F.col(value))).alias(c) for n, c in columns.items()]
    )


def presence_wide(df: DataFrame, keys: Sequence[str], name: str, names: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """One column per listed name holding the name itself where it occurs."""
    columns = names if isinstance(names, Mapping) else {n: n for n in names}
    seen = df.groupBy(*keys).agg(*[F.bool_or(F.col(name) == n).alias(c) for n, c in columns.items()])
    return seen.withColumns({c: F.when(F.col(f"`{c}`"), F.lit(n)) for n, c in columns.items()})


def to_long(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value",
    drop_null: bool = False,
) -> DataFrame:
    """One row per key and listed column."""
    out = df.unpivot(list(keys), list(cols), name, value)
    return out.filter(F.col(value).isNotNull()) if drop_null else out


def number_within(
    df: DataFrame, key: str, order: Sequence[Order], names: Mapping[str, Column | None], prefix: str = ""
) -> DataFrame:
    """Running numbers of the rows within their key, as text with a prefix.

    `names` maps each new column to the rows it counts, None for all; rows
    that are not counted get null. Ties in `order` are numbered by a hash of
    the row.

    Rows are range-partitioned by key and full order, so a key of any size
    spreads over as many partitions as it fills, and each part of a key is
    numbered apart. A part then starts after the key's earlier parts. Only the
    first key of a partition can have any, so the table of these offsets has
    at most one row per partition. Range bounds are sampled anew whenever a
    plan runs; the partitioned rows are therefore written once.
    """
    flags = {f"__c{i}": F.lit(True) if test is None else F.coalesce(test, F.lit(False)) for i, test in enumerate(names.values())}
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    line = [*order_columns(order), F.asc("__tie")]
    rows = df.withColumns({**flags, "__tie": F.xxhash64(*hashed)})
    parts = steady(rows.repartitionByRange(F.asc_nulls_last(key), *line)).withColumn("__part", F.spark_partition_id())

    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(F.col(key).alias("__key"), "__part").agg(*[F.count_if(c).alias(c) for c in flags])
    before = sizes.select("__key", "__part", F.count("__part").over(earlier).alias("__n"), *[F.sum(c).over(earlier).alias(f"{c}_before") for c in flags])
    before = F.broadcast(before.filter("__n > 0").withColumnRenamed("__part", "__at").drop("__n"))

    within = Window.partitionBy(key, "__part").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumns({f"{c}_here": F.count_if(c).over(within) for c in flags})
    numbered = numbered.join(before, numbered[key].eqNullSafe(before["__key"]) & (F.col("__part") == F.col("__at")), "left")
    numbers = {
        name: F.when(F.col(c), F.concat(F.lit(prefix), (F.col(f"{c}_here") + F.coalesce(f"{c}_before", F.lit(0))).cast("string")))
        for name, c in zip(names, flags)
    }
    scratch = ["__tie", "__part", "__key", "__at", *flags, *[f"{c}_{w}" for c in flags for w in ("here", "before")]]
    return numbered.withColumns(numbers).drop(*scratch)


def picks_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per key with, for each rule, the first row that meets it as a struct (null if none does).

    All rules share one aggregate, combined before the shuffle, where a
    `first_per` for each would read and shuffle the table once per rule. Order
    is ascending, missing values last; ties go by the remaining columns.
    """
    if any(not isinstance(o, str) or o.startswith("-") for o in order):
        raise ValueError("picks_per orders by ascending columns only")
    payload = [c for c in df.columns if c not in keys]
    line = [*order, *[c for c in payload if c not in order]]
    ranked = F.struct(*[part for c in line for part in (F.col(f"`{c}`").isNull().alias(f"__{c}"), F.col(f"`{c}`"))])
    best = df.groupBy(*keys).agg(*[F.min(F.when(test, ranked)).alias(name) for name, test in rules.items()])
    found = {name: F.when(F.col(name).isNotNull(), F.struct(*[F.col(name)[c].alias(c) for c in payload])) for name in rules}
    return best.withColumns(found)


CHUNK = 10_000


def number_counts(df: DataFrame, key: str, name: str = "number", weight: Column | None = None) -> DataFrame:
    """How many keys reach each running number, as (number, n).

    The same as numbering all rows and counting the numbers, but it only
    needs the sizes of the keys: keys of one size are handled as one row, and
    that row is spread over 1..size in chunks. `weight` says how many rows an
    input row stands for.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = df.groupBy(key).agg(rows.alias("__size"))
    alike = sizes.groupBy("__size").agg(F.count(F.lit(1)).alias("__keys"))
    last_chunk = F.floor((F.col("__size") - 1) / CHUNK).cast("int")
    chunks = alike.withColumn("__chunk", F.explode(F.sequence(F.lit(0), last_chunk)))
    first = F.col("__chunk").cast("long") * CHUNK + 1
    numbers = chunks.select(
        "__keys", F.explode(F.sequence(first, F.least(first + (CHUNK - 1), F.col("__size")))).alias(name)
    )
    return numbers.groupBy(name).agg(F.sum("__keys").alias("n"))


def union_fill(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_same(*frames: DataFrame) -> DataFrame:
    """Union by name of frames with the same columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_same(*frames).distinct()


def facets(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct values with counts per column, the missing value included; every column but dates unless listed."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    return text.unpivot([], list(cols), "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
