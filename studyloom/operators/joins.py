"""Joins in which a missing key matches a missing key.

Every join here is an equi join. No side is hinted for broadcast except short
parameter lists of checked length: Spark broadcasts a side only when its
estimated or measured size is under the session threshold, and otherwise
sort-merges, where adaptive execution can split a hot key because only inner,
left, semi and anti joins are used.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Key = str | tuple[str, str]

#: Parameter lists up to this length are broadcast.
BROADCAST_ROWS = 10_000
#: Pairs of a point and a band filed under its cell that one task of a band join goes through, about.
TASK_PAIRS = 2_000_000
#: Tasks for each such share of the work, so that cells that meet in a task by chance make it little longer; and tasks at most.
TASKS_PER_SHARE, MOST_TASKS = 2, 20_000


def _pairs(on: Key | Sequence[Key]) -> list[tuple[str, str]]:
    keys = [on] if isinstance(on, str) else list(on)
    return [(k, k) if isinstance(k, str) else k for k in keys]


def _filler(data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return F.lit("")
    if isinstance(data_type, T.DateType):
        return F.lit("1970-01-01").cast("date")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(data_type)
    if isinstance(data_type, T.BooleanType):
        return F.lit(False)
    return F.lit(0).cast(data_type)


def key_columns(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Null-free stand-ins for the keys, two per key, for grouping and plain equality."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [part for k in keys for part in (F.coalesce(df[k], _filler(types[k])), df[k].isNull())]


def join_ns(
    left: DataFrame,
    right: DataFrame,
    on: Key | Sequence[Key],
    how: str = "left",
    expect: str | None = None,
    null_safe: bool = True,
    suffix: str = "_right",
) -> DataFrame:
    """Left or inner equi join; the result keeps the left key names.

    `expect="m:1"` fails the job when a matched right key occurs twice.
    Right columns that clash with a left one get `suffix`.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {how}")
    pairs = _pairs(on)
    right_keys = [r for _, r in pairs]
    taken = set(left.columns)
    payload = [c for c in right.columns if c not in right_keys]
    names = {c: f"{c}{suffix}" if c in taken else c for c in payload}
    if expect == "m:1":
        return _join_many_to_one(left, right, pairs, names, how, null_safe)
    if expect is not None:
        raise ValueError(f"unsupported expectation {expect}")
    right = right.select(
        *[F.col(f"`{r}`").alias(f"__k{i}") for i, r in enumerate(right_keys)],
        *[F.col(f"`{c}`").alias(names[c]) for c in payload],
    )
    same = [
        left[l].eqNullSafe(right[f"__k{i}"]) if null_safe else left[l] == right[f"__k{i}"]
        for i, (l, _) in enumerate(pairs)
    ]
    return left.join(right, reduce(Column.__and__, same), how).drop(*[f"__k{i}" for i in range(len(pairs))])


def join_agg(
    left: DataFrame,
    right: DataFrame,
    on: Key | Sequence[Key],
    aggregates: Mapping[str, Column],
    how: str = "left",
    null_safe: bool = True,
) -> DataFrame:
    """Join to an aggregate of `right` by the same keys.

    The aggregate is shuffled once more for the join, on the null-safe form of
    the keys. That is one row per key, and only when both sides of a join come
    straight from a shuffle can Spark split a hot key of the large side.
    """
    pairs = _pairs(on)
    grouped = right.groupBy(*[F.col(f"`{r}`").alias(f"__k{i}") for i, (_, r) in enumerate(pairs)]).agg(
        *[a.alias(name) for name, a in aggregates.items()]
    )
    same = [left[l].eqNullSafe(grouped[f"__k{i}"]) for i, (l, _) in enumerate(pairs)]
    if not null_safe:
        same += [left[l].isNotNull() for l, _ in pairs]
    return left.join(grouped, reduce(Column.__and__, same), how).drop(*[f"__k{i}" for i in range(len(pairs))])


def _join_many_to_one(
    left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], names: dict[str, str], how: str, null_safe: bool
) -> DataFrame:
    # One row per key before the join; the count travels along, so an
    # unmatched duplicate is never looked at.
    row = F.min(F.struct(*[F.col(f"`{c}`") for c in names]))
    out = join_agg(left, right, pairs, {"__rows": F.count(F.lit(1)), "__row": row}, how, null_safe)
    message = F.lit(f"more than one row matches on {', '.join(r for _, r in pairs)}")
    out = out.filter(F.when(F.col("__rows") > 1, F.raise_error(message).cast("boolean")).otherwise(True))
    return out.withColumns({names[c]: F.col(f"__row.`{c}`") for c in names}).drop("__rows", "__row")


def _filtering_join(
    df: DataFrame, other: DataFrame, on: Key | Sequence[Key], how: str, null_safe: bool
) -> DataFrame:
    pairs = _pairs(on)
    # Repeated keys combine before the shuffle, whichever key they pile up on.
    keys = other.select(*[F.col(f"`{r}`").alias(f"__k{i}") for i, (_, r) in enumerate(pairs)]).distinct()
    same = [df[l].eqNullSafe(keys[f"__k{i}"]) for i, (l, _) in enumerate(pairs)]
    if not null_safe:
        same += [df[l].isNotNull() for l, _ in pairs]
    return df.join(keys, reduce(Column.__and__, same), how)


def anti(df: DataFrame, other: DataFrame, on: Key | Sequence[Key], null_safe: bool = True) -> DataFrame:
    """Rows of `df` whose key does not occur in `other`."""
    return _filtering_join(df, other, on, "left_anti", null_safe)


def matching(df: DataFrame, other: DataFrame, on: Key | Sequence[Key], null_safe: bool = True) -> DataFrame:
    """Rows of `df` whose key occurs in `other`: what `anti` leaves out."""
    return _filtering_join(df, other, on, "left_semi", null_safe)


def full_outer(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows of both sides; null keys match nothing, as in SQL.

    Written as the left join plus the unmatched right rows, because a full
    outer join cannot split a hot key while these two can. Rows with a missing
    key are set aside first and appended; then both branches meet the right
    side on the same plain keys, so that it is shuffled once for both.
    """
    def whole(names):
        return reduce(Column.__and__, (F.col(f"`{n}`").isNotNull() for n in names))

    # Only left columns get working names: the right side must look the same to both joins to be shuffled once.
    payload = [c for c in left.columns if c not in on]
    marks = {**{k: f"__k{i}" for i, k in enumerate(on)}, **{c: f"__v{i}" for i, c in enumerate(payload)}}
    lefts = left.withColumnsRenamed(marks)
    keys = [marks[k] for k in on]
    same = reduce(Column.__and__, (F.col(m) == F.col(f"`{k}`") for k, m in zip(on, keys)))
    keyed, bare = right.filter(whole(on)), right.filter(~whole(on))
    names = {c: f"{c}_right" if c in payload else c for c in right.columns if c not in on}
    firsts = [F.col(m).alias(c) for c, m in marks.items()]
    kept = lefts.filter(whole(keys)).join(keyed, same, "left").select(*firsts, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    extra = keyed.join(lefts.filter(whole(keys)).select(*keys).distinct(), same, "left_anti").union(bare)
    extra = extra.select(*[F.col(f"`{k}`") for k in on], *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    keyless = lefts.filter(~whole(keys)).select(*firsts)
    return kept.unionByName(keyless, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)


def band_join(
    df: DataFrame,
    bands: DataFrame,
    on: Key | Sequence[Key],
    point: str,
    low: str = "low",
    high: str = "high",
    width: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Equi join in which, besides, the integer `point` lies in the band's closed interval [low, high].

    The number line is cut into cells of `width`. A band is filed under every
    cell it touches and a point is looked up in its own, so the join is a
    plain one on key and cell, broadcast or not, and no row meets a band that
    ends before or begins after its cell. Without a `width` the mean length of
    the bands is taken: then they are filed three times each at most on
    average. Overlapping bands give a row each; a missing key, point or bound
    matches nothing. Columns of both sides must differ in name, keys apart.

    Where the pairs to go through are too many for a task, they are counted by
    key and cell, and the points of a cell with many of them are dealt out, by a
    hash of the row, over several tasks that all get the cell's bands. Equal
    rows stay together.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {how}")
    pairs = _pairs(on)
    bands = bands.filter(F.col(low) <= F.col(high))
    if width is None:
        width = bands.agg(F.ceil(F.avg(F.col(high).cast("double") - F.col(low) + 1))).first()[0] or 1
    width = max(1, int(width))

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / width).cast("long")

    filed = bands.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high)))).withColumnsRenamed({r: f"__k{i}" for i, (_, r) in enumerate(pairs)})
    keys = [f"__k{i}" for i in range(len(pairs))]
    near = F.col(point).between(F.col(low), F.col(high))
    work = _band_work(df.select(*[F.col(f"`{l}`").alias(k) for k, (l, _) in zip(keys, pairs)], cell(point).alias("__cell")), filed.select(*keys, "__cell"))
    tasks, cut = work.agg(F.sum(F.col("__work") / TASK_PAIRS), F.count_if(F.col("__pieces") > 1)).first()
    if not tasks or tasks <= 1:
        same = [df[l] == filed[k] for k, (l, _) in zip(keys, pairs)] + [cell(point) == filed["__cell"], near]
        return df.join(filed, reduce(Column.__and__, same), how).drop("__cell", *keys)

    # The pairs of a cell come from few rows: tasks of equal bytes would leave them all to a few tasks.
    place = [df[l] for l, _ in pairs] + [cell(point)]
    number = F.lit(0)
    if cut:
        heavy = work.filter("__pieces > 1").select(*[F.col(c).alias(f"{c}_h") for c in (*keys, "__cell")], F.col("__pieces"))
        at = [c.eqNullSafe(heavy[f"{k}_h"]) for c, k in zip(place, (*keys, "__cell"))]
        df = df.join(heavy, reduce(Column.__and__, at), "left").drop(*[f"{k}_h" for k in (*keys, "__cell")])
        hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name != "__pieces" and not _has_map(f.dataType)]
        number = F.pmod(F.xxhash64(*hashed), F.coalesce("__pieces", F.lit(1)))
        at = [filed[k] == heavy[f"{k}_h"] for k in (*keys, "__cell")]
        filed = filed.join(heavy, reduce(Column.__and__, at), "left").drop(*[f"{k}_h" for k in (*keys, "__cell")])
        filed = filed.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    else:
        filed = filed.withColumn("__piece", F.lit(0).cast("long"))
    n = min(math.ceil(tasks) * TASKS_PER_SHARE, MOST_TASKS)
    placed = df.withColumns({**{f"__p{i}": F.col(f"`{l}`") for i, (l, _) in enumerate(pairs)}, "__at": cell(point), "__number": number.cast("long")}).drop("__pieces")
    on_left = [*[f"__p{i}" for i in range(len(pairs))], "__at", "__number"]
    on_right = [*keys, "__cell", "__piece"]
    placed, filed = placed.repartition(n, *on_left), filed.repartition(n, *on_right)
    same = [placed[l] == filed[r] for l, r in zip(on_left, on_right)] + [near]
    return placed.join(filed, reduce(Column.__and__, same), how).drop(*on_left, *on_right)


def _has_map(data_type: T.DataType) -> bool:
    return "map<" in data_type.simpleString() or "variant" in data_type.simpleString()


def _band_work(points: DataFrame, filed: DataFrame) -> DataFrame:
    """Per key and cell of the points: the rows a band join reads and pairs there, and in how many pieces its points are dealt out."""
    names = points.columns
    bands = filed.groupBy(*[F.col(c).alias(f"{c}_b") for c in names]).agg(F.count(F.lit(1)).alias("__bands"))
    counted = points.groupBy(*names).agg(F.count(F.lit(1)).alias("__points"))
    same = [counted[c] == bands[f"{c}_b"] for c in names]
    work = F.col("__points") * (1 + F.coalesce("__bands", F.lit(0)))
    out = counted.join(bands, reduce(Column.__and__, same), "left").select(*names, work.alias("__work"))
    return out.withColumn("__pieces", F.ceil(F.col("__work") / TASK_PAIRS))


def inline_table(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A parameter list as a table in the session of `df`; a short one is broadcast."""
    table = df.sparkSession.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def exclude_pairs(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple] | DataFrame) -> DataFrame:
    """Drop the rows whose key tuple is in a list, or in a table with the key columns."""
    if isinstance(pairs, DataFrame):
        return anti(df, pairs, list(keys))
    if not pairs:
        return df
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    listed = inline_table(df, sorted(set(pairs), key=repr), schema)
    same = [df[k].eqNullSafe(listed[k]) for k in keys]
    return df.join(listed, reduce(Column.__and__, same), "left_anti")


def split_by_team(
    df: DataFrame,
    owner_col: str,
    team: DataFrame | Sequence[tuple[str, str]],
    other: str = "others",
) -> DataFrame:
    """Add `team` from an (owner, team) roster; no match, or no owner, gives `other`."""
    if not isinstance(team, DataFrame):
        team = inline_table(df, sorted(set(team)), "owner string, team string")
    out = join_ns(df, team.select("owner", "team"), [(owner_col, "owner")], "left", null_safe=False)
    return out.withColumn("team", F.coalesce("team", F.lit(other)))


def split_by_pattern(
    df: DataFrame,
    owner_col: str,
    patterns: Sequence[tuple[str, Column]],
) -> DataFrame:
    """Copy each row into every list whose test it meets, as column `team`."""
    tests = [F.when(test, F.lit(name)) for name, test in patterns]
    return df.withColumn("team", F.explode(F.array_compact(F.array(*tests)))).drop(owner_col)
