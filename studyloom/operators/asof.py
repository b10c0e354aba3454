"""Attribution of an event to the latest mark on or before its day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.operators.joins import join_agg, join_ns


def last_before(
    events: DataFrame,
    marks: DataFrame,
    key: str,
    event_date: str,
    mark_date: str,
    label: str,
    label_order: Sequence[str] | None = None,
) -> DataFrame:
    """Add `last_<label>`, `last_<mark_date>` and `days_since` to every event row.

    For marks of any number and kind. Both inputs shrink together to one row
    per key and day before anything is matched, so the window over a key sees
    at most one row per calendar day however many rows the key has, and no
    event is ever paired with more than one mark. Of several marks on a day
    the first in `label_order` counts, and labels outside that list are no
    marks; without a list the smallest label counts.
    """
    known = F.col(mark_date).isNotNull() & F.col(label).isNotNull()
    if label_order:
        names = F.lit(list(label_order))
        marks = marks.filter(known & F.col(label).isin(list(label_order)))
        mark: Column = F.array_position(names, F.col(label)).cast("int")
    else:
        marks, mark = marks.filter(known), F.col(label)
    mark_rows = marks.select(
        F.col(key).alias("__key"), F.to_date(mark_date).alias("__day"), mark.alias("__mark"), F.lit(False).alias("__wanted")
    )
    event_rows = events.select(
        F.col(key).alias("__key"),
        F.to_date(event_date).alias("__day"),
        F.lit(None).cast(mark_rows.schema["__mark"].dataType).alias("__mark"),
        F.lit(True).alias("__wanted"),
    ).filter(F.col("__day").isNotNull())
    days = (
        mark_rows.unionByName(event_rows)
        .groupBy("__key", "__day")
        .agg(F.min("__mark").alias("__mark"), F.bool_or("__wanted").alias("__wanted"))
    )
    so_far = Window.partitionBy("__key").orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__mark").isNotNull(), F.struct("__mark", "__day")), ignorenulls=True)
    found = F.col("__last.__mark")
    looked_up = (
        days.withColumn("__last", last.over(so_far))
        .filter("__wanted")
        .select(
            "__key",
            "__day",
            (F.get(names, found - 1) if label_order else found).alias(f"last_{label}"),
            F.col("__last.__day").alias(f"last_{mark_date}"),
        )
    )
    keyed = events.withColumn("__event_day", F.to_date(event_date))
    out = join_ns(keyed, looked_up, [(key, "__key"), ("__event_day", "__day")], "left")
    since = F.datediff("__event_day", f"last_{mark_date}")
    return out.withColumn("days_since", since).drop("__event_day")


def last_of_labels(
    events: DataFrame,
    marks: DataFrame,
    key: str,
    event_date: str,
    mark_date: str,
    label: str,
    labels: Sequence[str],
) -> DataFrame:
    """Same attribution for a short fixed list of labels, each once per key.

    Marks become one wide row per key, the smallest day difference that is not
    negative wins, and the earlier label wins a tie. One join, no window.
    """
    earliest = {
        f"__m{i}": F.min(F.when(F.col(label) == l, F.col(mark_date))) for i, l in enumerate(labels)
    }
    out = join_agg(events, marks, key, earliest)
    gaps = [F.datediff(F.col(event_date), F.col(f"__m{i}")) for i in range(len(labels))]
    past = [F.when(g >= 0, g) for g in gaps]
    nearest: Column = F.least(*past) if len(past) > 1 else past[0]
    chosen = F.coalesce(*[F.when(g == nearest, F.lit(l)) for g, l in zip(past, labels)])
    return out.withColumns({f"last_{label}": chosen, "days_since": nearest}).drop(
        *[f"__m{i}" for i in range(len(labels))]
    )
