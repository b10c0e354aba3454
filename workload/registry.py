"""Query registry: a Spark query and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from studyloom.session import apply_settings
from workload.listings import Listings, with_listings

# As-of dates inside the order history and just after the event month.
AS_OF = date(2001, 1, 1)
EVENTS_AS_OF = date(2024, 2, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register `build(listings) -> DataFrame` under `key`."""

    def register(build: Callable[[Listings], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, folder: build(Listings(apply_settings(spark), folder))
        if sql is not None:
            CHECKS[key] = with_listings(sql)
        return build

    return register
