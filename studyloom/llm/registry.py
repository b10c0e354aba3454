"""Queries of this subpackage and, where SQL can say them, their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from studyloom.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = lambda spark, folder: build(apply_settings(spark), folder)
        if sql is not None:
            CHECKS[key] = sql
        return build

    return register
