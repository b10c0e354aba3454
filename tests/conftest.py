from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from studyloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "studyloom-tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Small frame from rows; dates may be given as ISO text in `date` columns."""

    def make(schema: str, *rows):
        from datetime import date

        kinds = [part.strip().split()[-1] for part in schema.split(",")]

        def value(v, kind):
            return date.fromisoformat(v) if kind == "date" and isinstance(v, str) else v

        return spark.createDataFrame([tuple(value(v, k) for v, k in zip(r, kinds)) for r in rows], schema)

    return make


def rows(df, *cols):
    """Rows as sorted tuples, missing values last."""
    got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(got, key=lambda r: [(v is None, str(v)) for v in r])
