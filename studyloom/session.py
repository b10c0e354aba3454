"""Session settings the jobs are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks broadcast joins from measured sizes and splits hot
# partitions of inner, left, semi and anti joins, also where a second join on
# the same key follows and the split costs another shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Turn the settings on in a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app_name: str = "studyloom", **extra: str) -> SparkSession:
    """Session with the settings above; `extra` uses `__` for the dots in a key."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session within one process may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if re.fullmatch(r"local(\[.*\])?", master) is None:
            raise ValueError(f"spark.checkpoint.dir is not set: on {master} a folder is needed that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="studyloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def steady(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, partitions kept, so that all later steps see the same and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
