"""Corpus pipeline over `documents`: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import decontaminate, minhash, mixing, substring_dedup, toxicity
from studyloom.llm.common import sized, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents at least this likely to be toxic go.
TOXIC = 0.5
#: Rates are fitted above this, so that mixing repeats documents and drops none.
LEAST_RATE = 1.0


def _key() -> Column:
    """A row's own key: hash of id, null or not, and text. Rows that share it are repeats of one row."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """What the operators read, with the row's key as id: verdicts are on rows, and ids may be null or repeat."""
    return docs.select(_key().alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose key is not among `gone` (keys as doc_id)."""
    keys = staged(gone.select(F.col("doc_id").alias("_key")).distinct(), "gone")
    return docs.withColumn("_key", _key()).join(sized(keys), "_key", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model holds to be toxic go; it learns from the labelled documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.severity(_keyed(docs), model).where(F.col("p_toxic") >= TOXIC)
    return _without(docs, scored)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id.

    A document without an id stays only where its group has none with one. Of
    rows equal in id and text one stays, ids that are null being equal too.
    """
    # Copies without an id share a key, so one of them stands for all.
    rows = docs.where("doc_id is not null").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS).dropDuplicates(["text"]))
    groups = minhash.near_duplicates(_keyed(rows), width=5, percent=80).select("doc_id", "component_id")
    groups = staged(groups.withColumnRenamed("doc_id", "_key").distinct(), "groups")
    # Ids are needed of groups of several only.
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    several = staged(groups.join(staged(several, "several"), "component_id", "left_semi"), "grouped")
    ids = staged(docs.select(_key().alias("_key"), "doc_id").distinct(), "keys")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")
    named = staged(several.join(ids, "_key"), "named")
    first = staged(named.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._key").alias("_key")), "first")
    gone = named.join(first, "_key", "left_anti").select(F.col("_key").alias("doc_id"))
    return _without(docs, gone).dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words and more that occur elsewhere go; the documents stay, shorter."""
    cut = substring_dedup.cut_repeats(docs, window=35, keep=["lang", "source", "n_chars"])
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    leaks = decontaminate.find_leaks(_keyed(docs), table(spark, sf_dir, "benchmark"), width=5, percent=80)
    return _without(docs, leaks)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights: a row per copy, with domain, rate and the copy's number.

    A rate's fraction is the chance of one copy more, drawn by a hash of id and text.
    """
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), least=LEAST_RATE, keep=COLUMNS)
    lot = F.pmod(F.xxhash64("doc_id", "text", F.lit("copy")), F.lit(1 << 30)) / (1 << 30)
    copies = F.floor("rate") + (lot < F.col("rate") - F.floor("rate")).cast("long")
    return mixed.select(*COLUMNS, "domain", "rate", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", near_dedup),
    ("substring", cut_repeats),
    ("decontaminate", drop_leaks),
    ("mixing", mix),
]

#: Two stages score with fitted models, which SQL cannot express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
