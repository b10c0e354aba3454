"""What the plans must look like to hold on large and skewed data."""

import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from studyloom import operators as op
from studyloom.plans import cohort_flow
from studyloom.session import apply_settings
from workload import registry
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def conf(spark):
    changed = {}

    def set_(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The adaptive plan after the query ran."""
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    """One subject holds a third of the rows; read from files, as all inputs are."""
    folder = tmp_path_factory.mktemp("facts")
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500)
    rows = spark.range(0, 120_000, 1, 16).select(
        hot.alias("subject"), F.col("id").alias("v"), F.md5(F.col("id").cast("string")).alias("t")
    )
    rows.write.parquet(f"{folder}/rows")
    one_each = spark.range(500).select(
        F.col("id").alias("subject"), F.lit("x").alias("w"), F.lit("Group A").alias("group"), F.lit("S").alias("site"),
        F.lit("On Active Follow up").alias("current_status"), F.lit("Dose 1").alias("visit"), F.lit("R").alias("rand"),
    )
    one_each.write.parquet(f"{folder}/side")
    return str(folder)


@pytest.fixture()
def skewed(spark, conf, facts):
    """Thresholds small enough to notice the hot subject."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
        spark__sql__files__maxPartitionBytes="200KB",
    )
    apply_settings(spark)
    return spark.read.parquet(f"{facts}/rows")


@pytest.fixture()
def side(spark, facts):
    return spark.read.parquet(f"{facts}/side")


def test_hot_key_is_split_in_joins(skewed, side):
    side = side.select("subject", "w")
    for df in (
        op.join_ns(skewed, side, "subject"),
        op.join_ns(skewed, side, "subject", "inner"),
        op.join_ns(skewed, side, "subject", expect="m:1"),
        op.anti(skewed, side.filter("subject > 250"), "subject"),
        op.anti(skewed, side.filter("subject > 250"), "subject", null_safe=False),
        op.matching(skewed, side, "subject"),
        op.last_of_labels(
            skewed.withColumn("on", F.lit("2021-01-05").cast("date")),
            side.withColumn("at", F.lit("2021-01-01").cast("date")), "subject", "on", "at", "w", ["x"],
        ),
        op.join_agg(skewed, skewed, "subject", {"n": F.count("*")}),
        op.full_outer(skewed, side, ["subject"]),
    ):
        assert "skew=true" in final_plan(df)


def test_full_outer_shuffles_the_right_side_once(skewed, side):
    both = op.full_outer(side.select("subject", "w"), skewed.select("subject", "v"), ["subject"])
    assert "ReusedExchange" in final_plan(both).split("== Initial Plan ==")[0]


def test_hot_subject_is_split_in_the_waterfall(skewed):
    reasons = [("low", F.col("v") < 10), ("high", F.col("v") > 119_000)]
    assert "skew=true" in final_plan(op.waterfall(skewed, "subject", reasons))


def test_hot_subject_is_split_in_the_analysis_base(skewed, side):
    participants = side.select("subject", "group", "site", "current_status")
    base = cohort_flow.analysis_base(skewed, side.select("subject", "visit"), participants, side)
    final = final_plan(base).split("== Initial Plan ==")[0]
    assert final.count("skew=true") == 3
    # Also when another join on the subject follows at once.
    reasons = [("low", F.col("v") < 10)]
    final = final_plan(op.waterfall(base, "subject", reasons)).split("== Initial Plan ==")[0]
    assert final.count("skew=true") >= 4


def test_first_per_sends_one_row_per_key_and_task(skewed):
    text = plan(op.first_per(skewed, ["subject"], ["v"]))
    before_shuffle = text[text.index("Exchange") :]
    assert re.search(r"WindowGroupLimit .*Partial", before_shuffle)


def test_waterfall_counts_need_one_shuffle_by_subject(skewed):
    reasons = [("low", F.col("v") < 10), ("high", F.col("v") > 119_000)]
    text = plan(op.waterfall_counts(skewed, "subject", reasons))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_numbering_spreads_one_key_over_all_partitions(spark, skewed, conf):
    conf(spark__sql__execution__rangeExchange__sampleSizePerPartition="1000")
    # A million rows of one subject on one day: nothing but the last order column tells them apart.
    rows = spark.range(0, 1_000_000, 1, 8).select(
        F.lit(7).alias("subject"), F.lit("2021-01-05").cast("date").alias("day"), F.pmod(F.col("id") * 7919, F.lit(1_000_003)).alias("v")
    )
    numbered = op.number_within(rows, "subject", ["day", "v"], {"number": None})
    text = plan(numbered)
    # Neither the numbering nor the offsets bring the rows of the subject together.
    assert re.search(r"count\(.*windowspecdefinition\(subject#\d+, __part#\d+", text) and "BroadcastHashJoin" in text
    sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 400_000
    wrong = numbered.withColumn("plain", F.dense_rank().over(Window.partitionBy("subject").orderBy("v"))).filter("plain <> cast(number as int)")
    assert wrong.isEmpty()


def test_share_shuffles_its_input_once(skewed):
    assert "ReusedExchange" in final_plan(op.share(skewed, "subject", 1)).split("== Initial Plan ==")[0]


def test_filters_and_columns_reach_the_scan(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    text = plan(QUERIES["anti_one_key"](spark, FOLDER))
    assert "EqualTo(o_orderstatus,P)" in text
    assert "o_totalprice" not in text and "c_acctbal" not in text
    text = plan(QUERIES["lab_extract"](spark, FOLDER))
    assert "EqualTo(l_linestatus,F)" in text and "l_orderkey" not in text


def test_long_band_lists_need_no_broadcast(spark, skewed):
    """A hundred thousand bands: an equi join on key and cell, split on the hot key, and no row meets all bands of its key."""
    bands = spark.range(100_000).select((F.col("id") % 500).alias("subject_"), (F.col("id") * 3).alias("low"), (F.col("id") * 3 + 2).alias("high"))
    joined = op.band_join(skewed.select("subject", "v"), bands, [("subject", "subject_")], "v")
    text = final_plan(joined).split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in text and "Broadcast" not in text and "NestedLoop" not in text
    assert re.search(r"SortMergeJoin[^\n]*__cell", text)


STUDY = ["eligibility", "vaccination", "participants", "randomisation"]


@pytest.mark.parametrize(
    ("query", "listings"),
    [
        ("required_eos", STUDY),
        ("eos_pending", [*STUDY, "end_of_study"]),
        ("eos_not_required", [*STUDY, "end_of_study"]),
        ("closure_summary", ["unsolicited_ae", "clinic_visits", "clinic_forms"]),
    ],
)
def test_each_listing_is_read_once(spark, monkeypatch, query, listings):
    """Listings are marked as they are handed out; each mark occurs once in all that runs."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")

    class Marked(registry.Listings):
        def __getattr__(self, name):
            listing = super().__getattr__(name)
            return listing.observe(f"mark_{name}", F.count(F.lit(1)).alias("n")) if name in listings else listing

    monkeypatch.setattr(registry, "Listings", Marked)
    ran = []
    kept = cohort_flow.steady
    monkeypatch.setattr(cohort_flow, "steady", lambda df: ran.append(plan(df)) or kept(df))
    ran.append(plan(QUERIES[query](spark, FOLDER)))
    assert sorted(re.findall(r"CollectMetrics mark_(\w+)", "".join(ran))) == sorted(listings)
