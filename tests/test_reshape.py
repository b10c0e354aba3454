import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from studyloom import operators as op


def test_first_per_puts_missing_last(frame):
    df = frame("k int, d date, v int", (1, None, 1), (1, "2021-01-02", 2), (1, "2021-01-01", 3), (None, None, 4), (None, None, 5))
    assert rows(op.first_per(df, ["k"], ["d", "v"])) == sorted(
        rows(df.filter("v in (3, 4)")), key=lambda r: [(v is None, str(v)) for v in r]
    )
    assert rows(op.first_per(df, ["k"], ["-d", "-v"]), "v") == [(2,), (5,)]


def test_arrange_puts_missing_last_both_ways(frame):
    df = frame("a int", (2,), (None,), (1,))
    assert [r.a for r in op.arrange(df, "a").collect()] == [1, 2, None]
    assert [r.a for r in op.arrange(df, "-a").collect()] == [2, 1, None]


def test_wide_and_long(frame):
    df = frame("k int, n string, v double", (1, "a", 1.0), (1, "b", 2.0), (2, "a", None), (None, "b", 3.0), (2, "z", 9.0))
    wide = op.to_wide(df, ["k"], "n", "v", {"a": "col_a", "b": "col_b"})
    assert rows(wide) == [(1, 1.0, 2.0), (2, None, None), (None, None, 3.0)]
    assert op.to_long(wide, ["k"], ["col_a", "col_b"]).count() == 6
    assert op.to_long(wide, ["k"], ["col_a", "col_b"], drop_null=True).count() == 3


def test_presence_wide(frame):
    df = frame("k int, n string", (1, "Dose 1"), (1, "Dose 1"), (2, "Dose 2"), (3, None))
    out = op.presence_wide(df, ["k"], "n", {"Dose 1": "d1", "Dose 2": "d2"})
    assert rows(out) == [(1, "Dose 1", None), (2, None, "Dose 2"), (3, None, None)]


def _cases(frame, seed):
    rng = random.Random(seed)
    data = []
    for i in range(400):
        k = rng.choice([None, 1, 1, 1, 2, 3])
        d = rng.choice([None, "2021-01-01", "2021-01-02", "2021-01-03"])
        data.append((i, k, d, rng.choice([None, "E1", "E2"]), rng.random() < 0.6))
    return data, frame("i int, k int, d date, e string, ok boolean", *data)


def test_number_within_equals_plain_numbering(frame):
    for seed in range(3):
        data, df = _cases(frame, seed)
        numbers = {"every": None, "good": F.col("ok")}
        out = op.number_within(df, "k", ["d", "e", "i"], numbers, "N-")
        got = {r.i: (r.every, r.good) for r in out.collect()}
        assert len(got) == len(data)
        last = lambda v: (v is None, v or "")
        seen, good = {}, {}
        for i, k, d, e, ok in sorted(data, key=lambda r: (last(r[2]), last(r[3]), r[0])):
            seen[k] = seen.get(k, 0) + 1
            good[k] = good.get(k, 0) + ok
            assert got[i] == (f"N-{seen[k]}", f"N-{good[k]}" if ok else None)


def test_number_counts_equals_counting_numbers(frame, spark):
    _, df = _cases(frame, 7)
    numbered = op.number_within(df, "k", ["i"], {"number": None})
    expected = rows(numbered.groupBy(F.col("number").cast("long").alias("number")).count())
    assert rows(op.number_counts(df, "k")) == expected
    halves = df.groupBy("k", "d").agg(F.count("*").alias("w"))
    assert rows(op.number_counts(halves, "k", weight=F.col("w"))) == expected
    # A key larger than one chunk.
    big = spark.range(25_001).select(F.when(F.col("id") < 25_000, 1).otherwise(2).alias("k"))
    counts = op.number_counts(big, "k")
    assert counts.count() == 25_000
    assert counts.agg(F.sum("n")).first()[0] == 25_001


def test_unions(frame):
    a, b = frame("x int, y string", (1, "a")), frame("x int, z int", (2, 3))
    assert op.union_fill(a, b).columns == ["x", "y", "z"]
    assert rows(op.union_fill(a, b)) == [(1, "a", None), (2, None, 3)]
    c = frame("y string, x int", ("b", 2), ("a", 1))
    assert rows(op.union_same(a, c)) == [(1, "a"), (1, "a"), (2, "b")]
    assert rows(op.union_distinct(a, c)) == [(1, "a"), (2, "b")]


def test_facets_count_missing_values(frame):
    df = frame("a string, b int", ("x", 1), ("x", None), (None, None))
    assert rows(op.facets(df, ["a", "b"])) == [("a", "x", 2), ("a", None, 1), ("b", "1", 1), ("b", None, 2)]


def test_picks_per_equals_a_first_row_for_each_rule(frame):
    _, df = _cases(frame, 5)
    rules = {"every": F.lit(True), "good": F.col("ok"), "never": F.lit(False)}
    picks = op.picks_per(df, ["k"], ["d", "e", "i"], rules)
    assert picks.columns == ["k", "every", "good", "never"]
    for rule, test in rules.items():
        expected = op.first_per(df.filter(test), ["k"], ["d", "e", "i"])
        assert rows(picks.filter(f"{rule} is not null").select("k", f"{rule}.*"), "k", "i", "d", "e", "ok") == rows(expected, "k", "i", "d", "e", "ok")
    with pytest.raises(ValueError, match="ascending"):
        op.picks_per(df, ["k"], ["-d"], rules)


def test_numbers_of_an_empty_table_and_of_ties(frame):
    _, df = _cases(frame, 6)
    assert op.number_within(df.limit(0), "k", ["i"], {"number": None}).count() == 0
    tied = op.number_within(df.withColumn("m", F.create_map("i", "k")), "k", ["d"], {"number": None})
    assert "m" in tied.columns
    for key, numbers in tied.groupBy("k").agg(F.collect_list(F.col("number").cast("int"))).collect():
        assert sorted(numbers) == list(range(1, len(numbers) + 1))
