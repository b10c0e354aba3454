import random

from conftest import rows
from pyspark.sql import functions as F

from studyloom import operators as op

NAMES = ["one", "two", "three"]


def reasons():
    return list(zip(NAMES, [F.col("a") == 1, F.col("b") == 1, (F.col("a") == 2) | (F.col("b") == 2)]))


def _chain(data):
    """One anti join after the other, as plain Python."""
    tests = [lambda a, b: a == 1, lambda a, b: b == 1, lambda a, b: a == 2 or b == 2]
    left, counts, tag = list(data), {}, {}
    for name, test in zip(NAMES, tests):
        hit = [r for r in left if test(r[2], r[3])]
        counts[name] = len(hit)
        tag.update({r[0]: name for r in hit})
        gone = {r[1] for r in hit}
        left = [r for r in left if r[1] not in gone]
    counts["remaining"], counts["excluded"] = len(left), len(data) - len(left)
    return counts, tag, {r[0] for r in left}


def test_waterfall_equals_chained_anti_joins(frame):
    for seed in range(6):
        rng = random.Random(seed)
        pick = lambda: rng.choice([None, 0, 0, 0, 1, 2])
        data = [(i, rng.choice([None, *range(12)]), pick(), pick()) for i in range(60)]
        df = frame("i int, s int, a int, b int", *data)
        counts, tag, left = _chain(data)
        assert dict(rows(op.waterfall_counts(df, "s", reasons()))) == counts
        out = op.waterfall(df, "s", reasons()).collect()
        assert len(out) == len(data)
        assert {r.i: r.reason for r in out if r.reason} == tag
        assert {r.i for r in out if not r.excluded} == left
        assert counts["remaining"] + counts["excluded"] == len(data)


def test_waterfall_of_nothing(frame):
    df = frame("i int, s int, a int, b int", (1, 1, 0, 0)).limit(0)
    assert set(dict(rows(op.waterfall_counts(df, "s", reasons()))).values()) == {0}


def test_cohorts_overlap_and_count_rows(frame):
    df = frame("s int, v string", (1, "x"), (1, "y"), (2, "x"), (3, None))
    cohorts = {"x": ("Ex", F.col("v") == "x"), "all": ("All", F.lit(True))}
    assert rows(op.cohort_counts(df, cohorts)) == [("all", 4, "All", "All (n = 4)"), ("x", 2, "Ex", "Ex (n = 2)")]
    assert rows(op.cohort_members(df, "x", F.col("v") == "x"), "cohort", "s") == [("x", 1), ("x", 2)]
    tagged = op.cohort_rows(df, {"x": F.col("v") == "x", "low": F.col("s") < 2})
    assert rows(tagged, "cohort", "s") == [("low", 1), ("low", 1), ("x", 1), ("x", 2)]


def test_arm(frame):
    df = frame("s int", (5,), (6,), (None,))
    assert [r[0] for r in df.select(op.arm("s", 5)).collect()] == ["Group A", "Group B", None]
