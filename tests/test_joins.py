import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from studyloom import operators as op
from studyloom.operators import joins


@pytest.fixture(scope="module")
def left(frame):
    return frame("k int, j string, a int", (1, "x", 10), (1, None, 11), (None, "x", 12), (2, "y", 13), (None, None, 14))


@pytest.fixture(scope="module")
def right(frame):
    return frame("k int, j string, b int", (1, "x", 1), (None, "x", 2), (None, None, 3), (3, "z", 4), (1, "x", 5))


def brute(left, right, keys, how):
    ls, rs = [r.asDict() for r in left.collect()], [r.asDict() for r in right.collect()]
    out = []
    for l in ls:
        hits = [r for r in rs if all(l[k] == r[k] for k in keys)]
        if how == "anti":
            out += [l] if not hits else []
        elif hits or how == "left":
            out += [{**l, "b": r["b"] if r else None} for r in (hits or [None])]
    return sorted((tuple(o.values()) for o in out), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_missing_matches_missing(left, right, keys, how):
    right = right.select(*keys, "b")
    assert rows(op.join_ns(left, right, keys, how)) == brute(left, right, keys, how)


def test_plain_equality_on_request(left, right):
    assert op.join_ns(left, right.select("k", "b"), "k", "inner", null_safe=False).count() == 4


def test_renamed_keys_and_clashes(left, right):
    out = op.join_ns(left, right.withColumnRenamed("k", "q"), [("k", "q")])
    assert out.columns == ["k", "j", "a", "j_right", "b"]


@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_anti(left, right, keys):
    assert rows(op.anti(left, right, keys)) == brute(left, right, keys, "anti")
    both = op.anti(left, right, keys).count() + op.matching(left, right, keys).count()
    assert both == left.count()
    assert op.anti(left, right.limit(0), keys).count() == left.count()


def test_anti_by_value_and_date(frame):
    mine = frame("s long, d date, t string, v double", (1, "2021-01-01", "a", 1.0), (1, None, "a", 1.0), (1, "2021-01-01", "a", None))
    other = frame("s long, d date, t string, v double", (1, "2021-01-01", "a", 1.0), (1, None, "a", 1.0))
    assert rows(op.anti(mine, other, ["s", "d", "t", "v"]), "v") == [(None,)]


def test_many_to_one(left, right):
    fine = right.filter("b <> 5")
    assert rows(op.join_ns(left, fine, ["k", "j"], expect="m:1")) == brute(left, fine, ["k", "j"], "left")
    with pytest.raises(Exception, match="more than one row matches"):
        op.join_ns(left, right, ["k", "j"], expect="m:1").collect()
    unmatched = fine.union(fine.filter("k = 3"))
    assert op.join_ns(left, unmatched, ["k", "j"], expect="m:1").count() == left.count()


def test_many_to_one_on_missing_keys(left, right):
    twice = right.filter("k is null and j is null")
    with pytest.raises(Exception, match="more than one row matches"):
        op.join_ns(left, twice.union(twice), ["k", "j"], expect="m:1").collect()


def test_join_agg(left, right):
    out = op.join_agg(left, right, "k", {"n": F.count("*"), "top": F.max("b")})
    assert rows(out, "a", "n", "top") == [(10, 2, 5), (11, 2, 5), (12, 2, 3), (13, None, None), (14, 2, 3)]


def test_full_outer_follows_sql(left, right):
    out = op.full_outer(left.select("k", "a"), right.select("k", "b"), ["k"])
    expected = left.select("k", "a").join(right.select("k", "b"), "k", "full")
    assert rows(out, "k", "a", "b") == rows(expected, "k", "a", "b")


def test_exclude_pairs(left):
    assert rows(op.exclude_pairs(left, ["k", "j"], [(1, "x"), (None, "x"), (9, "q")]), "a") == [(11,), (13,), (14,)]
    assert op.exclude_pairs(left, ["k", "j"], []).count() == 5


def test_long_lists_are_joined_like_tables(left):
    assert "ResolvedHint" not in op.inline_table(left, [(i,) for i in range(10_001)], "i int")._jdf.queryExecution().analyzed().toString()
    pairs = op.inline_table(left, [(1, "x"), (None, "x"), (9, "q")], "k int, j string")
    assert rows(op.exclude_pairs(left, ["k", "j"], pairs), "a") == [(11,), (13,), (14,)]


def test_split_by_team(frame):
    df = frame("i int, owner string", (1, "ann"), (2, "bob"), (3, None), (4, "zed"))
    roster = [("ann", "data"), ("bob", "field"), ("bob", "clinic")]
    expected = [(1, "data"), (2, "clinic"), (2, "field"), (3, "others"), (4, "others")]
    assert rows(op.split_by_team(df, "owner", roster), "i", "team") == expected
    table = frame("owner string, team string", *roster)
    assert rows(op.split_by_team(df, "owner", table), "i", "team") == expected


def test_split_by_pattern(frame):
    df = frame("i int, owner string", (1, "ann"), (2, "annabob"), (3, None))
    tests = [("a", F.col("owner").contains("ann")), ("b", F.col("owner").contains("bob"))]
    out = op.split_by_pattern(df, "owner", tests)
    assert out.columns == ["i", "team"]
    assert rows(out) == [(1, "a"), (2, "a"), (2, "b")]


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_band_join_is_the_join_with_between(frame, width):
    rng = random.Random(3)
    points = frame("i int, k string, x int", *[(i, rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 60)])) for i in range(200)])
    bands = [(rng.choice(["a", "b", None]), low, low + rng.choice([-1, 0, 1, 5, 30, 90])) for low in range(-50, 60, 3)]
    bands = frame("kk string, lo int, hi int, name string", *[(*b, f"b{n}") for n, b in enumerate(bands)], ("a", None, 3, "open"), ("a", 3, None, "open"))
    both = (points.k == bands.kk) & points.x.between(bands.lo, bands.hi)
    for how in ("left", "inner"):
        got = op.band_join(points, bands, [("k", "kk")], "x", "lo", "hi", width, how)
        assert rows(got, "i", "name") == rows(points.join(bands, both, how), "i", "name")
        assert got.columns == ["i", "k", "x", "lo", "hi", "name"]
    assert op.band_join(points, bands.limit(0), [("k", "kk")], "x", "lo", "hi").count() == 200


@pytest.mark.parametrize("how", ["left", "inner"])
def test_pairs_of_a_busy_cell_are_dealt_out(frame, monkeypatch, how):
    """Three points in four and most bands share a key and a cell: tasks go through a part of the pairs, points without bands kept once."""
    monkeypatch.setattr(joins, "TASK_PAIRS", 500)
    points = frame("i int, k string, x int", *[(i, None if i % 9 == 0 else "a" if i % 4 else "b", None if i % 11 == 0 else i % 10) for i in range(600)], *[(i, "c", 3) for i in range(700, 900)])
    bands = frame("kk string, lo int, hi int, name int", *[("a", n % 7, n % 7 + 3, n) for n in range(60)], ("b", 2, 4, 100), (None, 0, 9, 101))
    both = (points.k == bands.kk) & points.x.between(bands.lo, bands.hi)
    got = op.band_join(points, bands, [("k", "kk")], "x", "lo", "hi", 10, how)
    assert got.columns == ["i", "k", "x", "lo", "hi", "name"]
    assert rows(got, "i", "k", "x", "name", "lo", "hi") == rows(points.join(bands, both, how), "i", "k", "x", "name", "lo", "hi")
    sizes = [r["count"] for r in got.where("name is not null").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4
