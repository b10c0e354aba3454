import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import hard_negatives as hn

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<{}>, label int, q int, block int"


def brute(rows, every, positives, negatives, percent, scale):
    good = {(i, None if v is None else tuple(None if x is None or not math.isfinite(x) else math.floor(scale * Fraction(x)) for x in v), label) for i, v, label in rows}
    good = [r for r in good if r[0] is not None and r[2] is not None and r[1] is not None and None not in r[1]]
    out = []
    for a, av, al in good:
        if a % every:
            continue
        others = [(-sum(x * y for x, y in zip(av, v)), i, label) for i, v, label in good if len(v) == len(av)]
        same = sorted((s, i) for s, i, label in others if label == al and i != a)[:positives]
        for p, positive in same:
            low = sorted((s, i) for s, i, label in others if label != al and percent * -p <= 100 * -s <= 100 * -p)[:negatives]
            out += [(a, positive, r, i, -p, -s) for r, (s, i) in enumerate(low, 1)]
    return sorted(out)


def found(spark, rows, kind, **how):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA.format(kind))
    out = hn.hard_negatives(df, F.col("vec_id") % 4 == 0, **how)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 10))
    vectors = (base[rng.integers(0, 12, 260)] + 0.3 * rng.standard_normal((260, 10))).astype(np.float32)
    out = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    out += [(300 + i, out[i][1], i % 3) for i in range(40)]  # ties
    out += [out[0], out[4], (4, out[8][1], 2), (8, out[8][1], 1)]  # repeated rows, one id with other labels and vectors
    odd = [None, [], [], [float("nan")] * 10, [float("-inf")] + [0.0] * 9, [None] + [0.0] * 9, [1.0, 2.0], [2.0, 1.0], [0.5, 0.5], [0.0] * 10]
    out += [(400 + i, v, i % 2) for i, v in enumerate(odd)]
    return out + [(None, out[0][1], 0), (500, out[0][1], None)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_as_all_pairs_say(spark, rows, kind, monkeypatch):
    monkeypatch.setattr(hn, "TILE", 160)  # tiles of 16 rows, several blocks of anchors, several passes
    monkeypatch.setattr(hn, "BLOCK", 100)
    monkeypatch.setattr(hn, "PASS", 200)
    got = found(spark, rows, kind, positives=5, negatives=3, percent=60)
    assert got and got == brute(rows, 4, 5, 3, 60, 256)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [2.0, 0.0], 2)]
    assert found(spark, rows, "double") == [(0, 1, 1, 2, 65536, 58880)]


def test_empty_tables(spark):
    assert found(spark, [], "float") == [] and found(spark, [(1, [1.0], 1), (2, [1.0], 1)], "float") == []


def test_fields_of_every_width_are_exact():
    rng = np.random.default_rng(1)
    for size in (3, 200, 1 << 20, 1 << 28, 1 << 29):
        for low in (-size, 0, -3 * size // 4):
            a, c = rng.integers(low, size, (5, 7)), rng.integers(-size, max(1, low), (33, 7))
            got = np.stack(list(hn.inner_products(a, c)))
            assert (got == a @ c.T).all()
    assert [s.tolist() for s in hn.inner_products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64))] == [[0, 0, 0]] * 2
    big = np.full((1, 2), 1 << 31, np.int64)
    with pytest.raises(ValueError, match="64 bits"):
        list(hn.inner_products(big, big))
