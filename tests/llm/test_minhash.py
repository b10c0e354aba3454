from collections import defaultdict

import numpy as np
import pytest

from studyloom.llm import minhash
from studyloom.llm.components import components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    """component per row index, by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    smallest = defaultdict(lambda: 10**18)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(smallest[find(i)], d)
    return [(d, len(s), None if d is None else smallest[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def edited(text, places, seed):
    words = text.split()
    rng = np.random.default_rng(seed)
    for p in rng.choice(len(words), places, replace=False):
        words[p] = f"w{rng.integers(6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(prose, awkward):
    base = prose(150, 1)
    group = [edited(base, n % 9, n) for n in range(70)]  # a group, its strays, and chains between them
    texts = [*awkward, base, base.upper(), base, *group, prose(40, 2), prose(40, 3), "ONE", "one  two", "one two three four five six"]
    out = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    return [*out, out[9], (None, base), (None, None), (5, base), (5, prose(40, 2) + " end")]


@pytest.mark.parametrize("width", [4, 5])
def test_groups_are_those_of_all_pairs(documents, rows, width):
    out = minhash.near_duplicates(documents(rows), width, 80)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=key) == sorted(brute(rows, width, 80), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_empty_table_gives_no_rows(documents):
    assert minhash.near_duplicates(documents([]), 4).count() == 0
    assert sorted(minhash.near_duplicates(documents([(1, None), (2, "")]), 4).select("component_id", "kept").collect()) == [(1, True), (2, True)]


def test_signatures_are_super_minhash():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 200).astype(np.uint64)])
    both = minhash.super_minhash(np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 2], [600, 600, 1]), 3)
    assert abs((both[0] == both[1]).mean() - 400 / 800) < 0.13
    assert both.shape == (3, minhash.POSITIONS) and (both != np.uint64(2**64 - 1)).all()
    # One element fills every position, each at another rank.
    assert sorted((both[2] >> np.uint64(32)).tolist()) == list(range(minhash.POSITIONS))
    # A set's signature does not depend on what is signed beside it.
    assert (minhash.super_minhash(b, np.zeros(600, np.int64), 1)[0] == both[1]).all()
    # Position by position the sequential definition: smallest rank + uniform of any element.
    few = a[:5]
    alone = [minhash.super_minhash(few[i : i + 1], np.zeros(1, np.int64), 1)[0] for i in range(5)]
    assert (minhash.super_minhash(few, np.zeros(5, np.int64), 1)[0] == np.min(alone, axis=0)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(30, 20), (40, 41), (41, 40), (7, 7), (50, 50), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.root for r in components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 30: 1, 40: 40, 41: 40}
    assert components(df.limit(0)).count() == 0


def test_repeated_rows_are_one_set(documents, prose, monkeypatch):
    """Copies of a row are compared as one, so pairs do not grow with the square of the copies."""
    held, kept = {}, minhash.staged
    monkeypatch.setattr(minhash, "staged", lambda df, name: held.setdefault(name, kept(df, name)))
    text = prose(200, 1)
    rows = [(1, text)] * 120 + [(2, text + " more")] * 120 + [(3, prose(200, 2))]
    got = minhash.near_duplicates(documents(rows), 4).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)} and len(got) == 241
    assert held["sets"].count() == 2
