import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from studyloom.llm import lexical_search as ls

TERM = re.compile(ls.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_all, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, tuple(sorted(set(terms(t))))) for i, t in items if i is not None}:
        scored = []
        for doc, counts in held:
            m = 100 - 50 + (50 * sum(counts.values()) * n_all) // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in text if t in counts)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], "item_id long, text string, item int, n int")


@pytest.fixture(scope="module")
def docs(prose, awkward):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    rows = [(1000 - i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 90)))) for i in range(400)]
    rows += [(2000 + i, rows[i % 7][1]) for i in range(70)]  # ties
    rows += [(3000 + i, t) for i, t in enumerate(awkward)] + [(None, rows[0][1]), (None, "w119 w118"), rows[3], rows[3], (5, "W1,w2;w3-É É é")]
    return rows


@pytest.fixture(scope="module")
def items(docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(130)], k=rng.randint(1, 40)))) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, "--- !"), (None, "w1"), (53, "same X é"), rows[0], (1, "w7 w8"), (54, "É unheard"), (55, "x " * 50_000 + "w5")]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_as_every_document_scored_in_full(spark, documents, docs, items, k):
    got = ls.search(documents(docs).repartition(3), items_of(spark, items), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, k)


def test_blocks_of_items_change_nothing(spark, documents, docs, items, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_TERMS", 300)
    got = ls.search(documents(docs), items_of(spark, items), 10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 10)


def test_empty_tables(spark, documents, docs, items):
    assert ls.search(documents([]), items_of(spark, items)).count() == 0
    assert ls.search(documents(docs), items_of(spark, [])).count() == 0


def test_accumulators_stop_and_the_best_stay_exact():
    rng = np.random.default_rng(2)
    spans, docs, parts = [0], [], []
    for size in (5, 40, 300, 900, 1000):
        docs.append(np.sort(rng.choice(1000, size, replace=False)))
        parts.append(rng.integers(1, 3, size) * 4000 // size + 1)
        spans.append(spans[-1] + size)
    most = np.array([p.max() for p in parts])
    docs, parts = np.concatenate(docs), np.concatenate(parts)
    every = np.bincount(docs, parts, 1000).astype(np.int64)
    score = ls.accumulate(np.arange(5), np.array(spans), docs, parts, most, 1000, 3, 0)
    assert 3 <= (score > 0).sum() < 60
    assert np.array_equal(np.sort(score)[-3:], np.sort(every)[-3:]) and (score[score > 0] == every[score > 0]).all()
    assert not ls.accumulate(np.arange(5), np.array(spans), docs, parts, most, 1000, 3, int(most.sum()) + 1).any()
