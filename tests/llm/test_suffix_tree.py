import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import suffix_tree


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def symbols(text):
    t = tokens(text)
    return b" ".join(t) if len(t) > 1 else b"\n"


def plain_score(train, texts, depth, growth, least, divergence, prior):
    """The same tree by dictionaries, symbol by symbol."""
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    for t in train:
        s = b"\n" * depth + symbols(t)
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                counts[k][s[i - k : i]][s[i]] += 1
    total = sum(counts[0][b""].values())

    def prob(context, c):
        n = counts[len(context)].get(context, Counter())
        if not context:
            return (n[c] + 0.5) / (total + 128)
        weight = prior * len(n)
        return (n[c] + weight * prob(context[1:], c)) / (sum(n.values()) + weight) if n else prob(context[1:], c)

    kept = {b""}
    for k in range(1, depth + 1):
        for context, n in counts[k].items():
            whole = sum(n.values())
            ratio = 2 * sum(m * np.log(m / whole / prob(context[1:], c)) for c, m in n.items())
            if whole >= max(least, math.ceil(growth * math.sqrt(total))) and ratio >= divergence * max(len(n) - 1, 1):
                kept |= {context[j:] for j in range(len(context))}
    out = []
    for t in texts:
        s, score = b"\n" * depth + symbols(t), 0.0
        for i in range(depth, len(s)):
            k = max(k for k in range(depth + 1) if s[i - k : i] in kept)
            score += np.log10(prob(s[i - k : i], s[i]))
        out.append(score)
    return out, kept


@pytest.fixture(scope="module")
def rows(prose, awkward):
    texts = [*awkward[:6], "x " * 900, *(prose(60 + n, n) for n in range(25)), "Zebra QUAGGA \x01", prose(80, 3)]
    return [*((i, t) for i, t in enumerate(texts)), (None, "no id"), (7, texts[7]), (8, "another text")]


@pytest.mark.parametrize("part_rows, pass_rows", [(suffix_tree.PART_ROWS, suffix_tree.PASS_ROWS), (900, 900), (300, suffix_tree.PASS_ROWS)])
def test_scores_are_those_of_the_plain_tree(documents, rows, monkeypatch, part_rows, pass_rows):
    """In one pass, in parts of the tree that add up, and in one pass with a tree joined from parts."""
    fit = suffix_tree.fit_trees
    parts = []
    monkeypatch.setattr(suffix_tree, "fit_trees", lambda counts: iter(parts.append(t) or t for t in fit(counts, part_rows=part_rows, pass_rows=pass_rows)))
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0.004)  # so that both look-ups are used
    docs = documents(rows)
    out = suffix_tree.score(docs, suffix_tree.training_texts(docs))
    train = [t for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    texts = [t for _, t in rows]
    scores, kept = plain_score(train, texts, suffix_tree.DEPTH, suffix_tree.GROWTH, suffix_tree.LEAST, suffix_tree.DIVERGENCE, suffix_tree.PRIOR)
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for (d, t), score in zip(rows, scores):
        own = tokens(t)
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((d, len(own), sum(c[w] > 0 for w in own), n, round(base, 5), round(score, 5)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in out.collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-6, atol=1e-4)
    assert len(kept) > 100 and {len(k) for k in kept} == set(range(suffix_tree.DEPTH + 1))
    assert sum(t.contexts() - 1 for t in parts) == len(kept) - 1
    assert (len(parts) > 2) == (pass_rows == 900) and sum(t.before.sum() for t in parts) == 256


def test_divergence_and_count_prune_the_tree(documents, rows):
    counts = suffix_tree.counts_of(documents(rows))
    sizes = [next(suffix_tree.fit_trees(counts, growth=g, divergence=d)).contexts() for g, d in ((1 / 700, 2), (1 / 700, 20), (1, 2))]
    assert sizes[0] > sizes[1] and sizes[0] > sizes[2]


def test_distributions_sum_to_one(documents, rows):
    tree = next(suffix_tree.fit_trees(suffix_tree.counts_of(documents(rows))))
    depth = len(tree.levels)
    contexts = np.concatenate([np.zeros(1, np.int64), *(names << 8 * (depth - k) for k, (names, *_) in enumerate(tree.levels, 1))])
    grams = (contexts[:, None] << 8 | np.arange(256)).ravel()
    mass = (10 ** suffix_tree._log10_of(grams, tree.root, tree.levels)).reshape(-1, 256).sum(axis=1)
    assert np.allclose(mass, 1)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_the_tree_grows_and_beats_independent_tokens(spark):
    """More text keeps more contexts; texts held out are likelier than under the base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = suffix_tree.training_texts(docs)
    sizes = [next(suffix_tree.fit_trees(suffix_tree.counts_of(t))).contexts() for t in (train.where("doc_id % 4 = 0"), train)]
    assert sizes[1] > 1.3 * sizes[0]
    held = suffix_tree.score(docs.join(train.select("doc_id"), "doc_id", "left_anti"), train).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_empty_tables(documents):
    none = documents([])
    assert suffix_tree.score(none, none).count() == 0
    one = suffix_tree.score(documents([(1, "a b"), (2, None)]), none).collect()
    assert {r.doc_id: r.n_known for r in one} == {1: 0, 2: 0} and all(np.isclose(r.score, r_len * np.log10(1 / 256)) for r, r_len in zip(sorted(one), (5, 1)))
