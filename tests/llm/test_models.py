"""Fitted models: exactness of their parts, held-out quality, and odd inputs."""

import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import line_crf, mixing, toxicity
from studyloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def auc(label, score):
    rank = np.argsort(np.argsort(score)) + 1.0
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()


# ------------------------------------------------------------- line CRF


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(3)
    links = rng.standard_normal((2, 2))
    per_text = np.array([4, 1, 6])
    odds = rng.standard_normal(per_text.sum()) * 2
    padded, mask = line_crf._padded(odds, per_text)
    marginal, pairs, normaliser = line_crf.forward_backward(padded, mask, links)
    all_pairs, starts = np.zeros((2, 2)), np.cumsum(per_text) - per_text
    for k, n in enumerate(per_text):
        own = odds[starts[k] : starts[k] + n]
        total, good, counts = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(o for o, v in zip(own, y) if v) + sum(links[a, b] for a, b in itertools.pairwise(y)))
            total += weight
            good += weight * np.array(y)
            for a, b in itertools.pairwise(y):
                counts[a, b] += weight
        assert np.allclose(marginal[k, :n], good / total) and np.isclose(normaliser[k], np.log(total))
        all_pairs += counts / total
    assert np.allclose(pairs, all_pairs)


def test_a_text_scores_alike_in_any_company():
    rng = np.random.default_rng(0)
    width = 3 * line_crf.OWN
    model = line_crf.Model(np.zeros(width), np.ones(width), rng.standard_normal(width), rng.standard_normal((2, 2)))
    texts = [b"One line.\nTwo | two\n\n!!", None, b"", b"x\n" * 300, "é ü".encode(), b"a " * 50_000]
    together = line_crf.score_texts(texts, model)[0]
    assert np.allclose(together, [line_crf.score_texts([t], model)[0][0] for t in texts])
    assert ((together >= 0) & (together <= 1)).all() and together[1] == together[2]


def test_line_features_against_plain_counts(awkward):
    texts = [t if t is None else t.encode() for t in awkward]
    texts += [b"One two two.\nOne two two.\n\n | 3 #\t\n", "é Ü\x00 x!".encode(), b"a" * 300 + b"\nEnd?  "]
    got, lengths, per_text = line_crf.line_features(texts)
    want = []
    for text in texts:
        lines = (text or b"").split(b"\n")
        for line in lines:
            shares = [sum(c in kind for c in line) / max(len(line), 1) for kind in line_crf._CLASSES]
            shares.append(sum(not any(c in kind for kind in line_crf._CLASSES) for c in line) / max(len(line), 1))
            words = line.split()
            n = len(words)
            told = [len(set(words)) / n, max(words.count(w) for w in words) / n, sum(w[:1].isupper() for w in words) / n, line.split()[-1][-1:] in (b".", b"!", b"?")] if n else [0] * 4
            want.append([*shares, np.log1p(len(line)), np.log1p(n), min(len(line) / max(n, 1), 50), *told, np.log(lines.count(line)), 1])
    assert per_text.tolist() == [(t or b"").count(b"\n") + 1 for t in texts] and lengths.sum() + per_text.sum() - len(texts) == sum(len(t or b"") for t in texts)
    assert np.allclose(got, np.array(want, float), atol=1e-5)
    wide = line_crf.with_neighbours(got, per_text)
    at = 0
    for n in per_text:
        for k in range(n):
            zero = np.zeros(line_crf.OWN)
            before, after = got[at + k - 1] if k else zero, got[at + k + 1] if k + 1 < n else zero
            assert np.allclose(wide[at + k], np.concatenate([got[at + k], before, after]))
        at += n


def test_crf_fit_is_the_top_of_the_plain_likelihood():
    rng = np.random.default_rng(8)
    per_text = rng.integers(1, 5, 24)
    label = np.arange(24) % 2
    x = rng.standard_normal((per_text.sum(), 3)) + 0.6 * np.repeat(label, per_text)[:, None] * [1, -1, 0]
    model = line_crf.fit(x, per_text, label, steps=3000, l2=0.05)
    own = np.split((x - model.mean) / model.scale, np.cumsum(per_text)[:-1])

    def loss(params):
        """Minus the mean log-likelihood over all labellings, and the penalty."""
        w, links = params[:3], params[3:].reshape(2, 2)
        weight = lambda odds, y: np.exp(sum(o for o, v in zip(odds, y) if v) + sum(links[a, b] for a, b in itertools.pairwise(y)))
        total = 0.05 / 2 * (params @ params)
        for rows, y in zip(own, label, strict=True):
            odds = rows @ w
            total -= np.log(weight(odds, [y] * len(odds)) / sum(weight(odds, other) for other in itertools.product((0, 1), repeat=len(odds)))) / len(own)
        return total

    top = np.concatenate([model.weights, model.links.ravel()])
    slopes = [(loss(top + 1e-4 * e) - loss(top - 1e-4 * e)) / 2e-4 for e in np.eye(7)]
    assert np.abs(slopes).max() < 1e-3 and loss(top) < loss(np.zeros(7)) - 0.1


@needs_data
def test_quality_of_held_out_documents(spark):
    scored = QUERIES["op6_line_crf"](spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.98 and (held.predicted == held.quality).mean() > 0.95
    assert (scored.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in scored.doc_id]).all()
    assert len(scored) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_training_on_very_long_texts_is_bounded(spark, documents, monkeypatch):
    good, bad = "A clear sentence follows here.\n", "|| 00 ##\n"
    rows = [(1, good * 100_000), (2, bad * 100_000), *((i, (good, bad)[i % 2] * 3) for i in range(3, 40))]
    labels = spark.createDataFrame([(i, int(good in t), 0) for i, t in rows], "doc_id long, quality int, toxic int")
    fitted = []
    fit = line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda x, lines, label: fitted.append((len(x), lines.max())) or fit(x, lines, label, steps=40))
    model = line_crf.train(documents(rows), labels, train_lines=20_000)
    assert 5_000 < fitted[0][0] < 40_000 and fitted[0][1] <= line_crf.SLICE
    scores = line_crf.score_texts([good.encode() * 50, bad.encode() * 50], model)[0]
    assert scores[0] > 0.9 and scores[1] < 0.1


def test_quality_of_odd_tables(spark, documents, awkward):
    docs = documents([*enumerate(awkward), (None, "x"), (0, None)])
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(8)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (4, 7, 0, "x")], "doc_id long, quality int, toxic int, text string")
    out = line_crf.quality(docs, line_crf.train(docs, labels)).collect()
    assert len(out) == 10 and all(0 <= r.score <= 1 for r in out)
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert line_crf.quality(docs, line_crf.train(docs, few)).count() == 10
    assert line_crf.quality(documents([]), line_crf.train(documents([]), labels)).count() == 0


# -------------------------------------------------------------- toxicity


def test_ordinal_regression_finds_order_and_weights():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000)
    grade = (z > 0).astype(int) + (z > 1.5) + (z > 3)
    row, col = np.repeat(np.arange(4000), 3), np.tile(np.arange(3), 4000)
    weights, cuts = toxicity.fit_ordinal(row, col, x.ravel(), grade, 3)
    assert np.allclose(weights, [2, -1, 0], atol=0.2) and np.allclose(cuts, [0, 1.5, 3], atol=0.2)


def test_ordinal_fit_against_a_plain_maximiser():
    rng = np.random.default_rng(4)
    x = rng.poisson(0.7, (150, 3)).astype(float)
    grade = np.digitize(x @ [1.0, -0.5, 0.8] + rng.logistic(size=150), [0.5, 1.5, 3.0])
    grade[:10] = 3
    weights, cuts = toxicity.fit_ordinal(*np.nonzero(x), x[np.nonzero(x)], grade, 3, prior=0.5, steps=4000)

    def loss(w, t):
        """Minus the log posterior, text by text."""
        total = 0.25 * sum(v * v for v in w)
        for one, g in zip(x, grade, strict=True):
            z = sum(a * b for a, b in zip(one, w, strict=True))
            above = [1.0, *(1 / (1 + np.exp(c - z)) for c in t), 0.0]
            total -= np.log(above[g] - above[g + 1])
        return total

    # Coordinates in turn, by ever smaller steps.
    best, size = [np.zeros(3), np.array([0.0, 1.0, 2.0])], 1.0
    least = loss(*best)
    while size > 1e-4:
        moved = False
        for part, k, sign in itertools.product((0, 1), range(3), (size, -size)):
            tried = [best[0].copy(), best[1].copy()]
            tried[part][k] += sign
            if (np.diff(tried[1]) > 0).all() and (value := loss(*tried)) < least:
                best, least, moved = tried, value, True
        size = size if moved else size / 2
    assert loss(weights, cuts) < least + 1e-3
    assert np.allclose(weights, best[0], atol=0.02) and np.allclose(cuts, best[1], atol=0.02)


def test_severity_against_a_plain_scorer(spark, documents, awkward):
    names = {"foul": 0, "foul*": 1, "word": 2, "no": 3}
    model = toxicity.Model(names, np.array([1.5, 0.7, -0.4, 0.2, 0.3]), np.array([0.5, 1.4, 2.2]))
    texts = [*awkward, "Foul word, FOULER word no!", "foul " * 300 + "no", "foulest foulest\nno-no"]
    out = {r.doc_id: r for r in toxicity.severity(documents(list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        z = 0.3 * np.log1p(len(words)) / 10
        for name, k in names.items():
            n = sum(w == name or name.endswith("*") and len(w) > len(name) - 1 and w.startswith(name[:-1]) for w in words)
            z += model.weights[k] * (1 + np.log(n)) if n else 0.0
        above = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert np.isclose(out[i].severity, sum(above)) and np.isclose(out[i].p_toxic, above[0])
        assert out[i].grade == sum(a >= 0.5 for a in above)


def test_few_toxic_texts_are_enough_for_their_words(spark, documents, prose):
    rows = [(i, prose(60, i) + (" wretch" if i < 4 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i < 4), "x") for i in range(60)], "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(documents(rows), labels)
    got = toxicity.severity(documents([(1, prose(60, 500) + " Wretch!"), (2, prose(60, 501))]), model).collect()
    p = {r.doc_id: r.p_toxic for r in got}
    assert p[1] >= 0.5 > p[2]


@needs_data
def test_toxic_documents_are_caught_and_clean_ones_left(spark):
    scored = QUERIES["op9_toxicity"](spark, FOLDER.replace("0.01", "0.1")).toPandas()
    labels = spark.read.parquet(f"{FOLDER.replace('0.01', '0.1')}/labels.parquet").toPandas()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    caught = held.p_toxic >= 0.5
    assert caught[held.toxic == 1].mean() > 0.85 and caught[held.toxic == 0].mean() < 0.01
    assert (scored.severity.between(0, 3)).all() and set(scored.grade) <= {0, 1, 2, 3}


def test_toxicity_of_odd_tables(spark, documents, awkward):
    docs = documents([*enumerate(awkward), *((100 + i, "you awfulword" if i % 2 else "you kindword") for i in range(60)), (None, "awfulword"), (0, None)])
    labels = spark.createDataFrame([(100 + i, 1, i % 2, "x") for i in range(60)] + [(None, 1, 1, "x"), (0, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    out = toxicity.severity(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count()
    assert all((r.p_toxic >= 0.5) == (r.doc_id is None or r.doc_id >= 100 and r.doc_id % 2 == 1) for r in out)
    clean = toxicity.severity(docs, toxicity.train(docs, labels.where("toxic = 0")))
    assert clean.where("p_toxic >= 0.5").count() == 0
    assert toxicity.severity(documents([]), toxicity.train(documents([]), labels)).count() == 0


# ---------------------------------------------------------------- mixing


def test_rates_against_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.2, 0.2, 0.2], 200)
    t = rng.integers(0, 500, 200)
    share = np.array([0.5, 0.3, 0.2])
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "n_tokens long, posterior array<double>")
    rate = np.array([r.rate for r in mixing.fit_rates(df, share.tolist(), steps=200).collect()])
    reached = (rate * t) @ p
    assert (rate >= 0).all() and np.allclose(reached / t.sum(), share, atol=1e-4)
    # The nearest such rates to 1, documents weighed by tokens: 1 minus a combination of posteriors, cut at 0.
    free = rate > 1e-9
    fit = np.linalg.lstsq(p[free], 1 - rate[free], rcond=None)[0]
    if free.all():
        assert np.allclose(p @ fit, 1 - rate, atol=1e-6)
    above = np.array([r.rate for r in mixing.fit_rates(df, share.tolist(), least=1.0, steps=200).collect()])
    assert (above >= 1).all()
    brought = (above * t) @ p
    assert np.allclose(brought / brought.sum(), share, atol=0.02)


def test_posteriors_against_a_plain_classifier(spark, awkward):
    rng = np.random.default_rng(9)
    model = mixing.Classifier(["a", "b", "c"], rng.random(257) / 20, rng.random(257) + 0.1, rng.standard_normal((258, 3)))
    texts = [t if t is None else t.encode() for t in awkward] + [b"x", "Ünï ".encode() * 400]
    got = mixing.posteriors(texts, model)
    for text, row in zip(texts, got, strict=True):
        features = [np.sqrt(text.count(bytes([b])) / len(text)) if text else 0.0 for b in range(256)] + [np.log1p(len(text or b""))]
        z = [model.weights[257, d] + sum(min(max((f - m) / s, -6), 6) * w for f, m, s, w in zip(features, model.mean, model.scale, model.weights[:, d])) for d in range(3)]
        assert np.allclose(row, [np.exp(v - max(z)) / sum(np.exp(u - max(z)) for u in z) for v in z], atol=1e-4)


def test_classifier_fit_against_plain_descent(spark):
    """Its penalised loss is as low as that of plain gradient steps, many of them."""
    rng = np.random.default_rng(10)
    words = {"en": "the of and that with", "fr": "le des et que avec", "low": "## || 00 $$ %%"}
    rows = [(i, " ".join(rng.choice(words[d].split(), 30)), d) for i, d in enumerate(sorted(words) * 12)]
    rows += [(900, None, "en"), (901, "of no domain", "xx")]
    model = mixing.train(spark.createDataFrame(rows, "doc_id long, text string, domain string"), sorted(words))
    known = [r for r in rows if r[1] is not None and r[2] in words]
    x = np.clip((mixing.text_features([r[1].encode() for r in known]) - model.mean) / model.scale, -6, 6)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = np.eye(3)[[sorted(words).index(r[2]) for r in known]]

    def loss(w):
        z = x @ w
        z = z - z.max(axis=1, keepdims=True)
        return -(y * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum() / len(x) + 1e-3 / 2 * (w * w).sum()

    w = np.zeros_like(model.weights)
    for _ in range(4000):
        e = np.exp(x @ w - (x @ w).max(axis=1, keepdims=True))
        w -= 0.02 * (x.T @ (e / e.sum(axis=1, keepdims=True) - y) / len(x) + 1e-3 * w)
    assert loss(model.weights) < loss(w) + 5e-3


@needs_data
def test_mixing_reaches_its_targets(spark):
    got = QUERIES["op3_mixing"](spark, FOLDER).toPandas()
    for domain, share in mixing.TARGETS.items():
        assert abs((got.rate * got.n_tokens * got[f"p_{domain}"]).sum() / got.n_tokens.sum() - share) < 1e-3
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").drop("text").toPandas()
    known = got.merge(labels, on="doc_id").merge(docs, on="doc_id")
    assert (known.domain == known.lang.where(known.quality == 1, "low")).mean() > 0.95


def test_mixing_of_odd_tables(spark, documents, awkward):
    docs = documents([*enumerate(awkward), (None, "x y"), (None, "x y"), (0, None)])
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(8)] + [(None, 1, 0, "x")], "doc_id long, quality int, toxic int, rate string")
    out = mixing.mix(docs, labels, keep=["text", "source", "hash"]).collect()
    assert len(out) == 11 and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in out)
    assert {r.n_tokens for r in out if not (r.text or "").strip()} == {0}
    assert mixing.mix(docs, labels.limit(0)).count() == 11
    assert mixing.mix(documents([]), labels).count() == 0
    assert F is not None


def test_a_target_without_documents_is_left_out(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.dirichlet([0.1, 0.1, 0.1], 300), np.zeros((300, 1))], axis=1) + 1e-4 * rng.random((300, 4))
    p /= p.sum(axis=1, keepdims=True)
    t = rng.integers(1, 500, 300)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(t, p))], "doc_id long, n_tokens long, posterior array<double>")
    for least in (0.0, 1.0):
        with pytest.warns(UserWarning, match="left out: .'es'"):
            rate = np.array([r.rate for r in mixing.fit_rates(df, [0.45, 0.2, 0.23, 0.12], least, names=["en", "fr", "de", "es"]).orderBy("doc_id").collect()])
        brought = (rate * t) @ p
        assert np.allclose(brought[:3] / brought.sum(), np.array([0.45, 0.2, 0.23]) / 0.88, atol=0.02 if least else 1e-3)
        assert rate.max() < 10 and (rate >= least).all() and (rate > 0.1).mean() > 0.9


def test_rates_that_need_many_steps_settle_or_fail(spark):
    # Two domains told apart by little: a slow direction of the plain gradient.
    rng = np.random.default_rng(6)
    a = np.clip(0.5 + 0.05 * rng.standard_normal(400), 0, 1)
    p, t = np.stack([a, 1 - a], axis=1), rng.integers(1, 500, 400)
    df = spark.createDataFrame([(i, int(x), y.tolist()) for i, (x, y) in enumerate(zip(t, p))], "doc_id long, n_tokens long, posterior array<double>")
    share = np.array([0.53, 0.47])
    rate = np.array([r.rate for r in mixing.fit_rates(df, share.tolist()).orderBy("doc_id").collect()])
    assert np.allclose((rate * t) @ p / t.sum(), share, atol=1e-4) and (rate >= 0).all()
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fit_rates(df, share.tolist(), steps=5)
