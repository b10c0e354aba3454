"""Mixing to target weights with soft domain membership.

A softmax classifier, fitted on labelled documents, gives every document a
posterior over domains. With t tokens and posterior p a document kept at rate w
is expected to bring w * t * p[d] tokens to domain d. Rates are the solution of

    least squares over domains of  sum_i w_i t_i p_i[d] - share[d] * total,  w >= least,

by projected gradient. The metric weighs a document by its tokens, so documents
of equal posterior get equal rates whatever their length, and residuals are
scaled by the inverse of the domains' Gram matrix. Steps go on until the shares are reached or
nothing moves any more, with momentum where that takes many; a fit that does
neither is an error. Only the residual, one number per domain, comes to the
driver; a document's rate is a fold over the steps' residuals, computed where
the document is.

A target that no document or next to none belongs to cannot be reached by any
sensible rates. It is left out with a warning, and the others share its weight.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import staged, text_chunks

#: Labelled rows the classifier is fitted on, at most.
TRAIN_ROWS = 5000
#: Steps of the projected gradient after which it counts as failed, and the move of any domain's tokens (as a share of the total) that ends it.
STEPS, TOLERANCE = 2000, 1e-7
#: Residual of any domain (as a share of the total) at which a target counts as reached.
REACHED = 1e-6
#: Steps before momentum sets in, and steps folded before rates are written to the shared folder.
PLAIN, FOLD = 8, 100
#: A target needs documents of which it is the likelier side, and these need not be repeated more often than this to reach it.
CONFIDENT, MOST_REPEATS = 0.5, 100
#: With a least rate, the total aimed at is this much above the smallest that all domains can reach.
HEADROOM = 1.05
#: Target shares of expected tokens: four languages of clean text, and text labelled low in quality.
TARGETS = {"en": 0.45, "fr": 0.15, "de": 0.15, "es": 0.12, "low": 0.13}
_FIELDS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # features x domains, bias last


def text_features(texts: list[bytes | None]) -> np.ndarray:
    """Per text: root of the share of each byte value, and log length."""
    out = np.zeros((len(texts), 257), np.float32)
    for i, text in enumerate(texts):
        if text:
            out[i, :256] = np.sqrt(np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text))
            out[i, 256] = np.log1p(len(text))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = pa.schema([("domain", pa.string()), ("features", pa.list_(pa.float32()))])
    for batch, texts in text_chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(list(text_features(texts)), fields.types[1])], schema=fields)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def domain_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and domain of labelled documents: the language of good ones, `low` for the others.

    At most `train_rows` labelled ids, chosen by hash order.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(marks), "doc_id")
    return found.select("doc_id", "text", F.when(F.col("quality") == 1, F.col("lang")).otherwise("low").alias("domain"))


def train(rows: DataFrame, domains: list[str], steps: int = 300, l2: float = 1e-3) -> Classifier:
    """Fit on a bounded number of labelled rows (doc_id, text, domain); other domains and null texts are not used.

    A domain without any row keeps a small posterior everywhere.
    """
    known = rows.where(F.col("domain").isin(domains) & F.col("text").isNotNull())
    got = known.select("domain", "text").mapInArrow(_features, "domain string, features array<float>").toPandas()
    if got.empty:
        return Classifier(domains, np.zeros(257), np.ones(257), np.zeros((258, len(domains))))
    raw = np.stack(got["features"]).astype(np.float64)
    mean, scale = raw.mean(axis=0), raw.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1)
    x = np.concatenate([np.clip((raw - mean) / scale, -6, 6), np.ones((len(raw), 1))], axis=1)
    y = np.eye(len(domains))[[domains.index(d) for d in got["domain"]]]
    w = np.zeros((x.shape[1], len(domains)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = x.T @ (softmax(x @ w) - y) / len(x) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(domains, mean, scale, w)


def posteriors(texts: list[bytes | None], model: Classifier) -> np.ndarray:
    x = np.clip((text_features(texts) - model.mean) / model.scale, -6, 6)
    return softmax(np.concatenate([x, np.ones((len(x), 1))], axis=1) @ model.weights)


def _membership(model: Classifier):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            tokens = [len(t.split()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(tokens, pa.int64()), pa.array(list(posteriors(texts, model)), _FIELDS.types[3])], schema=_FIELDS)

    return work


def _moved(rows: DataFrame, steps: list[list[float]], least: float) -> DataFrame:
    """`rows` with rate and rate_before after the given steps, each its momentum and the vector a posterior is multiplied with."""
    if not steps:
        return rows
    done = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    k = len(steps[0]) - 1

    def move(state, s):
        rate, before = state["rate"], state["rate_before"]
        pull = sum((F.col("posterior")[d] * s[d + 1] for d in range(1, k)), F.col("posterior")[0] * s[1])
        return F.struct(F.greatest(F.lit(float(least)), rate + s[0] * (rate - before) - pull).alias("rate"), rate.alias("rate_before"))

    state = F.aggregate(done, F.struct("rate", "rate_before"), move)
    return rows.withColumn("_state", state).withColumns({"rate": F.col("_state.rate"), "rate_before": F.col("_state.rate_before")}).drop("_state")


def fit_rates(members: DataFrame, shares: list[float], least: float = 0.0, total: float | None = None, steps: int = STEPS, names: Sequence[str] | None = None) -> DataFrame:
    """`members` (n_tokens, posterior) with `rate`.

    `total` is the token count aimed at; None asks for as many as let every
    domain reach its share without going under rate `least` (under 1 when that is 0).
    Targets without documents (see MOST_REPEATS) are left out and the others'
    shares add up to 1; without any target left all rates are alike. Warns of
    targets left out or out of reach, `names` of domains given; fails if `steps`
    do not settle the rates.
    """
    k = len(shares)
    names = list(names or map(str, range(k)))
    tokens = F.col("n_tokens").cast("double")
    cell = [F.coalesce(F.sum(tokens * F.col("posterior")[a] * F.col("posterior")[b]), F.lit(0.0)) for a in range(k) for b in range(k)]
    have = [F.coalesce(F.sum(tokens * F.col("posterior")[d]), F.lit(0.0)) for d in range(k)]
    sure = [F.coalesce(F.sum(F.when(F.col("posterior")[d] >= CONFIDENT, tokens * F.col("posterior")[d])), F.lit(0.0)) for d in range(k)]
    got = members.agg(*(c.alias(f"c{i}") for i, c in enumerate([*cell, *have, *sure]))).first()
    gram, have, sure = np.array(got[: k * k]).reshape(k, k), np.array(got[k * k : k * k + k]), np.array(got[k * k + k :])
    start = max(1.0, least)
    current = members.withColumns({"rate": F.lit(start), "rate_before": F.lit(start)})
    share = np.array(shares, float) / sum(shares)
    aim = share * (float(have.sum()) if total is None else total)
    use = (sure > 0) & (sure * MOST_REPEATS >= aim)
    if have.sum() and not use.all():
        warnings.warn(f"mixing: targets without documents are left out: {[n for n, u in zip(names, use, strict=True) if not u]}", stacklevel=2)
    if not use.any():
        return current.drop("rate_before")
    share = np.where(use, share, 0) / share[use].sum()
    if total is None:
        total = float((have[use] / share[use]).max()) * least * HEADROOM if least else float(have[use].sum())
    # With the inverse Gram matrix as metric the gradient's constant is 1, and without bound one step is exact.
    metric = np.zeros((k, k))
    metric[np.ix_(use, use)] = np.linalg.pinv(gram[np.ix_(use, use)], rcond=1e-9, hermitian=True)
    done: list[list[float]] = []
    before = brought = have * start
    loss = lambda b: float((b - share * total) @ metric @ (b - share * total))
    weight, still = 1.0, 0
    for step in range(steps):
        # Momentum starts anew when the last step did not come closer.
        if step < PLAIN or loss(brought) > loss(before):
            weight, momentum = 1.0, 0.0
        else:
            momentum, weight = (weight - 1) / ((1 + np.sqrt(1 + 4 * weight**2)) / 2), (1 + np.sqrt(1 + 4 * weight**2)) / 2
        ahead = brought + momentum * (brought - before)
        done.append([float(momentum), *(metric @ (ahead - share * total)).tolist()])
        moved, before = _moved(current, done, least), brought
        brought = np.array(moved.agg(*(F.coalesce(F.sum(F.col("rate") * tokens * F.col("posterior")[d]), F.lit(0.0)) for d in range(k))).first())
        off = np.abs(brought - share * total)[use].max()
        still = still + 1 if np.abs(brought - before).max() <= TOLERANCE * max(total, 1.0) else 0
        # A slow approach also moves little, so that short of the targets one small move proves nothing.
        if still and off <= REACHED * max(total, 1.0) or still >= 5:
            break
        if len(done) == FOLD:
            current, done = staged(moved, "rates"), []
    else:
        raise RuntimeError(f"mixing: rates did not settle in {steps} steps")
    if off > 1e-3 * max(total, 1.0):
        warnings.warn(f"mixing: shares out of reach: {dict(zip(names, np.round(brought / max(total, 1.0), 4).tolist(), strict=True))}", stacklevel=2)
    return _moved(current, done, least).drop("rate_before")


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, least: float = 0.0, total: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens, posterior (in the order of `targets`), domain, rate.

    A null text has no tokens and the posterior of an empty one; repeated rows
    get equal rates; rows without an id take part. Of other columns those named in
    `keep` are passed on; an empty table gives no rows. Targets without documents
    are left out (see fit_rates).
    """
    domains = list(targets)
    model = train(domain_rows(docs, labels), domains)
    members = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_membership(model), "doc_id long, text_hash long, n_tokens long, posterior array<double>")
    rated = fit_rates(staged(members, "membership"), [targets[d] for d in domains], least, total, names=domains)
    names = F.array(*map(F.lit, domains))
    best = F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    rated = rated.select("doc_id", "text_hash", "n_tokens", "posterior", best.alias("domain"), "rate")
    if not keep:
        return rated.drop("text_hash")
    # Equal texts have equal rates, so repeated rows meet one of themselves.
    one = rated.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}).dropDuplicates(["_id", "_hash"])
    carried = docs.select("doc_id", "text", F.struct(*[c for c in keep if c != "doc_id"]).alias("_kept"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    out = carried.join(one, same)
    return out.select("doc_id", *(F.col("_kept")[c].alias(c) for c in keep if c != "doc_id"), "n_tokens", "posterior", "domain", "rate")
