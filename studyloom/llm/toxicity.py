"""Severity of toxic text by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w . x - t_k): one weight vector, shared by ordered
thresholds t_1 < t_2 < t_3. The output is the expected grade. The labels say
only toxic or not, so grades are made for training: 0 for clean text; toxic
text gets 1 to 3 by thirds of how many of its words mark toxic text in the
training rows.

Features are words (letters only, lower case) and their beginnings of 4 to 7
letters, kept if they recur in toxic training texts and occur there more often
than chance, plus the log length. A prior holds weights of little evidence
near 0, so that rare words may be kept in samples of every size. The model is
fitted on a bounded sample of labelled rows, at most TRAIN_ROWS; scoring reads
every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import in_fold, staged, text_chunks

#: Bounds of the model: labelled rows it is fitted on, and features it keeps.
TRAIN_ROWS, FEATURES = 20_000, 16_384
#: A feature must be in several toxic training texts, and this many standard deviations above chance.
LEAST_TEXTS, LEAST_Z = 2, 3.0
#: Inverse variance of the Gaussian prior of the weights.
PRIOR = 0.03
GRADES = 4
#: Words whose features are remembered between texts.
MEMO = 500_000
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [word, *(word[:n] + "*" for n in range(4, 8) if len(word) > n)]


@dataclass(frozen=True)
class Model:
    features: dict[str, int]
    weights: np.ndarray  # one per feature, then log length
    thresholds: np.ndarray


def _counter(features: dict[str, int]):
    """text -> (word count, words with a feature, Counter of feature numbers), with a bounded memo of words."""
    memo: dict[str, tuple[int, ...]] = {}

    def count(text: bytes | None):
        found, hits = Counter(), 0
        words = _LETTERS.findall((text or b"").decode("utf-8", "replace").lower())
        for word in words:
            ids = memo.get(word)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = memo[word] = tuple(features[f] for f in word_features(word) if f in features)
            if ids:
                found.update(ids)
                hits += 1
        return len(words), hits, found

    return count


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk of texts and feature: toxic and clean texts that have it."""
    fields = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for batch, texts in text_chunks(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(texts, batch.column("toxic").to_pylist(), strict=True):
            words = set(_LETTERS.findall((text or b"").decode("utf-8", "replace").lower()))
            seen[toxic].update({f for w in words for f in word_features(w)})
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], schema=fields)


def _vectors(features: dict[str, int]):
    fields = pa.schema([("toxic", pa.int32()), ("words", pa.int64()), ("hits", pa.int64()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(features)
        for batch, texts in text_chunks(batches):
            rows = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([list(r[2].keys()) for r in rows], fields.types[3]), pa.array([list(r[2].values()) for r in rows], fields.types[4])], schema=fields)

    return work


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, grades: int = GRADES, prior: float = PRIOR, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the log-likelihood and the weights' prior; x is given as (row, col, value)."""
    n = max(len(grade), 1)
    l2 = prior / n
    w, raw = np.zeros(width), np.zeros(grades - 1)  # thresholds: raw[0], then steps of exp(raw)
    raw[0] = 1.0
    params = np.concatenate([w, raw])
    m, v = np.zeros_like(params), np.zeros_like(params)
    # Grade g: sigma(z - t_g) - sigma(z - t_{g+1}), with t_0 = -inf and t_grades = inf.
    for step in range(1, steps + 1):
        w, raw = params[:width], params[width:]
        t = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        z = np.bincount(row, value * w[col], len(grade))
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30)))  # P(grade > k)
        above = np.concatenate([np.ones((len(z), 1)), s, np.zeros((len(z), 1))], axis=1)
        p = np.maximum(above[np.arange(len(z)), grade] - above[np.arange(len(z)), grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((len(z), 1)), s * (1 - s), np.zeros((len(z), 1))], axis=1)
        low, high = slope[np.arange(len(z)), grade], slope[np.arange(len(z)), grade + 1]
        dz = -(low - high) / p / n
        dt = np.array([((grade == k + 1) * low / p - (grade == k) * high / p).sum() / n for k in range(grades - 1)])
        draw = np.cumsum(dt[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
        g = np.concatenate([np.bincount(col, value * dz[row], width) + l2 * w, draw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, raw = params[:width], params[width:]
    return w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES, hold_out: bool = False) -> Model:
    """Fit on labelled documents, `train_rows` at most by hash order.

    `hold_out` leaves those out whose crc32(doc_id as text) mod 3 is 1.
    Labels other than 0 and 1 and rows without a text or id are not used. With
    no toxic or no clean row left the model calls everything clean. Rows that
    repeat an id count as texts of their own; other columns are ignored.
    """
    rows = labels.where("toxic in (0, 1) and doc_id is not null")
    if hold_out:
        rows = rows.where(~in_fold(F.col("doc_id"), 3, 1))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # TRAIN_ROWS bounds the broadcast list and the staged sample.
    sample = staged(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(rows), "doc_id"), "toxicity-sample")
    counts = sample.mapInArrow(_texts_with, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    sizes = sample.groupBy().agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = sizes["t"] or 0, sizes["c"] or 0
    if not toxic or not clean:
        return Model({}, np.zeros(1), np.array([50.0, 51.0, 52.0]))
    share = toxic / (toxic + clean)
    n = F.col("t") + F.col("c")
    z = (F.col("t") - n * share) / F.sqrt(n * share * (1 - share) + 1e-9)
    best = counts.where(F.col("t") >= LEAST_TEXTS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(features).collect()
    names = {r["feature"]: i for i, r in enumerate(best)}
    got = sample.select("toxic", "text").mapInArrow(_vectors(names), "toxic int, words long, hits long, ids array<int>, counts array<int>").toPandas()
    words = got["words"].to_numpy(float)
    lengths = np.array([len(x) for x in got["ids"]], int)
    row = np.repeat(np.arange(len(got)), lengths)
    col = np.concatenate([np.asarray(x, int) for x in got["ids"]]) if lengths.sum() else np.empty(0, int)
    count = np.concatenate([np.asarray(x, float) for x in got["counts"]]) if lengths.sum() else np.empty(0)
    hits = got["hits"].to_numpy()
    is_toxic = got["toxic"].to_numpy() == 1
    marked = np.sort(hits[is_toxic & (hits > 0)])
    cuts = [marked[len(marked) * k // (GRADES - 1)] for k in range(1, GRADES - 1)] if len(marked) else [np.inf] * (GRADES - 2)
    grade = np.where(is_toxic, 1 + sum((hits > c).astype(int) for c in cuts), 0)
    row, col = np.concatenate([row, np.arange(len(got))]), np.concatenate([col, np.full(len(got), len(names))])
    value = np.concatenate([1 + np.log(count), np.log1p(words) / 10])
    return Model(names, *fit_ordinal(row, col, value, grade, len(names) + 1))


def _score(model: Model):
    fields = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model.features)
        for batch, texts in text_chunks(batches):
            z = np.zeros(len(texts))
            for i, text in enumerate(texts):
                words, _, found = count(text)
                z[i] = model.weights[-1] * np.log1p(words) / 10 + sum(model.weights[f] * (1 + np.log(c)) for f, c in found.items())
            above = 1 / (1 + np.exp(-np.clip(z[:, None] - model.thresholds, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(above.sum(axis=1)), pa.array(above[:, 0].copy()), pa.array((above >= 0.5).sum(axis=1).astype(np.int32))], schema=fields)

    return work


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, severity (expected grade, 0 to 3), p_toxic = P(grade > 0), grade (median).

    A null text scores as an empty one; repeated rows score alike; rows without
    an id are scored too. Other columns are ignored; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, severity double, p_toxic double, grade int")
