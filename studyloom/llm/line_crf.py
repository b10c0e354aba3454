"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its two
neighbours; transitions tie neighbouring labels. Forward-backward gives each
line's marginal, and the quality of a document is their mean weighted by line
length. Labels exist for documents only, so in training every line carries its
document's label. The model is fitted on a bounded sample of labelled rows: at
most TRAIN_ROWS texts, cut into slices, and about TRAIN_LINES lines of those.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import in_fold, staged, text_chunks

#: Bounds of the sample the model is fitted on: labelled texts, and lines (240 bytes each on the driver).
TRAIN_ROWS, TRAIN_LINES = 4000, 300_000
#: Lines of one slice of a text in training; scoring runs over whole texts.
SLICE = 256
#: Byte classes counted per line: letters by case, digits, spaces, and kinds of punctuation.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:", b"!?", b"|", b"#$%&*", b"<>{}[]()=/\\_", bytes(range(128, 256))]
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _k
#: Features of a line: class shares, log length, words, word length, distinct words, commonest word, repeats of the line, capitals at word starts, closing stop, bias.
OWN = len(_CLASSES) + 1 + 9


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the emission's log-odds for good
    links: np.ndarray  # 2 x 2 transition scores


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, line lengths in bytes, lines per text). A text has one line more than line ends."""
    lines, per_text, repeats = [], [], []
    for text in texts:
        own = (text or b"").split(b"\n")
        seen = Counter(own)
        lines += own
        repeats += [seen[x] for x in own]
        per_text.append(len(own))
    lengths = np.array([len(x) for x in lines], np.int64)
    buffer = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    kinds = _CLASS_OF[buffer]
    out = np.zeros((len(lines), OWN), np.float32)
    for k in range(len(_CLASSES) + 1):
        out[:, k] = np.add.reduceat((kinds == k).astype(np.int32), starts)
    out[:, len(_CLASSES)] -= 1  # the line end itself
    out[:, : len(_CLASSES) + 1] /= np.maximum(lengths, 1)[:, None]
    at = len(_CLASSES) + 1
    words = np.zeros((len(lines), 5), np.float32)
    for i, line in enumerate(lines):
        own = line.split()
        if own:
            distinct = set(own)
            n = len(own)
            words[i] = n, len(distinct) / n, (max(map(own.count, distinct)) if n < 12 else Counter(own).most_common(1)[0][1]) / n, sum(w[:1].isupper() for w in own) / n, line.rstrip()[-1:] in b".!?"
    out[:, at] = np.log1p(lengths)
    out[:, at + 1] = np.log1p(words[:, 0])
    out[:, at + 2] = np.minimum(lengths / np.maximum(words[:, 0], 1), 50)
    out[:, at + 3 : at + 7] = words[:, 1:]
    out[:, at + 7] = np.log(np.array(repeats))
    out[:, at + 8] = 1
    return out, lengths, np.array(per_text, np.int64)


def with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features side by side; zeros beyond a text's ends."""
    first = np.zeros(len(own), bool)
    starts = np.cumsum(per_text) - per_text
    first[starts] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after], axis=1)


def _padded(values: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x longest) with a mask."""
    mask = np.arange(per_text.max()) < per_text[:, None]
    out = np.zeros(mask.shape)
    out[mask] = values
    return out, mask


def forward_backward(odds: np.ndarray, mask: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded log-odds per line: marginals of good, summed pair marginals (2 x 2), log-likelihood normalisers.

    Messages are kept as probabilities per step; past a text's end they stand still.
    """
    n, length = odds.shape
    top = np.maximum(odds, 0)
    emit = np.stack([np.exp(-top), np.exp(odds - top)], axis=2)  # scaled so that the larger is 1
    step = np.exp(links)
    forward, scale = np.zeros((n, length, 2)), np.ones((n, length))
    state = emit[:, 0]
    for k in range(length):
        if k:
            state = np.where(mask[:, k, None], (forward[:, k - 1] @ step) * emit[:, k], forward[:, k - 1])
        scale[:, k] = state.sum(axis=1)
        forward[:, k] = state / scale[:, k, None]
    back = np.ones((n, length, 2))
    pairs = np.zeros((2, 2))
    for k in range(length - 1, 0, -1):
        after = emit[:, k] * back[:, k]
        live = mask[:, k, None]
        back[:, k - 1] = np.where(live, after @ step.T / scale[:, k, None], back[:, k])
        joint = forward[:, k - 1, :, None] * step * after[:, None, :] / scale[:, k, None, None]
        pairs += (joint * live[:, :, None]).sum(axis=0)
    both = forward * back
    marginal = both[:, :, 1] / both.sum(axis=2)
    normaliser = (np.log(scale) * mask + top * mask).sum(axis=1)
    return marginal, pairs, normaliser


def fit(features: np.ndarray, per_text: np.ndarray, label: np.ndarray, steps: int = 150, l2: float = 1e-3) -> Model:
    """Maximise the conditional likelihood with Adam; texts count alike whatever their length."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean, scale = np.where(scale > 0, mean, 0), np.where(scale > 0, scale, 1)
    x = (features - mean) / scale
    lines = np.repeat(np.arange(len(per_text)), per_text)
    order = np.argsort(per_text, kind="stable")
    groups = [g for g in np.array_split(order, 16) if len(g)]
    starts = np.cumsum(per_text) - per_text
    at = [np.concatenate([np.arange(starts[i], starts[i] + per_text[i]) for i in g]) for g in groups]
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    n = len(per_text)
    for step in range(1, steps + 1):
        w, links = params[:-4], params[-4:].reshape(2, 2)
        gw, gl = l2 * w, l2 * links
        for g, own in zip(groups, at, strict=True):
            odds, mask = _padded(x[own] @ w, per_text[g])
            marginal, pairs, _ = forward_backward(odds, mask, links)
            miss = marginal[mask] - label[lines[own]]
            gw = gw + x[own].T @ miss / n
            seen = np.zeros((2, 2))
            for y in (0, 1):
                seen[y, y] = (per_text[g] - 1)[label[g] == y].sum()
            gl = gl + (pairs - seen) / n
        g = np.concatenate([gw, gl.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, params[:-4], params[-4:].reshape(2, 2))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of texts of SLICE lines at most: label, id, number in the text, lines, their features with those of neighbours."""
    fields = pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("slice", pa.int64()), ("lines", pa.int64()), ("features", pa.binary())])
    for batch, texts in text_chunks(batches):
        own, _, per_text = line_features(texts)
        starts = np.cumsum(per_text) - per_text
        columns = [np.asarray(batch.column(c)) for c in ("label", "doc_id")]
        at = [(i, k) for i, n in enumerate(per_text) for k in range(0, n, SLICE)]
        x = with_neighbours(own.astype(np.float16), per_text)
        for part in (at[k : k + 2000] for k in range(0, len(at), 2000)):
            text, first = np.array(part).T
            n = np.minimum(per_text[text] - first, SLICE)
            packed = [x[starts[i] + k : starts[i] + k + m].tobytes() for (i, k), m in zip(part, n, strict=True)]
            arrays = [pa.array(columns[0][text], pa.int32()), pa.array(columns[1][text], pa.int64()), pa.array(first // SLICE, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_lines: int = TRAIN_LINES) -> Model:
    """Fit on documents labelled 0 or 1 whose crc32(doc_id as text) mod 3 is not 1, `train_rows` at most by hash order.

    Long texts are cut into slices, and if the slices have over `train_lines`
    lines, about so many of them are drawn by hash; no line is left out for its
    place in a text. Rows without a label, text or id are not used. Without any
    row left, or with one class only, the model scores every line by that
    class's share. Other columns are ignored.
    """
    rows = labels.where("quality in (0, 1) and doc_id is not null").where(~in_fold(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # TRAIN_ROWS bounds the broadcast list, TRAIN_LINES what reaches the driver.
    sample = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id").select("label", "doc_id", "text")
    slices = staged(sample.mapInArrow(_slices, "label int, doc_id long, slice long, lines long, features binary"), "crf-lines")
    total = slices.agg(F.sum("lines")).first()[0] or 0
    if total > train_lines:
        slices = slices.where(F.pmod(F.xxhash64("doc_id", "slice", "features"), F.lit(1 << 30)) < int((1 << 30) * train_lines / total))
    # Order decides nothing but the last digits of sums; with it they are the same every time.
    got = slices.select("label", "lines", "features").orderBy("doc_id", "slice", "features").toPandas()
    label, lines = got["label"].to_numpy(), got["lines"].to_numpy()
    if len(set(label)) < 2:
        width, bias = 3 * OWN, {0: 0.0, 1: float(np.mean(label) * 8 - 4) if len(label) else 0.0}[min(len(label), 1)]
        return Model(np.zeros(width), np.ones(width), np.eye(width)[OWN - 1] * bias, np.zeros((2, 2)))
    x = np.frombuffer(b"".join(got["features"]), np.float16).reshape(-1, 3 * OWN)
    return fit(x.astype(np.float64), lines, label)


def score_texts(texts: list[bytes | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document scores, line marginals, lines per text)."""
    own, lengths, per_text = line_features(texts)
    odds = ((with_neighbours(own.astype(np.float16).astype(np.float64), per_text) - model.mean) / model.scale) @ model.weights
    marginals = np.zeros(len(odds))
    starts = np.cumsum(per_text) - per_text
    order = np.argsort(per_text, kind="stable")
    # Texts of like length share a pass, so padding stays small.
    group = np.floor(np.log2(per_text[order]) * 2).astype(int)
    for part in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        at = np.concatenate([np.arange(starts[i], starts[i] + per_text[i]) for i in part])
        padded, mask = _padded(odds[at], per_text[part])
        marginals[at] = forward_backward(padded, mask, model.links)[0][mask]
    weight = np.maximum(lengths, 1).astype(float)
    owner = np.repeat(np.arange(len(texts)), per_text)
    scores = np.bincount(owner, weight * marginals, len(texts)) / np.bincount(owner, weight, len(texts))
    return np.clip(scores, 0, 1), marginals, per_text


def _score(model: Model):
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("lines", pa.list_(pa.float32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            scores, marginals, per_text = score_texts(texts, model)
            offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
            lines = pa.ListArray.from_arrays(pa.array(offsets), pa.array(marginals.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores), lines], schema=fields)

    return work


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), lines (each line's probability of being good).

    A null text scores as an empty one, which is one empty line; repeated rows
    score alike; rows without an id are scored too. Other columns are ignored;
    an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double, lines array<float>")
