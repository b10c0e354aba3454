"""Ranked lexical search: term at a time, rarest first, with a limit on accumulators.

Documents are read once and become postings of the terms the items ask for.
A task then works through batches of documents. For an item it takes the terms
from the rarest on; a posting adds to its document's accumulator or creates
one. Before each term it knows how much the terms left can still add at most.
Once that is less than the k-th best partial score so far, a document without
an accumulator cannot come in any more: no accumulators are created from then
on, and the remaining terms only bring the existing ones to their exact scores.
The k-th best of earlier batches of the task counts as well. Each task gives
back its k best documents of each item, and a window merges those.

Weights come from counts over all documents. Items are worked on in blocks of
a bounded number of terms, whose vocabulary is what goes to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.common import ascii_lower, staged, text_chunks

#: A term: characters that are no ASCII control, space or punctuation.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms (with repeats over items) and items of one block; an item of more terms is a block of its own.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 4_000
#: Score constants: weights are in thousandths, a term's part saturates with its count.
FREE, LENGTH_PERCENT = 1_000_000_000, 50

#: Bytes of a text to bytes whose white space parts the terms: upper case to lower, everything outside terms to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_INT_MAX = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _postings(vocabulary: dict[bytes, int]):
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            n, terms, counts, ends = [], [], [], [0]
            for text in texts:
                words = terms_of(text or b"")
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms.extend(found.keys())
                counts.extend(found.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.int32())) for c in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), *lists], schema=fields)

    return work


class Best:
    """The best k (score, document) of one item so far; equal scores by smaller id, documents without an id last."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.empty((3, 0), np.int64)  # score, no id, id

    def least(self) -> int:
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else 0

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows, rows], axis=1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]


def accumulate(terms: np.ndarray, spans: np.ndarray, docs: np.ndarray, parts: np.ndarray, most: np.ndarray, n_docs: int, k: int, least: int) -> np.ndarray:
    """Scores of one item in a batch of documents; those of documents that cannot be among the k best may stay 0.

    `terms` come rarest first. Term t has the postings spans[t] : spans[t + 1]
    of `docs` and `parts` (what it adds there), `most` is its largest part.
    `least` is a score that k documents seen before reach.
    """
    score = np.zeros(n_docs, np.int64)
    left = np.append(np.cumsum(most[terms][::-1])[::-1], 0)
    creating = True
    for i, t in enumerate(terms):
        if creating and left[i] < max(least, score.max(initial=0)):
            made = score[score > 0]
            kth = np.partition(made, len(made) - k)[len(made) - k] if len(made) >= k else 0
            creating = left[i] >= max(least, kth)
        own, add = docs[spans[t] : spans[t + 1]], parts[spans[t] : spans[t + 1]]
        if not creating:
            live = score[own] > 0
            own, add = own[live], add[live]
        score[own] += add
    return score


def _search(items: list[np.ndarray], weights: np.ndarray, n_all: int, length_all: int, k: int):
    fields = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            no_id = np.asarray(ids.is_null()).astype(np.int64)
            ids = np.asarray(ids.fill_null(_INT_MAX))
            n = np.asarray(batch.column("n"))
            m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_all) // length_all
            held = batch.column("terms")
            docs = np.repeat(np.arange(batch.num_rows), np.asarray(held.value_lengths()))
            terms, tf = np.asarray(held.flatten()), np.asarray(batch.column("counts").flatten()).astype(np.int64)
            order = np.argsort(terms, kind="stable")
            terms, docs, tf = terms[order], docs[order], tf[order]
            parts = weights[terms] * ((FREE * tf) // (1000 * tf + 20 * m[docs]))
            spans = np.searchsorted(terms, np.arange(len(weights) + 1))
            most = np.zeros(len(weights), np.int64)
            np.maximum.at(most, terms, parts)
            for b, own in zip(best, items, strict=True):
                score = accumulate(own, spans, docs, parts, most, batch.num_rows, k, b.least())
                at = np.flatnonzero(score >= max(b.least(), 1))
                if len(at) > k:
                    at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
                if len(at):
                    b.add(np.stack([score[at], no_id[at], ids[at]]))
        for item, b in enumerate(best):
            if b.rows.shape[1]:
                score, no_id, own = b.rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item, np.int32)), pa.array(own, mask=no_id == 1), pa.array(score)], schema=fields)

    return work


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """The k best documents of the items of one block, given as rows of item_id and terms."""
    spark = docs.sparkSession
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for r in items for t in r.terms}))}
    postings = staged(docs.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, counts array<int>").where("n > 0"), "postings")
    n_all, length_all = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A row per term of the block's vocabulary at most.
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rarest = [np.array(sorted((vocabulary[t.encode()] for t in r.terms), key=lambda t: (df[t], t)), np.int64) for r in items]
    found = postings.where(F.size("terms") > 0).mapInArrow(_search(rarest, weights, n_all, length_all, k), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k documents of highest score above 0 for each item: item_id, rank (from 1), doc_id, score.

    Both tables have a text; null texts have no terms. Documents with the same
    score come by ascending doc_id, those without a doc_id last; they count and
    are ranked like any other, and so does each row that repeats one. Items
    without an item_id are left out; equal items count once, and items that
    share an item_id with other terms are ranked apart under it. Very long
    texts are read whole. Other columns are ignored; an empty table on either
    side gives no rows.
    """
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))))
    asked = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), terms.alias("terms")).where("size(terms) > 0").distinct()
    asked = staged(asked, "items")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_blocks = max(1, -(-size // BLOCK_TERMS), -(-n // BLOCK_ITEMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(n_blocks)))
    texts = docs.select("doc_id", "text")
    blocks = [_block(texts, asked.where(F.col("block") == b).collect(), k) for b in range(n_blocks)]
    return reduce(DataFrame.union, blocks)
