"""Language-model scores from a probabilistic suffix tree.

A text is its words, A-Z lowered, each followed by a space, and one end symbol;
the tree's symbols are the bytes of that. Contexts are up to DEPTH symbols. A
context is a candidate from a number of occurrences on that grows with the
square root of the training text, so its share falls and ever more contexts
qualify as the corpus grows. It is kept if its next-symbol distribution
diverges from that of its parent (the context without its first symbol): twice
the log-likelihood ratio must reach DIVERGENCE for each next symbol but one.
Kept contexts bring their suffixes along. A kept context's distribution is
smoothed towards its parent's, the more the more different symbols follow it,
the root's towards all byte values alike. Each symbol of a text is scored by
the longest kept suffix of what stands before it.

Counts cover every training text and are made by the executors. The tree falls
apart by the symbol right before the scored one: nothing else of it is needed
there. It is fitted in parts of such symbols, of PART_ROWS candidate rows at
most, and broadcast in parts of PASS_ROWS kept rows at most, unless one symbol
alone has more; each broadcast part scores the places that are its own in a
pass over the texts. So neither the driver nor a task holds a tree that grows
without bound; common corpora need one pass. A task scores each different run
of DEPTH + 1 symbols of a chunk of text once, from the longest suffix on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import in_fold, signed, staged, text_chunks, word_hashes

DEPTH = 6
#: Occurrences a context needs: this share of the square root of all training symbols, LEAST at least.
GROWTH, LEAST = 1 / 700, 2
#: Twice the log-likelihood ratio against the parent that a kept context needs per degree of freedom.
DIVERGENCE = 2.0
#: Weight of the parent's distribution, in observations per different next symbol.
PRIOR = 6.0
#: Rows (context, next symbol) of candidates that are fitted at a time, 32 bytes each.
PART_ROWS = 4_000_000
#: Kept rows that one pass over the texts scores with, 16 bytes each.
PASS_ROWS = 6_000_000
#: Tokens of at least this share of the training tokens are looked up in a broadcast table: 5 million at most.
FREQUENT = 2e-7
END = b"\n"
END_HASH = xxhash.xxh3_64_intdigest(END)
_MERGE = 1_000_000


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def symbols_of(tokens: list[bytes]) -> bytes:
    return b" ".join(tokens) if len(tokens) > 1 else END


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of the texts with the `depth` before it, and the text it is in; end symbols stand before a text.

    A gram holds the nearest symbol before it highest, the farthest next to
    last, the symbol itself lowest: grams in order are in order by any suffix.
    """
    joined = np.frombuffer(b"".join(END * depth + t for t in texts), np.uint8)
    n = max(len(joined) - depth, 0)
    gram = np.zeros(n, np.uint64)
    for i in range(depth - 1, -1, -1):
        gram = gram << np.uint64(8) | joined[i : i + n]
    gram = gram << np.uint64(8) | joined[depth : depth + n]
    lengths = np.array([len(t) + depth for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    within = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # Grams that begin before a text's own end symbols are none of its.
    own = within[depth:] >= depth
    return gram[own].view(np.int64), owner[depth:][own]


class _Tally:
    """Counts of 64-bit keys, kept merged."""

    def __init__(self):
        self.keys, self.counts, self.parts, self.held = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > _MERGE:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        counts = np.concatenate([self.counts, *(c for _, c in self.parts)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.parts, self.held = [], 0


def _count(depth: int):
    """Token hashes (kind 0) and depth + 1 symbols long grams (kind 1), counted per task."""
    fields = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = _Tally(), _Tally()
        for _, texts in text_chunks(batches):
            tokens = [tokens_of(t) for t in texts]
            tallies[0].add(word_hashes([w for t in tokens for w in t]))
            tallies[1].add(grams_of([symbols_of(t) for t in tokens], depth)[0].view(np.uint64))
        for kind, tally in enumerate(tallies):
            tally.merge()
            for at in range(0, len(tally.keys), 100_000):
                keys, counts = tally.keys[at : at + 100_000], tally.counts[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(signed(keys)), pa.array(counts)], schema=fields)

    return work


@dataclass(frozen=True)
class Tree:
    """The part of the tree for places after one of `before` (a flag per byte value)."""

    before: np.ndarray
    root: np.ndarray  # probability of each byte value after the empty context
    # By length: contexts, what is left to the parent, (context, next symbol) packed, and its probability.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def arrays(self) -> tuple:
        """The tree as plain arrays, which workers can read without this package."""
        return self.before, self.root, self.levels

    def contexts(self) -> int:
        return 1 + sum(len(names) for names, *_ in self.levels)

    def rows(self) -> int:
        return sum(len(keys) for _, _, keys, _ in self.levels)

    def joined(self, after: Tree) -> Tree:
        """This part and another whose symbols all come after its own."""
        levels = [tuple(map(np.concatenate, zip(a, b, strict=True))) for a, b in zip(self.levels, after.levels, strict=True)]
        return Tree(self.before | after.before, self.root, levels)


def build_tree(tables: Iterator[tuple[np.ndarray, np.ndarray]], divergence: float = DIVERGENCE, prior: float = PRIOR, before: np.ndarray | None = None) -> Tree:
    """From (key, count) of candidate contexts of length 0, 1, and so on; a key packs context and next symbol as grams do."""
    key, count = next(tables)
    total = count.sum()
    root = np.full(256, 0.5 / (total + 128))
    root[key] = (count + 0.5) / (total + 128)
    above, above_keys, kept, found = root, None, [], []
    for keys, n in tables:
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float64)
        names, owner = np.unique(keys >> 8, return_inverse=True)
        whole, kinds = np.bincount(owner, n, len(names)), np.bincount(owner, minlength=len(names))
        parent = above[keys & 255] if above_keys is None else above[np.searchsorted(above_keys, keys >> 16 << 8 | keys & 255)]
        ratio = 2 * np.bincount(owner, n * np.log(n / whole[owner] / parent), len(names))
        weight = prior * kinds
        part = n / (whole + weight)[owner]
        above, above_keys = part + (weight / np.maximum(whole + weight, 1))[owner] * parent, keys
        kept.append(ratio >= divergence * np.maximum(kinds - 1, 1))
        found.append((names, weight / np.maximum(whole + weight, 1), keys, above, owner.astype(np.int32)))
    for k in range(len(found) - 1, 0, -1):
        kept[k - 1][np.searchsorted(found[k - 1][0], np.unique(found[k][0][kept[k]] >> 8))] = True
    levels = []
    for k, (names, left, keys, prob, owner) in zip(kept, found, strict=True):
        rows = k[owner]
        levels.append((names[k], left[k], keys[rows], prob[rows]))
    return Tree(np.ones(256, bool) if before is None else before, root, levels)


def _log10_of(grams: np.ndarray, root: np.ndarray, levels: list) -> np.ndarray:
    """log10 probability of each gram's last symbol after the longest kept suffix of those before it; fastest on grams in order."""
    prob, live = np.ones(len(grams)), np.arange(len(grams))
    for k in range(len(levels), 0, -1):
        names, left, keys, probs = levels[k - 1]
        if not (len(names) and len(live)):
            continue
        context = grams[live] >> 8 * (len(levels) - k + 1)
        # Grams in order have equal contexts side by side: each is looked up once.
        new = np.concatenate([[True], context[1:] != context[:-1]])
        heads = context[new]
        at = np.minimum(np.searchsorted(names, heads), len(names) - 1)
        lengths = np.diff(np.flatnonzero(np.concatenate([new, [True]])))
        own = np.flatnonzero(np.repeat(names[at] == heads, lengths))
        gram = context[own] << 8 | grams[live[own]] & 255
        row = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        seen = keys[row] == gram
        prob[live[own[seen]]] *= probs[row[seen]]
        # A symbol not seen after a context gets what that leaves to its parent, which is kept too.
        prob[live[own[~seen]]] *= np.repeat(left[at], lengths)[own[~seen]]
        live = np.delete(live, own[seen])
    prob[live] *= root[grams[live] & 255]
    return np.log10(prob)


def score_symbols(texts: list[bytes], before: np.ndarray, root: np.ndarray, levels: list) -> np.ndarray:
    """log10 probability of each symbol string, places before which none of `before` stands left out."""
    grams, owner = grams_of(texts, len(levels))
    if not before.all():
        own = before[grams >> 8 * len(levels)]
        grams, owner = grams[own], owner[own]
    order = np.argsort(grams)
    grams = grams[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)]
    logs = _log10_of(grams[new], root, levels)
    return np.bincount(owner[order], logs[np.cumsum(new) - 1], len(texts))


def _add(tree):
    """Texts with their score so far, to which a further part of the tree adds its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            more = score_symbols([symbols_of(tokens_of(t)) for t in texts], *tree.value)
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(np.asarray(batch.column("score")) + more))

    return work


def _score(tree, frequent):
    """Per text: tokens, model score, what frequent tokens add to the base score, and the other tokens with counts."""
    pair = pa.struct([("token", pa.int64()), ("n", pa.int64())])
    fields = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("known", pa.int64()), ("base", pa.float64()), ("rare", pa.list_(pair))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value
        logs = np.log10(counts + 0.5)
        for batch, texts in text_chunks(batches):
            tokens = [tokens_of(t) for t in texts]
            lengths = np.array([len(t) for t in tokens])
            scores = np.asarray(batch.column("score")) + score_symbols([symbols_of(t) for t in tokens], *tree.value)
            hashes = word_hashes([w for t in tokens for w in t])
            owner = np.repeat(np.arange(len(texts)), lengths)
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
            known = np.bincount(owner[hit], minlength=len(texts))
            base = np.bincount(owner[hit], logs[at[hit]], len(texts))
            # The others: distinct per text, with their number.
            own, rest = owner[~hit], hashes[~hit]
            order = np.lexsort((rest, own))
            own, rest = own[order], rest[order]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (rest[1:] != rest[:-1])])) if len(own) else np.empty(0, np.int64)
            times = np.diff(np.concatenate([new, [len(own)]]))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(texts)))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(signed(rest[new])), pa.array(times)], ["token", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(lengths), pa.array(scores), pa.array(known), pa.array(base), rare.cast(fields.types[6])], schema=fields)

    return work


def counts_of(train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): token hashes (0) and grams (1) of all training texts."""
    counts = train.select("text").mapInArrow(_count(depth), "kind int, key long, n long")
    return staged(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def candidate_rows(counts: DataFrame, depth: int = DEPTH, growth: float = GROWTH, least: int = LEAST) -> DataFrame:
    """(level, nearest, key, n) of the contexts of counts_of()'s grams that occur often enough; nearest is a context's last symbol."""
    level = counts.where("kind = 1").select("key", "n")
    total = level.agg(F.sum("n")).first()[0] or 0
    tables = [level]
    # Each level comes from the one below, which is far shorter than all grams.
    shorter = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(255)).alias("key")
    for _ in range(depth):
        tables.append(staged(tables[-1].groupBy(shorter).agg(F.sum("n").alias("n")), "level"))
    nearest = lambda k: F.shiftright("key", 8 * k).cast("int") if k else F.lit(0)
    levels = reduce(DataFrame.union, [t.select(F.lit(k).alias("level"), nearest(k).alias("nearest"), "key", "n") for k, t in zip(range(depth, -1, -1), tables, strict=True)])
    levels = levels.withColumn("context", F.shiftright("key", 8))
    often = levels.groupBy("level", "context").agg(F.sum("n").alias("whole")).where(F.col("whole") >= max(least, math.ceil(growth * math.sqrt(total))))
    return staged(levels.join(often, ["level", "context"], "left_semi").select("level", "nearest", "key", "n"), "candidates")


def fit_trees(counts: DataFrame, depth: int = DEPTH, growth: float = GROWTH, least: int = LEAST, divergence: float = DIVERGENCE, part_rows: int = PART_ROWS, pass_rows: int = PASS_ROWS) -> Iterator[Tree]:
    """The parts of the tree that a pass scores with, one by one; the candidates of one level of one fitted part come to the driver at a time."""
    rows = candidate_rows(counts, depth, growth, least)
    sizes = dict(rows.where("level > 0").groupBy("nearest").agg(F.count("*").alias("n")).collect())
    parts, held = [[]], 0
    for b in range(256):
        if parts[-1] and held + sizes.get(b, 0) > part_rows:
            parts.append([])
            held = 0
        parts[-1].append(b)
        held += sizes.get(b, 0)

    def table(level, own):
        got = rows.where((F.col("level") == level) & (F.lit(level == 0) | F.col("nearest").isin(own))).select("key", "n").toArrow()
        return tuple(got.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))

    held = None
    for own in parts:
        tree = build_tree((table(k, own) for k in range(depth + 1)), divergence, before=np.isin(np.arange(256), own))
        if held is None or held.rows() + tree.rows() <= pass_rows:
            held = tree if held is None else held.joined(tree)
        else:
            yield held
            held = tree
    yield held


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the texts of `train`. `score` is the tree's log10 probability of
    the whole text, `base_score` that of independent tokens with counts + 0.5.
    A null text is empty: one end token. Repeated rows score alike; rows without
    an id are scored too; without training texts all byte values and tokens are
    equally likely. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = counts_of(train)
    tokens = counts.where("kind = 0").select(F.col("key").alias("token"), F.col("n").alias("c"))
    total, distinct = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = tokens.where(F.col("c") >= FREQUENT * total).toArrow()
    keys, number = often.column("token").to_numpy().astype(np.int64).view(np.uint64), often.column("c").to_numpy().astype(np.float64)
    order = np.argsort(keys)
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.lit(0.0).alias("score"))
    trees = fit_trees(counts)
    first = next(trees)
    for tree in trees:
        rows = staged(rows.mapInArrow(_add(share(tree.arrays())), rows.schema), "part-scores")
    scored = rows.mapInArrow(
        _score(share(first.arrays()), share((keys[order], number[order]))),
        "doc_id long, hash long, n_tokens long, score double, known long, base double, rare array<struct<token:long,n:long>>",
    )
    scored = staged(scored, "scored")
    # The rarer tokens by a join; repeated rows of a document once.
    rare = scored.where("size(rare) > 0").select("doc_id", "hash", "rare").dropDuplicates(["doc_id", "hash"])
    rare = rare.select("doc_id", "hash", F.explode("rare").alias("r")).select("doc_id", "hash", "r.token", "r.n")
    rare = rare.join(tokens.where(F.col("c") < FREQUENT * total), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("doc_id", "hash").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    rare = rare.withColumnRenamed("doc_id", "id").withColumnRenamed("hash", "h")
    out = scored.join(rare, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def training_texts(docs: DataFrame) -> DataFrame:
    """Documents whose crc32(doc_id as text) mod 5 is not 1."""
    return docs.where(~in_fold(F.col("doc_id"), 5, 1))
