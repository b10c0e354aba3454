"""Repeated passages by relative Lempel-Ziv parsing against every block of the corpus, exact.

All documents are the reference. They are cut into blocks that depend on
content alone: every window of `window` words belongs to the rarest-looking
seed in it (the smallest seed hash, a minimizer), and a block is a run of
consecutive windows of one seed. Equal windows have equal seeds, so a passage
that occurs twice is cut the same way both times, wherever it lies, and one
window in ten names a block where a window index would need every word.

The reference index counts blocks by (seed, block). A document is then factored
greedily against it: a block that occurs elsewhere is taken whole, and factors
grow over adjacent blocks for as long as they continue at the same place of the
reference. Where a factor ends, a block has only part of its windows in common
with other blocks of its seed; these boundary blocks, few in number, are
compared window by window. So factors cover exactly the windows that occur
elsewhere, within the same document or in any other.

No text or block list is gathered by key: counts are reduced before the
shuffle, and a seed that a third of all documents share is a sum, and later a
join that Spark can split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import mix, signed, staged, text_chunks, word_hashes

#: Words of a seed. A window of 35 words has 28 of them, and so has a block 28 windows at most.
SEED = 8
#: Of a block's tag: low bits for its number of windows, then for its first word; above them 32 bits of the text's hash.
N_BITS, AT_BITS = 5, 27
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)
_WORD = re.compile(rb"[^ \t-\r]+")


class Runs:
    """Hash of any run of words in O(1): differences of prefix sums of h[i] * factor**i, shifted back to 0."""

    def __init__(self, h: np.ndarray):
        powers = np.full(len(h) + 1, _FACTOR, np.uint64)
        back = np.full(len(h) + 1, _INVERSE, np.uint64)
        powers[0] = back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * np.multiply.accumulate(powers)[:-1])])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start])


def blocks_of(h: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Blocks of texts laid end to end (word hashes, words per text): seed hash, block hash, first window (in h), windows."""
    if len(h) < window:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    runs, seed = Runs(h), min(SEED, window)
    seeds = runs.of(np.arange(len(h) - seed + 1), seed)
    width = window - seed + 1
    # First place of the smallest seed hash in each window, by doubling.
    best, size = np.arange(len(seeds)), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(seeds[right] < seeds[left], right, left)
        size += step
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[: len(best)] == text[window - 1 :]
    starts = inside & np.concatenate([[True], (best[1:] != best[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(starts)
    n = np.add.reduceat(inside.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    place = best[first]
    block = mix(runs.of(first, window + n - 1) + ((place - first) << N_BITS | n).astype(np.uint64))
    return seeds[place], block, first, n


def _seed_counts(window: int):
    """Seeds of the blocks, counted per chunk of texts."""
    fields = pa.schema([("seed", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            words = [(t or b"").split() for t in texts]
            seeds = blocks_of(word_hashes([w for t in words for w in t]), np.array([len(w) for w in words], np.int64), window)[0]
            seeds, n = np.unique(seeds, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(seeds)), pa.array(n.astype(np.int64))], schema=fields)

    return work


def _occurrences(window: int):
    fields = pa.schema([("seed", pa.int64()), ("block", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("tag", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            words = [(t or b"").split() for t in texts]
            counts = np.array([len(w) for w in words], np.int64)
            if counts.max() >= 1 << AT_BITS:
                raise ValueError("a text has too many words")
            seeds, block, first, n = blocks_of(word_hashes([w for t in words for w in t]), counts, window)
            text = np.repeat(np.arange(len(counts)), counts)[first] if len(first) else np.empty(0, np.int64)
            at = first - (np.cumsum(counts) - counts)[text]
            tag = np.asarray(batch.column("hash"))[text] << np.int64(AT_BITS + N_BITS) | at << N_BITS | n
            yield pa.RecordBatch.from_arrays([pa.array(signed(seeds)), pa.array(signed(block)), *(pa.array(np.asarray(batch.column(c))[text]) for c in ("id", "key")), pa.array(tag)], schema=fields)

    return work


def _windows(window: int):
    """Hash of every window of the listed blocks of a text, with the window's distance from its seed."""
    fields = pa.schema([("seed", pa.int64()), ("block", pa.int64()), ("bit", pa.int32()), ("far", pa.int32()), ("w", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            wanted = batch.column("blocks").to_pylist()
            for text, blocks in zip(texts, wanted, strict=True):
                h = word_hashes(text.split())
                runs, seed = Runs(h), min(SEED, window)
                n = np.array([b["tag"] & (1 << N_BITS) - 1 for b in blocks], np.int64)
                first = np.array([b["tag"] >> N_BITS & (1 << AT_BITS) - 1 for b in blocks], np.int64)
                # Window by window: which block, and where in it.
                owner = np.repeat(np.arange(len(blocks)), n)
                bit = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                at = first[owner] + bit
                places = at[:, None] + np.arange(window - seed + 1)
                far = np.argmin(runs.of(places.ravel(), seed).reshape(places.shape), axis=1)
                seeds, names = (np.array([b[k] for b in blocks], np.int64)[owner] for k in ("seed", "block"))
                yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(names), pa.array(bit.astype(np.int32)), pa.array(far.astype(np.int32)), pa.array(signed(runs.of(at, window)))], schema=fields)

    return work


#: What names a text: its id and two hashes of it, 64 and 32 bits, which tell rows of one id, or without any, apart.
NAME = ["id", "key", "hash"]


def _short_hash(text: Column) -> Column:
    return F.xxhash64(text, F.lit("short")).bitwiseAND(0xFFFFFFFF)


def _named(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    return rows.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "key": F.xxhash64(text), "hash": _short_hash(text)})


def _texts(docs: DataFrame) -> DataFrame:
    return _named(docs.select("doc_id", "text")).select("id", "text", "key", "hash")


def _hash_of(tag: Column) -> Column:
    return F.shiftrightunsigned(tag, AT_BITS + N_BITS)


def matched_blocks(docs: DataFrame, window: int) -> DataFrame:
    """Per text (id, key, hash) the blocks with windows that occur elsewhere: at, mask of windows, and for whole blocks another place (ref_id, ref_at)."""
    texts = _texts(docs)
    seeds = texts.mapInArrow(_seed_counts(window), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")
    seeds = staged(seeds, "seeds")  # a table of its own, so that the join is one Spark can split
    found = texts.mapInArrow(_occurrences(window), "seed long, block long, id long, key long, tag long")
    found = staged(found.join(seeds, "seed", "left_semi"), "blocks")
    place = F.struct("id", "key", "tag")
    index = found.groupBy("seed", "block").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("last"))
    index = staged(index, "index")
    # Seeds with several blocks: their windows are compared one by one.
    several = index.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").select("seed")
    reps = index.join(several, "seed", "left_semi").select("seed", "block", F.col("one.id").alias("id"), F.col("one.key").alias("key"), F.col("one.tag").alias("tag"))
    reps = reps.groupBy("id", "key", _hash_of(F.col("tag")).alias("hash")).agg(F.collect_list(F.struct("seed", "block", "tag")).alias("blocks"))
    windows = texts.join(reps, NAME).mapInArrow(_windows(window), "seed long, block long, bit int, far int, w long").distinct()
    windows = staged(windows, "windows")
    shared = windows.groupBy("seed", "far", "w").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    partial = windows.join(shared, ["seed", "far", "w"]).groupBy("seed", "block").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("part"))
    full = (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("one.tag").bitwiseAND((1 << N_BITS) - 1).cast("int"))) - 1
    masks = index.join(partial, ["seed", "block"], "left").withColumn("mask", F.when(F.col("n") > 1, full).otherwise(F.col("part")))
    masks = masks.where("mask is not null").select("seed", "block", "mask", F.when(F.col("n") > 1, F.col("one")).alias("one"), F.when(F.col("n") > 1, F.col("last")).alias("last"))
    pieces = found.join(staged(masks, "masks"), ["seed", "block"])
    ref = F.when(F.col("one") == place, F.col("last")).otherwise(F.col("one"))
    at = lambda tag: F.shiftright(tag, N_BITS).bitwiseAND((1 << AT_BITS) - 1)
    piece = F.struct(at(F.col("tag")).alias("at"), "mask", ref["id"].alias("ref_id"), at(ref["tag"]).alias("ref_at"))
    # Repeated rows have the same pieces, which are kept once.
    return pieces.groupBy("id", "key", _hash_of(F.col("tag")).alias("hash")).agg(F.collect_set(piece).alias("pieces"))


def factors_of(pieces: list[dict], window: int) -> list[tuple[int, int, int | None, int | None]]:
    """Greedy factors (first word, words, ref_id, ref_at) of one text from its matched blocks.

    A factor starts at the first uncovered matched window and grows while the
    next window is matched and, where it lies in a block found whole elsewhere,
    continues at the factor's place in the reference.
    """
    out: list[list] = []
    for p in sorted(pieces, key=lambda p: p["at"]):
        at, mask = p["at"], p["mask"]
        while mask:
            skip = (mask & -mask).bit_length() - 1
            mask >>= skip
            n = (~mask & mask + 1).bit_length() - 1
            start = at + skip
            ref = None if p["ref_id"] is None else (p["ref_id"], p["ref_at"] + start - p["at"])
            last = out[-1] if out else None
            if last and last[0] + last[1] == start and (ref is None or last[2] is None or ref == (last[2][0], last[2][1] + last[1])):
                if last[2] is None and ref is not None:
                    last[2] = (ref[0], ref[1] - last[1])
                last[1] += n
            elif not (last and last[0] == start and last[1] >= n):
                out.append([start, n, ref])
            mask >>= n
            at = start + n
    return [(start, n + window - 1, *(ref or (None, None))) for start, n, ref in out]


_CUT_TYPES = "n_words long, n_removed long, kept_text string, factors array<struct<start:long,length:long,ref_id:long,ref_start:long>>"
_CUT = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_id", pa.int64()), ("ref_start", pa.int64())]))]


def _cut(window: int):
    def cut(text, pieces):
        if not pieces:
            return len(text.split()) if text else 0, 0, text, []
        factors = factors_of(pieces, window)
        spans = [m.span() for m in _WORD.finditer(text)]
        gone = np.zeros(len(spans) + 1, np.int64)
        np.add.at(gone, [f[0] for f in factors], 1)
        np.add.at(gone, [f[0] + f[1] for f in factors], -1)
        gone = np.cumsum(gone[:-1]) > 0
        # A removed run goes with the white space after it.
        kept, start = [], 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
        for a, b in edges.tolist():
            kept.append(text[start : spans[a][0]])
            start = spans[b][0] if b < len(spans) else len(text)
        kept.append(text[start:])
        return len(spans), int(gone.sum()), b"".join(kept), factors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            done = [cut(t, p) for t, p in zip(texts, batch.column("pieces").to_pylist(), strict=True)]
            names = ("start", "length", "ref_id", "ref_start")
            rest = [d[0] for d in done], [d[1] for d in done], [None if d[2] is None else d[2].decode() for d in done], [[dict(zip(names, f, strict=True)) for f in d[3]] for d in done]
            own = [batch.column(c) for c in ("doc_id", "text", "kept_columns")]
            arrays = own + [pa.array(r, t) for r, t in zip(rest, _CUT, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "kept_columns", "n_words", "n_removed", "kept_text", "factors"])

    return work


def cut_repeats(docs: DataFrame, window: int = 35, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept_text, factors (start, length, ref_id, ref_start) of every document.

    A word goes if a window of `window` words covers it whose words also start
    anywhere else, in the same text or another row. Words are separated by ASCII
    white space and compared as they are. `kept_text` is the text without them,
    other white space untouched. `factors` cover the removed words in order and
    may overlap; ref_id and ref_start tell another place of the factor, null where
    only its windows, not a block, were found. A null text has no words and stays
    null; texts shorter than a window lose nothing; repeated rows repeat each
    other; rows without an id take part. Of other columns those named in `keep` are
    passed on; an empty table gives no rows.
    """
    if not 2 <= window <= SEED + (1 << N_BITS) - 2:
        raise ValueError("the window must have 2 to 38 words")
    pieces = matched_blocks(docs, window)
    carried = F.struct(*keep) if keep else F.lit(None).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", carried.alias("kept_columns"))
    joined = _named(rows).join(pieces, NAME, "left").select("doc_id", "text", "kept_columns", "pieces")
    types = f"doc_id long, text string, kept_columns {rows.schema['kept_columns'].dataType.simpleString()}, {_CUT_TYPES}"
    out = joined.mapInArrow(_cut(window), types)
    return out.select("doc_id", "text", *(F.col("kept_columns")[c].alias(c) for c in keep), "n_words", "n_removed", "kept_text", "factors")
