"""Hard negatives of anchor vectors, scored exactly by Kronecker-packed products.

Components are integers. In a tile of candidate rows, component k of all rows
is biased to be non-negative and laid side by side into the fields of one wide
integer. Multiplying that integer by component k of an anchor multiplies every
field at once, and the sum over k holds all inner products of the anchor with
the tile: a field is wide enough for the largest possible sum, so nothing
carries over. Reading the fields and taking the biases back gives exact scores.

The anchors are a stated set of queries that meets all rows in blocks: tiles
are cut from the partitions of the table as they are read, without a shuffle,
and meet blocks of anchors that are broadcast a bounded number of bytes at a
time, in as many passes as the anchors need. A task gives back the first few
rows of each anchor only. The first pass finds the positives, the second, with
the positives' scores known, the negatives of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.common import new_dir, staged

#: Components (8 bytes each) of one tile, of one block of anchors, and of the blocks broadcast in one pass.
TILE, BLOCK, PASS = 1 << 17, 1 << 17, 1 << 22

#: What a kernel says of one anchor and one tile: rows of (number of the anchor, key, row of the tile).
Pick = Callable[[dict, int, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int]]]


def inner_products(anchors: np.ndarray, tile: np.ndarray) -> Iterator[np.ndarray]:
    """For each anchor its integer inner products with all rows of the tile; both are 64-bit integers."""
    n, dims = tile.shape
    if n == 0 or dims == 0 or len(anchors) == 0:
        yield from (np.zeros(n, np.int64) for _ in anchors)
        return
    a_low, a_high, c_low, c_high = (int(f(x)) for x in (anchors, tile) for f in (np.min, np.max))
    if dims * max(-a_low, a_high) * max(-c_low, c_high) >= 1 << 63:
        raise ValueError("inner products of these vectors do not fit 64 bits")
    a_low, c_low = min(a_low, 0), min(c_low, 0)
    most = dims * (a_high - a_low) * (c_high - c_low)
    width = next(w for w in (4, 8, 16) if most < 1 << (8 * w))
    fields = (tile - c_low).T
    if width == 4:
        fields = fields.astype("<u4")
    elif width == 16:
        fields = np.stack([fields, np.zeros_like(fields)], axis=2)
    wide = [int.from_bytes(np.ascontiguousarray(f).tobytes(), "little") for f in fields]
    sums = tile.sum(axis=1)
    for anchor in anchors:
        total = sum(map(mul, (anchor - a_low).tolist(), wide))
        read = np.frombuffer(total.to_bytes(n * width, "little"), "<u4" if width == 4 else "<u8")
        read = (read[::2] if width == 16 else read).astype(np.uint64).view(np.int64)
        # (a - a0)(c - c0) = ac - a0 c - c0 a + a0 c0; whatever wraps round on the way comes back.
        shift = (c_low * int(anchor.sum()) - dims * a_low * c_low + (1 << 63)) % (1 << 64) - (1 << 63)
        yield read + a_low * sums + np.int64(shift)


def first(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first k of the rows `at`: highest score, then smallest id."""
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _same_label(k: int) -> Pick:
    def pick(block, i, scores, ids, labels):
        at = np.flatnonzero((labels == block["labels"][i]) & (ids != block["ids"][i]))
        return [(0, j) for j in first(scores, ids, at, k)]

    return pick


def _below(k: int, percent: int) -> Pick:
    """Of each wanted positive score p the first k rows of another label that score from `percent` of p to p."""

    def pick(block, i, scores, ids, labels):
        wanted = block["wanted"][i]
        least = [-(-percent * p // 100) for p in wanted]
        at = np.flatnonzero((labels != block["labels"][i]) & (scores >= min(least)) & (scores <= max(wanted)))
        at = at[np.lexsort((ids[at], -scores[at]))]
        own = scores[at]
        return [(p, j) for p, low in zip(wanted, least, strict=True) for j in at[(own <= p) & (own >= low)][:k]]

    return pick


_TILE = pa.schema([("dims", pa.int32()), ("tile_ids", pa.list_(pa.int64())), ("tile_labels", pa.list_(pa.int64())), ("tile", pa.list_(pa.int64()))])
_FOUND = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = np.asarray(batch.column("dims"))
        for d in np.unique(dims):
            own = batch.filter(pa.array(dims == d))
            step = max(1, TILE // max(int(d), 1))
            for start in range(0, own.num_rows, step):
                part = own.slice(start, step)
                lists = [pa.array([c.to_numpy(zero_copy_only=False)], pa.list_(pa.int64())) for c in (part.column("vec_id"), part.column("label"), part.column("q").flatten())]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *lists], schema=_TILE)


def _scored(pick: Pick):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                row = {name: column[r] for name, column in zip(whole.schema.names, whole.columns, strict=True)}
                dims = row["dims"].as_py()
                ids, labels, tile = (np.asarray(row[c].values) for c in ("tile_ids", "tile_labels", "tile"))
                block = {c: np.asarray(row[c].values) for c in ("numbers", "ids", "labels")}
                if "wanted" in row:
                    block["wanted"] = row["wanted"].as_py()
                anchors = np.asarray(row["q"].values).reshape(len(block["ids"]), dims)
                out = []
                for i, scores in enumerate(inner_products(anchors, tile.reshape(len(ids), dims))):
                    out += [(block["numbers"][i], key, ids[j], scores[j]) for key, j in pick(block, i, scores, ids, labels)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out, strict=True)], schema=_FOUND)

    return work


def _first_in_blocks(rows: DataFrame, anchors: DataFrame, pick: Pick, k: int, name: str) -> DataFrame:
    """What `pick` finds of each anchor among all rows, the first k of each (anchor, key) with their rank."""
    spark = rows.sparkSession
    size, longest = anchors.agg(F.count("*"), F.max(F.size("q"))).first()
    n_blocks = max(1, -(-size * max(longest or 1, 1) // BLOCK))
    columns = {"numbers": "anchor", "ids": "vec_id", "labels": "label"} | ({"wanted": "wanted"} if "wanted" in anchors.columns else {})
    fields = [*columns.values(), "q"]
    blocks = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).cast("int")).groupBy("dims", "block").agg(F.collect_list(F.struct(*fields)).alias("m"))
    blocks = staged(blocks.select("dims", "block", *(F.col(f"m.{c}").alias(b) for b, c in columns.items()), F.flatten("m.q").alias("q")), f"{name}-anchors")
    tiles = rows.select("vec_id", "label", "dims", "q").mapInArrow(_tiles, "dims int, tile_ids array<long>, tile_labels array<long>, tile array<long>")
    path, at_once = new_dir(spark, name), max(1, PASS // BLOCK)
    for start in range(0, n_blocks, at_once):
        last = min(start + at_once, n_blocks) - 1
        part = F.broadcast(blocks.where(F.col("block").between(start, last)))
        met = tiles.withColumn("block", F.explode(F.sequence(F.lit(start), F.lit(last)))).join(part, ["dims", "block"])
        met.drop("block").mapInArrow(_scored(pick), "anchor long, key long, vec_id long, score long").write.mode("append").parquet(path)
    found = spark.read.schema("anchor long, key long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and embedding; anchors are the rows where
    `is_anchor` holds. Components become floor(scale * x) and scores are exact
    integer inner products; higher scores come first, ties by smaller vec_id.
    Positives of an anchor are its first rows of the same label, hard negatives
    of a positive the first rows of another label that score from `percent` of
    the positive's score to that score.

    Rows without a vec_id, label or vector and those with a null or non-finite
    component take no part. Rows that agree in vec_id, label and integer vector
    count once; a row with the anchor's vec_id is never its positive. Vectors
    meet vectors of their own length only; empty ones score 0. Scores that do
    not fit 64 bits end the run by name. Other columns are ignored; an empty
    table gives no rows.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"), is_anchor.alias("is_anchor"))
    rows = rows.groupBy("vec_id", "label", "q").agg(F.bool_or("is_anchor").alias("is_anchor"))
    rows = staged(rows.select("*", F.size("q").alias("dims"), F.monotonically_increasing_id().alias("anchor")), "mining-rows")
    anchors = rows.where("is_anchor").drop("is_anchor")

    good = _first_in_blocks(rows, anchors, _same_label(positives), positives, "positives")
    good = staged(good.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = anchors.join(good.groupBy("anchor").agg(F.collect_set("positive_score").alias("wanted")), "anchor")
    bad = _first_in_blocks(rows, wanted, _below(negatives, percent), negatives, "negatives")
    bad = bad.select("anchor", F.col("key").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = good.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    found = named.join(bad, ["anchor", "positive_score"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
