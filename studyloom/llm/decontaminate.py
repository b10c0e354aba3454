"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only.

A test item is a set of word shingles; it is contained in a document when at
least `percent` of them occur there. The share of an item's MinHash values
found among a document's shingles estimates that containment whatever the
document's length, so no window size or document sketch is needed and an item
of thirty words is found in a document of a hundred thousand.

Items are partitioned by set size, and a partition's sketch is as long as its
largest sets need. Shingles enter it by how common they are in the documents,
in classes that double, and by smallest hash within a class, so that a phrase
of many items and documents is in a sketch only where nothing rarer is. An
item may miss at most floor((100 - percent) * n / 100) shingles, so a document
that lacks more of the sketch cannot contain it, and the search loses nothing.
Every item found is then verified by exact containment of its words' shingles,
not hashes: the shingles of the pairs meet those of the documents one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import SPACES, staged

#: Upper set sizes of the partitions; larger items share partitions that double on.
SIZE_STEPS = (8, 16, 32, 64, 128, 256)
#: Tables of the items' hashes are broadcast up to this many rows (16 to 32 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES, -1), lambda w: w != "")


def _starts(words: Column, width: int) -> Column:
    """0-based starts of shingles: none without words, one if there are too few."""
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))))


def shingles(words: Column, width: int) -> Column:
    """Distinct shingles as text, words joined by one space."""
    return F.array_distinct(F.transform(_starts(words, width), lambda i: F.array_join(F.slice(words, i + 1, F.lit(width)), " ")))


def shingle_hashes(words: Column, width: int) -> Column:
    """A hash per shingle; a missing last word (short texts) leaves the hash as it is."""
    return F.transform(_starts(words, width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))


def _sized(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _sketch_size(n: Column, percent: int) -> Column:
    """Sketch length of the partition an item of `n` shingles falls into."""
    upper = F.greatest(n, F.lit(SIZE_STEPS[0]))
    doubled = F.pow(F.lit(2), F.ceil(F.log2(upper.cast("double")))).cast("long")
    return F.floor(doubled * (100 - percent) / 100).cast("int") + 1


def _sketches(items: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(h, item, need): hashes of the items' sketches, and how many of its own a document must hold to contain the item."""
    hashes = staged(items.select("item", F.explode("hashes").alias("h")), "item-hashes")
    asked = staged(hashes.select("h").distinct(), "asked")
    said = texts.select(_words(F.col("text")).alias("words")).select(F.explode(shingle_hashes(F.col("words"), width)).alias("h"))
    # Counts reach the shuffle added up: one row per task and hash of an item.
    common = said.join(_sized(asked), "h").groupBy("h").agg(F.count("*").alias("n"))
    ranked = hashes.join(common, "h", "left").withColumn("class", F.floor(F.log2(F.coalesce("n", F.lit(0)) + 1.0)))
    ranked = ranked.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("class", "h"))).alias("ranked"))
    n = F.size("ranked")
    length = F.least(n, _sketch_size(n, percent))
    need = length - F.floor(n * (100 - percent) / 100)
    return staged(ranked.select("item", need.alias("need"), F.explode(F.slice("ranked", F.lit(1), length)).alias("e")).select("e.h", "item", "need"), "sketches")


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, n_item, n_shared, containment.

    Words are split at ASCII white space and lower-cased. A text with fewer
    words than `width` is one shingle of all its words, so such an item is found
    only in documents of the same few words. Null and wordless texts contain
    nothing and are contained nowhere. Rows without a doc_id or item_id are left
    out; of rows that repeat an id each text counts, the best match is kept.
    Other columns are ignored; empty tables give no rows.
    """
    items = items.where("item_id is not null").select("item_id", _words(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", shingles(F.col("words"), width).alias("shingles"), F.array_distinct(shingle_hashes(F.col("words"), width)).alias("hashes"))
    items = staged(items, "items")
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")
    sketches = _sketches(items, texts, width, percent)

    hashes = texts.select("doc_id", "key", _words(F.col("text")).alias("words"))
    hashes = hashes.select("doc_id", "key", F.explode(F.array_distinct(shingle_hashes(F.col("words"), width))).alias("h"))
    met = hashes.join(_sized(sketches), "h").groupBy("doc_id", "key", "item").agg(F.count("*").alias("met"), F.first("need").alias("need"))
    pairs = staged(met.where("met >= need").select("doc_id", "key", "item"), "leak-candidates")

    hit = texts.join(pairs.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi")
    # Words are a column of their own: within the shingle expression they would be split anew for every shingle.
    said = hit.select("doc_id", "key", _words(F.col("text")).alias("words")).select("doc_id", "key", F.explode(shingles(F.col("words"), width)).alias("shingle"))
    wanted = pairs.join(items.select("item", F.explode("shingles").alias("shingle")), "item")
    shared = wanted.join(said, ["doc_id", "key", "shingle"], "left_semi").groupBy("doc_id", "key", "item").agg(F.count("*").alias("n_shared"))
    found = shared.join(items.select("item", "item_id", F.size("shingles").cast("long").alias("n_item")), "item").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")
