"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

A document is the set of its distinct word shingles. Documents with equal sets
form one class before anything else, so thousands of copies cost one
signature. Classes that agree on a band of their signatures are candidates;
only pairs whose full sets pass the similarity test become links; components
of the links are the groups.

No bucket is paired out. A round takes one pivot per bucket, first the member
that meets most others, then one by lot, and compares every member of another
component with a pivot, so candidates stay below one per member. A pair inside
one component need not be tested, as it could change no component. What is left
in buckets with several components, the strays around a large group of near
copies, is settled by a prefix join: with shingles ordered from rare to common,
two sets of the wanted similarity must meet in the first of them, at places that
leave enough to come. Strays differ from the group in their rare shingles, so
few pairs remain to be tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import mix, run_hashes, signed, sized, staged, text_chunks, word_hashes
from studyloom.llm.components import components

#: Signature positions, and rows of one band: a pair at 0.8 shares a band but for 5 in 100 million pairs.
POSITIONS, BAND_ROWS = 128, 4
#: Pivot rounds before the prefix join of the rest.
PIVOT_ROUNDS = 2
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lowered; fewer words than `width` are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(width, len(words))))


def super_minhash(elements: np.ndarray, owner: np.ndarray, owners: int, positions: int = POSITIONS) -> np.ndarray:
    """Signatures (owners x positions) of element sets laid end to end.

    Every element has a random permutation of the positions, drawn by
    Fisher-Yates, and one uniform number per rank; a position keeps the smallest
    rank + uniform it is given. Ranks are walked in order over all elements at
    once: what a lower rank filled, a higher one cannot beat, so a set stops as
    soon as all its positions are filled. Values are rank << 32 | uniform bits.
    """
    signature = np.full(owners * positions, _EMPTY)
    table = signature.reshape(owners, positions)
    permutation = None
    live = np.ones(owners, bool)
    live[np.setdiff1d(np.arange(owners), owner)] = False
    for rank in range(positions):
        draw = mix(elements + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
        swap = np.int64(rank) + ((draw >> np.uint64(32)) * np.uint64(positions - rank) >> np.uint64(32)).view(np.int64)
        rows = np.arange(len(elements))
        place = swap if permutation is None else permutation[rows, swap].astype(np.int64)
        value = np.uint64(rank << 32) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(signature, owner * positions + place, value)
        left = np.flatnonzero(live)
        live[left[table[left].max(axis=1) != _EMPTY]] = False
        if not live.any():
            break
        keep = live[owner]
        rows, elements, owner, swap = rows[keep], elements[keep], owner[keep], swap[keep]
        if permutation is None:
            permutation = np.tile(np.arange(positions, dtype=np.uint8 if positions <= 256 else np.uint32), (len(elements), 1))
        else:
            permutation = permutation[keep]
        permutation[np.arange(len(elements)), swap] = permutation[:, rank]
    return table


def band_keys(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One key per band, the band's number mixed in."""
    owners, positions = signatures.shape
    parts = signatures[:, : positions // rows * rows].reshape(owners, positions // rows, rows)
    keys = np.broadcast_to(np.arange(positions // rows, dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for i in range(rows):
        keys = mix(keys * np.uint64(0xBF58476D1CE4E5B9) + parts[:, :, i])
    return keys


def _sign(width: int, positions: int, rows: int):
    """Per document: id, set size, id of its set, band keys (none for an empty set)."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            sets = [shingle_set(t, width) for t in texts]
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            bands: list = [None] * len(sets)
            # About 100,000 elements at a time, for the permutations' memory.
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[full]) // 100_000)) + 1
            for part in np.split(full, cuts):
                if len(part):
                    elements = np.concatenate([sets[i] for i in part])
                    signatures = super_minhash(elements, np.repeat(np.arange(len(part)), sizes[part]), len(part), positions)
                    for i, keys in zip(part, signed(band_keys(signatures, rows)), strict=True):
                        bands[i] = keys
            ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=fields)

    return work


def _pack(width: int):
    """Per document: id of its set and the set itself."""
    fields = pa.schema([("set_id", pa.binary()), ("elements", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            packed = [shingle_set(t, width).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(p) for p in packed], pa.binary()), pa.array(packed, pa.binary())], schema=fields)

    return work


def _linked(percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    fields = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).cast(fields).filter(pa.array(keep, pa.bool_()))

    return work


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of set ids those that pass on their full sets."""
    # The member's set travels to the pivot, where a hot pivot can be split.
    joined = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("set_b")).join(sized(pairs), "b")
    pivots = sets.join(sized(pairs.select(F.col("a").alias("set_id")).distinct()), "set_id", "left_semi")
    joined = joined.join(pivots.select(F.col("set_id").alias("a"), F.col("elements").alias("set_a")), "a")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a binary, b binary")


def _rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b) of members in two components that could still link, by prefix join."""
    fields = pa.schema([("set_id", pa.binary()), ("x", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                packed = [np.frombuffer(e.as_buffer(), np.int64) for e in part.column("elements")]
                at = np.repeat(np.arange(len(packed)), [len(p) for p in packed])
                yield pa.RecordBatch.from_arrays([part.column("set_id").cast(pa.binary()).take(pa.array(at)), pa.array(np.concatenate(packed))], schema=fields)

    nodes = staged(members.select("set_id", "root", F.col("n_shingles").alias("n")).distinct(), "nodes")
    own = sets.join(sized(nodes.select("set_id")), "set_id", "left_semi")
    rows = staged(own.mapInArrow(spread, "set_id binary, x long"), "shingles")
    # A table of its own, so that Spark can split the join with it on a common shingle.
    counts = staged(rows.groupBy("x").agg(F.count("*").alias("df")).where("df > 1"), "shingle-counts")
    # Shingles of one set only come first in its order and match nothing.
    ordered = rows.join(counts, "x").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("o")).join(nodes, "set_id")
    skip = F.col("n") - F.size("o")
    ahead = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - skip
    ordered = ordered.where(ahead > 0).select("set_id", "root", "n", skip.alias("skip"), F.posexplode(F.slice("o", F.lit(1), ahead.cast("int"))).alias("i", "e"))
    prefix = staged(ordered.select("set_id", "root", "n", F.col("e.x").alias("x"), (F.col("n") - F.col("skip") - F.col("i")).alias("rest")), "prefixes")
    # Of each shingle's sets those outside its largest component meet all others.
    parts = prefix.groupBy("x", "root").agg(F.count("*").alias("k")).groupBy("x").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    minor = prefix.join(parts.select("x", F.col("top.root").alias("top")), "x").where("root != top").drop("top")
    other = prefix.select("x", F.col("set_id").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    pairs = minor.join(other, "x").where((F.col("root") != F.col("root_a")) & (F.least("rest", "rest_a") * (100 + percent) >= (F.col("n") + F.col("n_a")) * percent))
    return pairs.select(F.greatest("a", "set_id").alias("a"), F.least("a", "set_id").alias("b")).distinct()


def _with_root(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("set_id"))
    return members.join(roots.select(F.col("id").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def _open(members: DataFrame) -> DataFrame:
    """Members (band, set_id, root, ...) of the buckets that hold two components at least."""
    ends = members.groupBy("band").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one != other")
    return members.join(ends.select("band"), "band")


def set_components(classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(id, root) of linked set ids; None when nothing links."""
    keys = classes.select("set_id", "n_shingles", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("met")).where("met > 1")
    members = staged(keys.join(shared, "band"), "buckets")
    ids = members.select("set_id").distinct()
    ids = staged(classes.join(ids, "set_id", "left_semi").select(F.col("first_doc").alias("doc_id")), "member-ids")
    sets = texts.join(sized(ids), "doc_id", "left_semi").mapInArrow(_pack(width), "set_id binary, elements binary")
    # Rows that repeat a document are one set, which is compared once.
    sets = staged(sets.dropDuplicates(["set_id"]), "sets")
    # Central members first: those that meet most others over all their buckets.
    rank = members.groupBy("set_id").agg(F.sum("met").alias("rank"))
    members = staged(members.drop("met").join(rank, "set_id"), "members")
    edges, roots = None, None
    for turn in range(PIVOT_ROUNDS + 1):
        members = staged(_open(_with_root(members.drop("root"), roots)), "open")
        if not members.head(1):
            break
        if turn == PIVOT_ROUNDS:
            pairs = _rest(members, sets, percent)
        else:
            order = F.col("rank") if turn == 0 else F.xxhash64(F.lit(turn), "root")
            other = (F.col("set_id").alias("a"), F.col("root").alias("root_a"), F.col("n_shingles").alias("n_a"))
            pivots = members.groupBy("band").agg(F.max(F.struct(order.alias("order"), *other)).alias("p")).select("band", "p.*")
            fits = F.least("n_shingles", "n_a") * 100 >= F.greatest("n_shingles", "n_a") * percent
            pairs = members.join(pivots, "band").where("root != root_a").where(fits)
            pairs = pairs.groupBy("set_id").agg(F.max(F.struct("order", "a")).alias("p")).select("p.a", F.col("set_id").alias("b"))
        found = _verified(staged(pairs, "pairs"), sets, percent)
        edges = staged(found if edges is None else edges.union(found), "links")
        roots = staged(components(edges), "roots")
    return roots


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, positions: int = POSITIONS, rows: int = BAND_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents with 100 * intersection >= percent * union of their
    shingle sets. component_id is the smallest doc_id reachable; kept marks the
    document of that id. A null or wordless text has an empty set, linked with
    nothing. Repeated rows of one id stay rows of one group. A row without an
    id links with nothing, has no component_id and is kept. Further columns of
    `docs` are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed_docs = staged(texts.mapInArrow(_sign(width, positions, rows), "doc_id long, n_shingles long, set_id binary, bands array<long>"), "signatures")
    usable = signed_docs.where("doc_id is not null and set_id is not null")
    # One row per distinct set; equal sets have equal bands, so any will do.
    classes = usable.groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands"))
    classes = staged(classes, "classes")
    roots = set_components(classes, texts.where("doc_id is not null"), width, percent)
    groups = _with_root(classes.select("set_id", "first_doc"), roots)
    smallest = groups.groupBy("root").agg(F.min("first_doc").alias("smallest"))
    named = groups.join(smallest, "root").select("set_id", "smallest")
    out = signed_docs.drop("bands").join(named, "set_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
