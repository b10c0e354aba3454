"""Helpers that several operators share: words, hashes, shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.session import shared_dir

#: White space between words: space and the five ASCII controls 0x09 to 0x0D.
SPACES = "[ \\t-\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of text worked on together inside a task, in bytes of text.
CHUNK_BYTES = 1_000_000
#: Lists of ids up to this count (8 to 32 bytes each) are broadcast.
BROADCAST_IDS = 2_000_000

#: Multipliers of the 64-bit finaliser (splitmix64), fixed values.
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def sized(ids: DataFrame) -> DataFrame:
    """Broadcast a staged list of ids if it is counted to be short; else leave the join to shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def split_words(text: Column) -> Column:
    """Words of a text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive word hashes: a polynomial, doubled up in log(width) passes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done = np.zeros(len(h) + 1, np.uint64), 0
    part, size, factor = h, 1, int(_M1)  # part[i]: hash of `size` words from i; factor: the base to the power `size`
    while True:
        if width & size:
            m = min(len(out), len(part) - done)
            out = out[:m] * np.uint64(factor) + part[done : done + m]
            done += size
        if size * 2 > width:
            return mix(out[:n] + _GOLD)
        m = len(part) - size
        part = part[:m] * np.uint64(factor) + part[size : size + m]
        factor, size = factor * factor % 2**64, size * 2


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the incoming batches with their texts as bytes (None for null), of bounded size."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > CHUNK_BYTES:
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start), texts.slice(start).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def in_fold(key: Column, folds: int, which: int) -> Column:
    """Whether crc32 of the key as text, modulo `folds`, is `which`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == which
