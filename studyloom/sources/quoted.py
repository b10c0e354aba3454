"""CSV records whose quoted text holds line ends, read from splittable files.

Whether a line end closes a record depends on the quotes before it. A first
reading counts the quotes and lines of each split of a file, one small row a
split; running sums of those tell every split whether it begins inside quotes
and how many records begin before it. A second reading goes through the lines of
each split in file order and joins those of a record. No line is shuffled but
those of records that reach over the end of a split, and no file has to be read
by one task, which is what a multi-line CSV scan does.
"""

from __future__ import annotations

import sys
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.session import shared_dir

# Workers need no copy of this module on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE = '"'


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
    """The lines of a batch by file and split, with the quotes of each; a split's lines come one after the other."""
    files, splits, values = (batch.column(c) for c in ("file", "split", "value"))
    starts = np.asarray(splits)
    changed = np.asarray(pc.not_equal(files[1:], files[:-1])) | (starts[1:] != starts[:-1])
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    quotes = pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield files[a].as_py(), int(starts[a]), values.slice(a, b - a), quotes[a:b]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split its quotes, its lines, and those of them with an odd number of the split's quotes before them."""
    at, sums = None, (0, 0, 0)

    def row():
        return pa.RecordBatch.from_pydict(dict(zip(("file", "split", "quotes", "lines", "odd"), ([v] for v in (*at, *sums)))))

    for batch in batches:
        for file, split, values, quotes in _stretches(batch):
            if at != (file, split):
                if at is not None:
                    yield row()
                at, sums = (file, split), (0, 0, 0)
            before = sums[0] + np.cumsum(quotes) - quotes
            sums = (int(sums[0] + quotes.sum()), sums[1] + len(quotes), int(sums[2] + (before & 1).sum()))
    if at is not None:
        yield row()


def _begins(sizes) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """Per split: whether the quotes of its file pair up, whether it begins inside quotes, the records that begin before it."""
    by_file = defaultdict(list)
    for file, *rest in sizes:
        by_file[file].append(rest)
    found = {}
    for file, splits in by_file.items():
        paired, quotes, before = sum(s[1] for s in splits) % 2 == 0, 0, 0
        for split, own, lines, odd in sorted(splits):
            inside = quotes % 2 if paired else 0
            found[file, split] = paired, inside, before
            before += lines if not paired else odd if inside else lines - odd
            quotes += own
    return found


def _join(begins):
    """Records with their number, and whether all of their lines are in the split."""
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("number", pa.int64()), ("record", pa.string()), ("whole", pa.bool_())])

    def records(at, numbers, texts, whole):
        n = len(numbers)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(whole, pa.bool_())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, paired, inside, number, begun, held = None, True, 0, 0, False, []
        for batch in batches:
            for file, split, values, quotes in _stretches(batch):
                if at != (file, split):
                    if held:
                        yield records(at, [number], ["\n".join(held)], [begun and not inside])
                    at, begun, held = (file, split), False, []
                    # What a place in a file begins with holds for it however long its split is.
                    if at not in begins.value:
                        raise RuntimeError(f"{file} was split in another way when its quotes were counted")
                    paired, inside, number = begins.value[at]
                before = (inside + np.cumsum(quotes) - quotes) & 1
                starts = np.flatnonzero(before == 0) if paired else np.arange(len(quotes))
                first = int(starts[0]) if len(starts) else len(quotes)
                held += values.slice(0, first).to_pylist()
                if len(starts):
                    if held:
                        yield records(at, [number], ["\n".join(held)], [begun])
                    done, last = len(starts) - 1, int(starts[-1])
                    if done:
                        lists = pa.ListArray.from_arrays(pa.array(starts - first, pa.int32()), values.slice(first, last - first))
                        yield records(at, number + 1 + np.arange(done), pc.binary_join(lists, "\n"), np.ones(done, bool))
                    number, begun, held = number + len(starts), True, values.slice(last).to_pylist()
                inside = int(inside + quotes.sum()) & 1 if paired else 0
        if held:
            yield records(at, [number], ["\n".join(held)], [begun and not inside])

    return work


@contextmanager
def _same_splits(spark: SparkSession):
    """Both readings split files alike, also if executors come or go between them."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the CSV files under a path as (file, number, record), numbers from 1 in each file.

    Line ends inside quotes are kept. A file whose quotes do not pair up is
    read line by line. Empty lines between records count as records. The files
    are read at once; the records are kept in the shared folder.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    )
    kept, schema = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}", "file string, split long, number long, record string, whole boolean"
    with _same_splits(spark):
        begins = _begins(lines.mapInArrow(_count, "file string, split long, quotes long, lines long, odd long").collect())
        lines.mapInArrow(_join(spark.sparkContext.broadcast(begins)), schema).write.parquet(kept)
    found = spark.read.schema(schema).parquet(kept)
    records = found.filter("whole").select("file", "number", "record")
    if any(inside for _, inside, _ in begins.values()):
        pieces = found.filter("not whole").groupBy("file", "number")
        records = records.union(pieces.agg(F.expr("listagg(record, '\n') WITHIN GROUP (ORDER BY split)").alias("record")))
    return records.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_quoted_csv(spark: SparkSession, path: str, headers: list[str]) -> DataFrame:
    """All columns as text under the given headers; the first record of each file is its header and left out."""
    places = [f"c{i}" for i in range(len(headers))]
    rows = quoted_records(spark, path).filter((F.col("number") > 1) & (F.trim("record") != ""))
    schema = ", ".join(f"{p} string" for p in places)
    # multiLine lets the record parser take line ends for text.
    cells = F.from_csv("record", schema, {"quote": QUOTE, "escape": QUOTE, "maxCharsPerColumn": "-1", "multiLine": "true"})
    return rows.select(cells.alias("r")).select(*[F.col(f"r.{p}") for p in places]).toDF(*headers)
