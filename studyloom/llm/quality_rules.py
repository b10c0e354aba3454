"""Rule-based quality by repetition coverage: how much of a text lies inside its own repeats.

Every word of a text is hashed once; rolling hashes over runs of several
lengths follow from those in numpy. A run whose hash occurs twice or more is
duplicated, and the characters of all words inside duplicated runs of one
length, each word once, are that length's coverage. Lines that repeat an
earlier line count by their characters in the same way. A text is kept when no
coverage exceeds its limit. Each text is judged alone, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from studyloom.llm.common import run_hashes, text_chunks, word_hashes

#: Largest percentage of a text's word characters that duplicated runs of so many words may hold. The limits usual for
#: repeats after the first (15 to 10 per cent) are doubled here, since the first occurrence counts as well.
RUN_LIMITS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: The same for lines that repeat an earlier line, the first not counted.
LINE_LIMIT = 20
#: Words of a window of n_repeat_words, its largest percentage of all words, and the fewest words of a text.
BASE_RUN, BASE_PERCENT, LEAST_WORDS = 3, 50, 50
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
#: UTF-8 bytes that continue a character.
_CONTINUES = bytes(range(0x80, 0xC0))


def _characters(text: bytes) -> int:
    return len(text.translate(None, _CONTINUES))


def in_repeats(hashes: np.ndarray, width: int) -> np.ndarray:
    """Whether each word lies in a run of `width` words that occurs twice or more."""
    runs = run_hashes(hashes, width)
    ordered = np.sort(runs)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(hashes), bool)
    starts = np.flatnonzero(np.isin(runs, twice))
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes, run_lengths: list[int]) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, then characters covered per run length (shortest first)."""
    words = text.split()
    hashes = word_hashes(words)
    chars = np.fromiter(map(len, words), np.int64, len(words)) if text.isascii() else np.fromiter(map(_characters, words), np.int64, len(words))
    seen, n_dup, dup_chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup += 1
            dup_chars += _characters(b"".join(line.split()))
        elif line and not line.isspace():
            seen.add(line)
    base = in_repeats(hashes, BASE_RUN)
    covered, repeated = [], True
    for width in run_lengths:
        # A run that repeats holds shorter runs that repeat: without those there is nothing to look for.
        repeated = repeated and (width < BASE_RUN or bool(base.any()))
        mask = in_repeats(hashes, width) if repeated else np.zeros(len(words), bool)
        repeated = bool(mask.any())
        covered.append(int(chars[mask].sum()))
    return (len(words), int(chars.sum()), len(text.translate(None, _NOT_SYMBOLS)), n_dup, int(base.sum()), dup_chars, *covered)


def _rules(limits: Mapping[int, int], line_limit: int):
    lengths = sorted(limits)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
    fields = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("covered_chars", pa.list_(pa.int64())), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            got = np.array([measure(t or b"", lengths) for t in texts], np.int64)
            n_words, word_chars, repeat_words, line_chars, covered = got[:, 0], got[:, 1], got[:, 4], got[:, 5], got[:, 6:]
            failed = (n_words < LEAST_WORDS) | (100 * repeat_words > BASE_PERCENT * n_words)
            good = 100 * line_chars <= line_limit * word_chars
            good &= (100 * covered <= np.array([limits[w] for w in lengths], np.int64) * word_chars[:, None]).all(axis=1)
            lists = pa.array(list(covered), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(got[:, i]) for i in range(6)), lists, pa.array(failed), pa.array(good & ~failed)], schema=fields)

    return work


def repetition_rules(docs: DataFrame, limits: Mapping[int, int] = RUN_LIMITS, line_limit: int = LINE_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, covered_chars, base_failed, kept.

    `limits` gives per run length the largest percentage of word characters
    inside duplicated runs; `covered_chars` holds those characters, shortest
    runs first. A null text counts as an empty one, which fails the base rules
    for want of words. Each text is taken whole; repeated rows are judged
    alike, rows without an id too. Other columns are ignored; an empty table
    gives no rows.
    """
    types = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, covered_chars array<long>, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(_rules(dict(limits), line_limit), types)
