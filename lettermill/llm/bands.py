"""Quality rules by compression bands: texts that compress too well or too badly for their length are rejected.

A document's zstandard ratio (compressed bytes by bytes) has to lie within the limits for its length, since a short
text compresses badly whatever it says; so does the ratio of each fixed chunk of CHUNK bytes, as a text may hold a
long run of one line or of noise between clean passages. A document fails when chunks with more than BAD_SHARE of
its bytes lie outside. Two counts of repetition and length come first (the base rules).

Defined results: a null or empty text has no words and fails the base rules; texts of any length are measured whole,
chunk by chunk; a repeated row is judged like any other, by its text alone; an empty table gives no rows; extra
columns, of whatever name, pass through `keep` and are ignored by `judge`. A ratio on a limit passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import texts, tune

LEVEL, CHUNK = 3, 4096
#: (bytes from, least ratio, greatest ratio): prose of western languages lies between 0.33 and 0.55 from 4 KB on, base64 at 0.76; headers weigh on short texts.
LIMITS = ((0, 0.0, 99.0), (64, 0.5, 1.25), (128, 0.38, 1.05), (256, 0.33, 0.9), (512, 0.28, 0.82), (1024, 0.24, 0.76), (2048, 0.2, 0.73), (4096, 0.16, 0.72))
BAD_SHARE = 0.25
#: Base rules: fewest words, and the most words (per cent) that lie in windows of WINDOW words found twice.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_REST = ("base_failed", "ratio", "n_chunks", "bad_chunk_bytes", "kept")


def within(n: int, ratio: float) -> bool:
    """Whether the ratio of n bytes lies within the limits for that length."""
    low, high = next((a, b) for least, a, b in reversed(LIMITS) if n >= least)
    return low <= ratio <= high


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in windows of `size` (a power of two) words that occur twice or more in the list."""
    if len(words) <= size:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    names = np.array([number[w] for w in words], np.int64)
    step = 1
    # names of windows of twice the length from the names of their halves
    while step < size:
        pairs = names[:-step] * (int(names.max()) + 1) + names[step:]
        _, names = np.unique(pairs, return_inverse=True)
        step *= 2
    found = np.flatnonzero(np.bincount(names)[names] > 1)
    if not len(found):
        return 0
    edges = np.bincount(found, minlength=len(words) + size) - np.bincount(found + size, minlength=len(words) + size)
    return int(np.count_nonzero(np.cumsum(edges)[: len(words)]))


def measure(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple:
    """The values of _COUNTS and _REST for one text in UTF-8. bytes.split() and strip() take the six ASCII blanks, so words are what lies between those."""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    counts = (len(words), len(joined.decode()), len(joined) - len(joined.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeats)
    failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(words)
    n = len(text)
    ratio = len(compressor.compress(text)) / n if n else 0.0
    bad = chunks = 0
    for at in range(0, n, CHUNK) if n > CHUNK else ():
        part = text[at : at + CHUNK]
        chunks += 1
        bad += 0 if within(len(part), len(compressor.compress(part)) / len(part)) else len(part)
    return (*counts, failed, ratio, chunks, bad, not failed and within(n, ratio) and bad <= BAD_SHARE * n)


def _measured(column: pa.Array, compressor: zstandard.ZstdCompressor) -> list[tuple]:
    return [measure(t.as_buffer().to_pybytes() if t.is_valid else b"", compressor) for t in column.cast(pa.large_binary())]


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; ratio, n_chunks, bad_chunk_bytes of the bands; kept."""
    tune(spark)
    kinds = dict.fromkeys((*_COUNTS, "n_chunks", "bad_chunk_bytes"), T.LongType()) | {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "ratio": T.DoubleType()}
    names = (*_COUNTS, *_REST)
    arrow = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            rows = _measured(b.column("text"), compressor)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[k] for r in rows], arrow[kinds[c]]) for k, c in enumerate(names)]], ["doc_id", *names])

    return texts(docs).mapInArrow(run, T.StructType([docs.schema["doc_id"], *[T.StructField(c, kinds[c]) for c in names]]))


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    tune(spark)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            yield b.filter(pc.equal(pa.array([r[-1] for r in _measured(b.column(at), compressor)], pa.bool_()), True))

    return docs.mapInArrow(run, docs.schema)
