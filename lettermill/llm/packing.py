"""Mixture-controlled packing of tokenised documents into fixed windows.

Each source is a queue. A window of SEQUENCE tokens takes from each queue its target share; what integer
shares leave over is the queue's deficit, which is carried to the next window. Carried exactly, the tokens
that a queue has given by window w are floor(A[q] x / G) - floor(A[q-1] x / G), with x the tokens packed by
then, G all tokens and A the running sums of the queues' tokens: a closed form, so that any task finds the
windows of its own documents from its place in the queue and no task has to see another's deficits.
Targets other than the sources' own shares run in phases; a phase ends when a source is empty.

A source of less than two tokens a window saves its deficit until it has QUANTUM tokens to give: such sources
share one queue (with the largest source, if all of them together are as small), in which the k-th of a
source's K quanta has its turn at (k + 1/2) / K of the way. Their places too are a closed form.

Defined results: a null or empty text is one end token; a null source is a source of its own; repeated rows
are packed each on their own; an empty table gives no rows; extra columns are ignored; documents of any
length are cut freely; only the last window can be short. The SOURCES largest sources and those that have a
weight are kept apart; any beyond them share REST further queues by a hash of their name.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table_of, tune

SEQUENCE = 2048
END_ID = 1
#: A source that has a smaller share of all tokens gives QUANTUM tokens at a time.
LEAST_SHARE, QUANTUM = 1024, 64
#: Sources that are told apart, which bounds what reaches the driver, and queues that all others share.
SOURCES, REST = 4096, 256
#: Places of blocks in their sources, of which at most so many are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
NONE = "\x00none"
#: The ranks file gives the same ids several times as fast; it is used for texts of these characters alone, on which both were compared.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e¡-¬®-ſ‐-‧€]*")


class ByteBpe:
    """Ids of texts as `tokenizers` gives them for a vocabulary file."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        # a text that holds an added token's string has that token's one id, which the ranks file does not know
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def default_tokenizer() -> ByteBpe:
    import public_tokenizers as files

    return ByteBpe(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def tokenize(docs: DataFrame, make_tokenizer=default_tokenizer, end_id: int = END_ID) -> DataFrame:
    """block (the task that read the row), source, doc_id, n, before (tokens of the source in the block before the row), ids (little-endian unsigned 16 or 32 bits, end id included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block = make_tokenizer(), TaskContext.get().partitionId()
        given: dict[str, int] = {}
        for b in batches:
            n, before, ids = [], [], []
            for s, t in zip(b.column("source").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = np.array([*(encode(t) if t else ()), end_id], np.uint32)
                n.append(len(got))
                before.append(given.get(s, 0))
                given[s] = before[-1] + len(got)
                ids.append(b"2" + got.astype("<u2").tobytes() if got.max() < 65536 else b"4" + got.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(n), pa.int64()), b.column("source").cast(pa.string()), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())], ["block", "source", "doc_id", "n", "before", "ids"])

    long = T.LongType()
    out = T.StructType([T.StructField("block", long), T.StructField("source", T.StringType()), docs.schema["doc_id"], T.StructField("n", long), T.StructField("before", long), T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), "text").mapInArrow(run, out)


class Phase:
    """What each source gives while none of them is empty: `take` tokens of it, after `given` in earlier phases."""

    def __init__(self, before: int, take: dict[int, int], given: list[int]) -> None:
        self.before, self.take, self.tokens = before, take, sum(take.values())
        self.given = {k: given[k] for k in take}
        self.pool = [k for k in take if take[k] * LEAST_SHARE < self.tokens]
        if self.pool and sum(take[k] for k in self.pool) * LEAST_SHARE < self.tokens:
            self.pool.append(max(take, key=lambda k: (take[k], -k)))
        self.pool_sizes = np.array([take[k] for k in self.pool], np.int64)
        self.sums, self.queue = [0], {}
        for k in take:
            if k not in self.pool:
                self.queue[k] = len(self.sums) - 1
                self.sums.append(self.sums[-1] + take[k])
        if self.pool:
            self.queue |= dict.fromkeys(self.pool, len(self.sums) - 1)
            self.sums.append(self.tokens)

    def runs(self, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the source's tokens lo to hi lie in its queue: (first tokens of runs, their places)."""
        if k not in self.pool:
            return np.array([lo]), np.array([lo])
        own, sizes = self.pool.index(k), self.pool_sizes
        turns = -(-sizes // QUANTUM)
        turn = np.arange(lo // QUANTUM, (hi - 1) // QUANTUM + 1, dtype=np.int64)
        place = np.empty_like(turn)
        others = np.arange(len(sizes)) < own
        for at in range(0, len(turn), step := max(1, (1 << 18) // len(sizes))):
            when = ((2 * turn[at : at + step] + 1) / float(turns[own]))[:, None]
            # quanta of each source whose turn comes before: where a quotient rounds, the neighbours are compared as they are
            first = np.maximum(np.floor((when * turns - 1) / 2).astype(np.int64) - 1, 0)
            n = first.copy()
            for k in range(4):
                their = (2 * (first + k) + 1) / turns.astype(float)
                n += (their < when) | ((their == when) & others)
            place[at : at + step] = np.minimum(n * QUANTUM, sizes).sum(1)
        start = np.maximum(turn * QUANTUM, lo)
        place = place + start - turn * QUANTUM
        new = np.concatenate([[True], np.diff(place) != np.diff(start)])
        return start[new], place[new]

    def windows(self, k: int, lo: int, hi: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queue's places lo to hi: where windows begin there (the first at or before lo), the window, and the offset in it."""
        q, g, before = self.queue[k], self.tokens, self.before
        c = self.sums[q + 1] - self.sums[q]
        first = max(before // size, (before + lo * g // c) // size - 2)
        last = min((before + g - 1) // size, (before + -(-hi * g // c)) // size + 2)
        w = np.arange(first, last + 2, dtype=np.int64)
        x = np.clip(w * size - before, 0, g)
        under, upto = _floor(self.sums[q], x, g), _floor(self.sums[q + 1], x, g)
        own = upto - under
        offset = np.maximum(before - w[:-1] * size, 0) + under[1:] - under[:-1]
        # of windows that begin at one place, the last has the tokens
        some = (own[1:] > lo) & (own[:-1] < hi) & (own[1:] > own[:-1])
        return own[:-1][some], w[:-1][some], offset[some]


def _floor(a: int, x: np.ndarray, g: int) -> np.ndarray:
    if g < 3_000_000_000:
        return a * x.astype(np.int64) // g
    return np.array([a * int(v) // g for v in x], np.int64)


def plan(totals: list[int], weights: list[int] | None = None) -> list[Phase]:
    """Phases that give all tokens; in each, sources give by their weights (None: by what they have)."""
    left, given, before = list(totals), [0] * len(totals), 0
    weights = list(totals) if weights is None else list(weights)
    out, active = [], [k for k, t in enumerate(totals) if t]
    while active:
        least = min(active, key=lambda k: (left[k] / max(weights[k], 1e-9), k))
        take = {k: left[k] if k == least or left[k] * weights[least] <= left[least] * weights[k] else left[least] * weights[k] // max(weights[least], 1) for k in active}
        take = {k: n for k, n in take.items() if n}
        out.append(Phase(before, take, given))
        before += out[-1].tokens
        for k, n in take.items():
            left[k] -= n
            given[k] += n
        active = [k for k in active if left[k]]
    return out


def place(k: int, lo: int, hi: int, phases: list[Phase], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a source's tokens lo to hi: where pieces begin (the first at lo), their windows and offsets."""
    cuts, windows, offsets = [], [], []
    for phase in phases:
        q0, n = phase.given.get(k, 0), phase.take.get(k, 0)
        if not n or hi <= q0 or lo >= q0 + n:
            continue
        start, at = phase.runs(k, max(lo, q0) - q0, min(hi, q0 + n) - q0)
        ends = np.append(start[1:], min(hi, q0 + n) - q0)
        for a, p, e in zip(start.tolist(), at.tolist(), ends.tolist(), strict=True):
            cut, window, offset = phase.windows(k, p, p + e - a, size)
            begin = np.maximum(cut, p)
            cuts.append(begin - p + a + q0)
            windows.append(window)
            offsets.append(offset + begin - cut)
    return np.concatenate(cuts), np.concatenate(windows), np.concatenate(offsets)


def pack(spark: SparkSession, docs: DataFrame, size: int = SEQUENCE, weights: dict[str, int] | None = None, make_tokenizer=default_tokenizer, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and, with_ids, ids (binary, as unsigned 32 bits).

    weights: target tokens of each source in a window, in any unit (None: its share of all tokens); sources not named weigh 1.
    Texts are tokenised once. Ids are never shuffled: with each row goes its place in its source, as the task that read it counted, and the task's own place is joined to it.
    """
    tune(spark)
    ids = stored(spark, tokenize(docs, make_tokenizer, end_id), "ids")
    sums = stored(spark, ids.groupBy("block", "source").agg(F.sum("n").alias("n")), "sums", 1)
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    named = totals.orderBy(F.desc(F.col("source").isin(*weights) if weights else F.lit(False)), F.desc("n"), "source").limit(SOURCES).select("source").collect()
    names = sorted(r.source for r in named)
    known = table_of(spark, list(enumerate(names)), "number long, name string")
    queued = sums.join(F.broadcast(known), F.col("source") == F.col("name"), "left").select("block", "source", "n", F.coalesce("number", F.lit(len(names)) + F.pmod(F.crc32(F.encode("source", "utf-8")), F.lit(REST))).alias("number"))
    held = {r.number: r.n for r in queued.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    phases = plan([held.get(k, 0) for k in range(len(names) + REST)], None if weights is None else [weights.get(s, 1) for s in names] + [1] * REST)
    model = spark.sparkContext.broadcast(phases)
    before = F.sum("n").over(Window.partitionBy("number").orderBy("block", "source").rowsBetween(Window.unboundedPreceding, -1))
    base = stored(spark, queued.select("block", "source", "number", F.coalesce(before, F.lit(0)).alias("base")), "base", 1)
    joined = ids.join(F.broadcast(base) if base.count() <= BROADCAST_ROWS else base, ["block", "source"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _pieces(b, model.value, size, with_ids)

    long = T.LongType()
    out = T.StructType([docs.schema["doc_id"], *[T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], T.StructField("source", T.StringType()), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    made = joined.select("doc_id", "source", "number", (F.col("base") + F.col("before")).alias("at"), "n", "ids").mapInArrow(emit, out)
    return made.withColumn("source", F.when(F.col("source") != NONE, F.col("source")))


def _pieces(b: pa.RecordBatch, phases: list[Phase], size: int, with_ids: bool) -> pa.RecordBatch:
    number, at, n = (b.column(c).to_numpy() for c in ("number", "at", "n"))
    blobs = b.column("ids")
    doc, start, length, crc, seq, off, parts = [], [], [], [], [], [], []
    order = np.lexsort((at, number))
    # runs of rows that follow one another in their source
    follows = (number[order][1:] == number[order][:-1]) & (at[order][1:] == at[order][:-1] + n[order][:-1])
    for rows in np.split(order, np.flatnonzero(~follows) + 1):
        begin = np.append(at[rows], at[rows[-1]] + n[rows[-1]])
        cut, window, offset = place(int(number[rows[0]]), int(begin[0]), int(begin[-1]), phases, size)
        first = np.unique(np.concatenate([cut, begin[:-1]]))
        ends = np.append(first[1:], begin[-1])
        k, w = np.searchsorted(begin, first, "right") - 1, np.searchsorted(cut, first, "right") - 1
        current, words = -1, None
        for i, a, e in zip(k.tolist(), first.tolist(), ends.tolist(), strict=True):
            if i != current:
                current = i
                raw = blobs[int(rows[i])].as_buffer()
                words = np.frombuffer(raw, "<u2" if raw[0] == 50 else "<u4", offset=1).astype("<u4")
            lo = a - int(begin[i])
            piece = words[lo : lo + e - a].tobytes()
            start.append(lo)
            length.append(e - a)
            crc.append(zlib.crc32(piece))
            if with_ids:
                parts.append(piece)
        doc.append(rows[k])
        seq.append(window[w])
        off.append(offset[w] + first - cut[w])
    k = np.concatenate(doc)
    columns = {"doc_id": b.column("doc_id").take(pa.array(k)), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n[k]), "sequence_id": pa.array(np.concatenate(seq)), "offset": pa.array(np.concatenate(off)), "source": b.column("source").take(pa.array(k))}
    return pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))
