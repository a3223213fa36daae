"""Exact substring deduplication: bytes covered by a string of WINDOW bytes that also starts elsewhere.

A difference cover modulo v holds, for any two places p and q, a shift d < v such that p + d and q + d are both
sampled. So each repeated string of WINDOW bytes holds a sampled string of WINDOW - v + 1 bytes that repeats
with it. Sampled suffixes are named first, by that many bytes (names are 64-bit values of a polynomial that
is put together from those of shorter strings, sent to the task that owns their range, sorted there and
compared with their neighbours). The remaining suffixes are merged in only where a sampled name repeats:
they are named by WINDOW bytes, and again sorted and compared with their neighbours.
What tasks send for a name is bounded by one entry for each chunk of texts, whatever the number of copies.

This departs from a full suffix array in that names are hashes rather than ranks, so no order between
different strings is kept: repeats need equality alone.

Defined results: a null or empty text has no bytes; matches never cross documents; overlapping occurrences
in one document count; repeated rows are documents of their own, so each repeats the other; an empty table
gives no rows; extra columns are ignored; texts of any length are one piece.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, mix, shared_dir, shuffle_parts, stored, tune

WINDOW = 400
#: Bytes of a whole window's name that are sent; with its range's, 60 bits and more tell names apart.
NAME_BYTES = 7
#: The cover's modulus is PRIME**2 + PRIME + 1, of which PRIME + 1 residues are sampled.
PRIME = 13
CHUNK = 1 << 20
#: Bytes of text for each range of names, which one task sorts at a time.
RANGE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


@cache
def difference_cover(p: int = PRIME) -> tuple[int, np.ndarray]:
    """A perfect difference set: the zeros of a maximal linear recurrence of degree 3 modulo p, found by trial."""
    v = p * p + p + 1
    for a in range(p):
        for b in range(p):
            for c in range(1, p):
                x, y, z, zeros = 0, 0, 1, []
                for i in range(v):
                    if x == 0:
                        zeros.append(i)
                    x, y, z = y, z, (a * z + b * y + c * x) % p
                if len(zeros) == p + 1 and len({(s - t) % v for s in zeros for t in zeros}) == v:
                    mask = np.zeros(v, bool)
                    mask[zeros] = True
                    return v, mask
    raise ValueError(f"no cover for {p}")


class _Powers:
    """Powers of the base and of its inverse, as many as have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for way, by in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n + 1, by, np.uint64)
                steps[0] = 1
                setattr(self, way, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


class Chunk:
    """Texts of one chunk, end to end, and the names of their strings."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray) -> None:
        self.data, self.lengths = data, lengths
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        n = len(data)
        up, self.down = _POWERS.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:n], out=self.sums[1:])

    def name(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.down[at])

    def sampled(self, window: int) -> tuple[np.ndarray, int]:
        """Places in the cover from which a sampled name is whole, and the name's bytes."""
        v, mask = difference_cover()
        length = window - v + 1
        out = []
        for s, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True):
            if n >= window:
                r = np.arange(0, n - length + 1)
                out.append(s + r[np.resize(mask, len(r))])
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), length

    def candidates(self, at: np.ndarray, repeats: np.ndarray, window: int) -> np.ndarray:
        """Places of whole windows that hold a repeated sampled name."""
        v, _ = difference_cover()
        count = np.zeros(len(self.data) + 1, np.int32)
        count[at[repeats] + 1] = 1
        np.cumsum(count, out=count)
        whole = np.zeros(len(self.data), bool)
        for s, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True):
            if n >= window:
                whole[s : s + n - window + 1] = True
        p = np.flatnonzero(whole)
        return p[count[p + v] > count[p]]


def _chunks(spark: SparkSession, docs: DataFrame) -> tuple[str, int]:
    """A bucketed table of chunks (chunk, ids, lengths, data), so that replies are joined to it without moving texts; its name, and the bytes in all."""
    field = docs.schema["doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k = TaskContext.get().partitionId() << 32, 0
        ids, lengths, parts, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
            kind = b0.schema.field("doc_id").type
            return pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([ids], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([packed], pa.binary())], ["chunk", "ids", "lengths", "data"])

        for b0 in batches:
            data, offsets = flat(b0.column("data"))
            for i, (lo, hi) in zip(b0.column("doc_id").to_pylist(), zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), strict=True):
                if size and size + hi - lo > CHUNK:
                    yield row()
                    k += 1
                    ids, lengths, parts, size = [], [], [], 0
                ids.append(i)
                lengths.append(hi - lo)
                parts.append(data[lo:hi].tobytes())
                size += hi - lo
        if ids:
            yield row()

    long = T.LongType()
    made = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data")).mapInArrow(pack, T.StructType([T.StructField("chunk", long), T.StructField("ids", T.ArrayType(field.dataType)), T.StructField("lengths", T.ArrayType(long)), T.StructField("data", T.BinaryType())]))
    name = f"chunks_{uuid.uuid4().hex}"
    # where a bucketed table has fewer partitions than a shuffle, Spark shuffles it for a join all the same
    least = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or shuffle_parts(spark))
    buckets = max(least, min(4096, docs.rdd.getNumPartitions()))
    made.write.bucketBy(buckets, "chunk").format("parquet").option("compression", "none").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    total = spark.table(name).agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return name, total


def _open(data: bytes, lengths: list[int]) -> Chunk:
    raw = zstandard.ZstdDecompressor().decompress(data) if lengths and sum(lengths) else b""
    return Chunk(np.frombuffer(raw, np.uint8), np.array(lengths, np.int64))


def _send(names: np.ndarray, ranges: int, width: int) -> Iterator[tuple[int, bytes]]:
    """(range, entries) of one chunk's distinct names in order: `width` bytes of each, then a bit of each that repeats in the chunk."""
    u, counts = np.unique(names, return_counts=True)
    cuts = np.searchsorted((u >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16), np.arange(ranges + 1, dtype=np.uint64))
    for r in np.flatnonzero(np.diff(cuts)):
        part = u[cuts[r] : cuts[r + 1]]
        entries = (part >> np.uint64(16)).astype("<u4").tobytes() if width == 4 else part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        yield int(r), entries + np.packbits(counts[cuts[r] : cuts[r + 1]] > 1).tobytes()


def _received(names: np.ndarray, replies: list[dict]) -> np.ndarray:
    """Which of the chunk's names repeat, from the replies of the ranges, in the order of _send."""
    if not len(names):
        return np.zeros(0, bool)
    _, back = np.unique(names, return_inverse=True)
    bits = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(replies, key=lambda x: x["range"])]
    return np.concatenate(bits).astype(bool)[back]


def _exchange(spark: SparkSession, sent: DataFrame, width: int, label: str) -> DataFrame:
    """sent: range, chunk, entries. chunk and its replies (range, n, bits: whether the name has another entry)."""

    def compare(t: pa.Table) -> pa.Table:
        rows = t["entries"].to_pylist()
        sizes = [len(x) * 8 // (width * 8 + 1) for x in rows]
        raw = np.concatenate([np.frombuffer(x, np.uint8, n * width) for x, n in zip(rows, sizes, strict=True)]).reshape(-1, width)
        whole = np.zeros((len(raw), 8), np.uint8)
        whole[:, :width] = raw
        names = whole.view("<u8").ravel()
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=n * width), count=n) for x, n in zip(rows, sizes, strict=True)])
        order = np.argsort(names, kind="stable")
        s = names[order]
        same = s[1:] == s[:-1]
        run = np.concatenate([[0], np.cumsum(~same)])
        repeats = np.zeros(len(names), bool)
        repeats[order] = (np.bincount(run, 1 + again[order]) > 1)[run]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({"chunk": t["chunk"], "range": t["range"], "n": pa.array(sizes, pa.int64()), "bits": pa.array([np.packbits(repeats[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    got = sent.groupBy("range").applyInArrow(compare, "chunk long, range long, n long, bits binary")
    return stored(spark, got, label).groupBy("chunk").agg(F.collect_list(F.struct("range", "n", "bits")).alias(label))


def repeated(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, spans (removed byte ranges, end exclusive), one row for each document.

    n_shared counts the document's sampled strings (window - v + 1 bytes) that start elsewhere too: passages that repeat but are shorter than a window show there alone.
    """
    tune(spark)
    v, _ = difference_cover()
    if window < v + 8:
        raise ValueError(f"windows of {v + 8} bytes at least")
    name, total = _chunks(spark, docs)
    chunks = spark.table(name)
    ranges = int(max(8, min(60_000, total // RANGE_BYTES)))
    sent = "range long, chunk long, entries binary"

    def rows(chunk: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["range", "chunk", "entries"])

    def each(b: pa.RecordBatch) -> Iterator[dict]:
        for k in range(b.num_rows):
            yield {c: b.column(c)[k].as_py() for c in b.schema.names}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in each(b):
                c = _open(x["data"], x["lengths"])
                at, length = c.sampled(window)
                yield rows(x["chunk"], list(_send(c.name(at, length), ranges, 4)))

    first = _exchange(spark, chunks.select("chunk", "lengths", "data").mapInArrow(sample, sent), 4, "sampled")

    def merged(x: dict) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
        c = _open(x["data"], x["lengths"])
        at, length = c.sampled(window)
        again = _received(c.name(at, length), x["sampled"] or [])
        p = c.candidates(at, again, window)
        return c, p, c.name(p, window), at[again]

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in each(b):
                yield rows(x["chunk"], list(_send(merged(x)[2], ranges, NAME_BYTES)))

    second = _exchange(spark, chunks.join(first, "chunk", "left").select("chunk", "lengths", "data", "sampled").mapInArrow(remaining, sent), NAME_BYTES, "windows")
    field = docs.schema["doc_id"]
    out = T.StructType([field, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("n_shared", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in enumerate(each(b)):
                c, p, names, shared = merged(x)
                hit = p[_received(names, x["windows"] or [])]
                cover = np.zeros(len(c.data) + 1, np.int32)
                cover[hit] += 1
                cover[hit + window] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                removed, spans, sha = [], [], []
                for lo, hi in zip(c.starts.tolist(), c.ends.tolist(), strict=True):
                    g = gone[lo:hi]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                    removed.append(int(g.sum()))
                    spans.append([{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)])
                    sha.append(hashlib.sha256(c.data[lo:hi][~g].tobytes() if len(edge) else c.data[lo:hi].tobytes()).hexdigest())
                ids = b.column("ids")[k].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(c.lengths), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha), pa.array(np.searchsorted(shared, c.ends) - np.searchsorted(shared, c.starts), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], out.names)

    return chunks.join(first, "chunk", "left").join(second, "chunk", "left").select("chunk", "ids", "lengths", "data", "sampled", "windows").mapInArrow(remove, out)


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each, by a dictionary of all windows; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for t in raw:
        for p in range(len(t) - window + 1):
            seen[t[p : p + window]] = seen.get(t[p : p + window], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        edges = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
        out.append((len(t), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out
