"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text: at each step it writes the character under its pointer, then a random bit
of (step, character) says whether the pointer moves on. Two texts of small edit distance soon walk in step
again after each edit, so what they write differs in few places: edit distance becomes Hamming distance.
A fingerprint samples SLOTS steps of the walk. Each slot takes the step of least hash among those that the
walk has, so texts of like length sample the same steps, at any length; a slot keeps one byte of what stands
there. Sampled slots also make the bands by which near pairs are found before they are verified.

Defined results: a null or empty text has the fingerprint of zeros only, likeness 1 to another empty text and
0 to any other; equal texts have equal fingerprints; repeated rows are fingerprinted each, and rows of equal
doc_id follow one another by text; rows of null doc_id come last; an empty table gives no rows, a table of
one row is its own next document; extra columns are ignored; texts of any length are walked whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, shuffle_parts, stored, texts, tune

SLOTS = 128
PHASES = 4096
CLASSES = 256
SEED = 20_011
#: A band is BAND slots; pairs that agree in one of BANDS are verified, BLOCK_PRINTS against as many.
BAND, BANDS, BLOCK_PRINTS = 8, 40, 1024
#: Bytes of input files for each range of documents, and how many ranges there are at most.
RANGE_BYTES, LEAST_ROWS, MOST_RANGES = 32 << 20, 1000, 1 << 17
#: Documents that walk in step; below NARROW of them, each goes on alone.
_TOGETHER, _NARROW = 4096, 48


@cache
def _stay() -> np.ndarray:
    """Steps that the pointer stays on a character of a class, from a step's phase: to the next random one bit."""
    bits = np.random.default_rng(SEED).random((CLASSES, PHASES)) < 0.5
    out = np.zeros((CLASSES, PHASES), np.uint8)
    nearest = np.full(CLASSES, 255, np.int64)
    for at in range(2 * PHASES - 1, -1, -1):
        nearest = np.where(bits[:, at % PHASES], 1, np.minimum(nearest + 1, 255))
        if at < PHASES:
            out[:, at] = nearest
    return out.ravel()


@cache
def _stay_lists() -> list[list[int]]:
    return _stay().reshape(CLASSES, PHASES).tolist()


@cache
def _records(limit: int) -> tuple[np.ndarray, ...]:
    """For each slot the steps below `limit` whose hash is less than all before: the last one below L is the sample of L steps."""
    out = []
    steps = np.arange(limit, dtype=np.uint64)
    for slot in range(SLOTS):
        h = mix(steps + np.uint64((slot + 1) << 40))
        least = np.minimum.accumulate(h)
        out.append(np.flatnonzero(np.concatenate([[True], least[1:] < least[:-1]])))
    return tuple(out)


def _samples(steps: np.ndarray) -> np.ndarray:
    """Sampled step of each text (rows) and slot (columns)."""
    limit = 1 << max(16, int(steps.max(initial=1)).bit_length())
    out = np.zeros((len(steps), SLOTS), np.int64)
    for slot, r in enumerate(_records(limit)):
        out[:, slot] = r[np.maximum(np.searchsorted(r, steps, "left") - 1, 0)]
    return out


def _walk(classes: np.ndarray, start: np.ndarray, length: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Steps after each character; text k is classes[start[k]:][:length[k]] and begins at step[k]."""
    stay, out = _stay(), np.zeros(len(classes), np.int32)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), _TOGETHER):
        group = order[lo : lo + _TOGETHER]
        at, left, now = start[group].copy(), length[group], step[group].astype(np.int64)
        live, i = int((left > 0).sum()), 0
        counts = -left
        while live > _NARROW:
            a, s = at[:live], now[:live]
            s += stay[(classes[a].astype(np.int64) << 12) + (s & (PHASES - 1))]
            out[a] = s
            a += 1
            i += 1
            if left[live - 1] <= i:
                live = int(np.searchsorted(counts, -i, "left"))
        lists = _stay_lists()
        for k in range(live):
            s, lo_k, hi_k = int(now[k]), int(at[k]), int(start[group[k]] + left[k])
            got = []
            push = got.append
            for c in classes[lo_k:hi_k].tolist():
                s += lists[c][s & 4095]
                push(s)
            out[lo_k:hi_k] = got
    return out


def _classes(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _read(codes: np.ndarray, start: np.ndarray, length: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Fingerprints (texts x SLOTS bytes): at each sampled step a byte of the character there and the two after it."""
    total = np.where(length > 0, after[np.maximum(start + length - 1, 0)] if len(after) else 0, 0).astype(np.int64)
    want = _samples(total)
    out = np.zeros((len(start), SLOTS), np.uint8)
    for k in np.flatnonzero(length):
        lo, hi = int(start[k]), int(start[k] + length[k])
        i = lo + np.searchsorted(after[lo:hi], want[k], "right")
        last = np.uint64(hi - 1)
        i = np.minimum(i, hi - 1)
        h = codes[i].astype(np.uint64)
        for d in (1, 2):
            j = i + d
            h = h * np.uint64(0x100000001B3) + np.where(j <= last, codes[np.minimum(j, hi - 1)], 0).astype(np.uint64)
        out[k] = mix(h) % np.uint64(255) + np.uint64(1)
    return out


def _codes(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(length) - length, length


def fingerprints(rows: list[str]) -> np.ndarray:
    codes, start, length = _codes(rows)
    return _read(codes, start, length, _walk(_classes(codes), start, length, np.zeros(len(rows), np.int64)))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of slots that agree; an empty text is like an empty one alone."""
    return (a == b).mean(-1)


def edit(text: str, other: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _both(rows: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Fingerprints of the texts and of their edited texts; the kept half is walked once."""
    codes, start, length = _codes(rows)
    classes = _classes(codes)
    after = _walk(classes, start, length, np.zeros(len(rows), np.int64))
    new = [edit(t, o) for t, o in zip(rows, others, strict=True)]
    e_codes, e_start, e_length = _codes(new)
    kept = length - length // 2
    step = np.where(kept > 0, after[np.maximum(start + kept - 1, 0)] if len(after) else 0, 0)
    e_after = _walk(_classes(e_codes), e_start + kept, e_length - kept, step)
    for k in range(len(rows)):
        e_after[e_start[k] : e_start[k] + kept[k]] = after[start[k] : start[k] + kept[k]]
    return _read(codes, start, length, after), _read(e_codes, e_start, e_length, e_after), new


def ranges(spark: SparkSession, docs: DataFrame) -> int:
    """Ranges of about RANGE_BYTES of the input's files (of LEAST_ROWS rows, where its size is not known), and no fewer than there are shuffle partitions: they do not grow with the input."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(max(shuffle_parts(spark), min(MOST_RANGES, size // RANGE_BYTES, docs.count() // LEAST_ROWS)))


def with_next(spark: SparkSession, docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(docs (doc_id, text) dealt to ranges of descending doc_id, null last, then by text (order: null, ~doc_id, hash of the text); each range ends with a copy of the rows that begin the one after it (ghost); the number of ranges).

    The ranges' bounds and first rows, one of each for a range, are all that the driver sees; no row is alone in a global order. Rows without a doc_id are dealt by their text's hash.
    """
    wide = isinstance(docs.schema["doc_id"].dataType, T.LongType | T.IntegerType | T.ShortType | T.ByteType)
    # ids are compared as they are: a double holds no more than 53 bits of them
    key = F.bitwise_not(F.col("doc_id").cast("long")) if wide else -F.col("doc_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), key.alias("k"), F.sha2(F.encode("text", "utf-8"), 256).alias("h"))
    keyed = docs.withColumn("o", order)
    known, nulls = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000 + 20 * parts)).first()[0] if parts > 1 and known else []
    cuts = sorted(set(cuts or []))
    of_none = max(1, -(-nulls * parts // max(known + nulls, 1)))
    hashed = F.floor(F.conv(F.substring("o.h", 1, 8), 16, 10).cast("long") * of_none / F.lit(1 << 32)).cast("int")
    ranged = keyed.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + hashed).otherwise(F.lit(len(cuts)) - _rank(cuts, F.col("doc_id"))).cast("int"))
    tops = ranged.groupBy("part").agg(F.min("o").alias("top")).orderBy("part").collect()
    if not tops:
        return ranged.withColumn("ghost", F.lit(False)), 1
    # the range that each range's first rows end; the first range's end the last one
    kind = ranged.schema["o"].dataType
    ends = spark.createDataFrame([(r.part, tops[k - 1].part, r.top) for k, r in enumerate(tops)], T.StructType([T.StructField("part", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("top", kind)]))
    ghosts = ranged.join(F.broadcast(ends), "part").filter(F.col("o").eqNullSafe(F.col("top"))).withColumn("part", F.col("to")).drop("to", "top").select(*ranged.columns)
    return ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True))), tops[-1].part + 1


def _rank(cuts: list, key):
    """How many cuts are less than key, by halving."""

    def go(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.lit(cuts[mid]) < key, go(mid + 1, hi)).otherwise(go(lo, mid))

    return go(0, len(cuts))


def fingerprint_with_edits(spark: SparkSession, docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. One shuffle of the texts."""
    tune(spark)
    docs = texts(docs)
    parts = parts or ranges(spark, docs)
    dealt, parts = with_next(spark, docs, parts)
    # rows of a range in its order; of several ghosts that tie, any is the next document, as their texts are equal
    sorted_ = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ghost", "o").select("doc_id", "text", "part", "ghost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, which waits for its next document
        for b in batches:
            ids, rows, nexts = [], [], []
            for i, t, p, ghost in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held is not None and held[2] == p:
                    ids.append(held[0])
                    rows.append(held[1])
                    nexts.append(t)
                held = None if ghost else (i, t, p)
            if rows:
                yield _digest(b.schema.field(0), ids, rows, nexts)

    out = T.StructType([docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]])
    return sorted_.mapInArrow(run, out)


def _digest(field: pa.Field, ids: list, rows: list[str], nexts: list[str]) -> pa.RecordBatch:
    a, e, new = _both(rows, nexts)
    n = fingerprints([nexts[-1]])
    follows = np.array([nexts[k] is rows[k + 1] for k in range(len(rows) - 1)], bool)
    b = np.concatenate([a[1:], n])
    for k in np.flatnonzero(~follows):
        b[k] = fingerprints([nexts[k]])[0]
    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new]
    return pa.RecordBatch.from_arrays([pa.array(ids, field.type), pa.array([len(x) for x in rows], pa.int64()), pa.array(sha), pa.array([x.tobytes().hex() for x in a]), pa.array([x.tobytes().hex() for x in e]), pa.array(likeness(a, e)), pa.array(likeness(a, b))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint (binary of SLOTS bytes), row by row without a shuffle."""
    tune(spark)
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = fingerprints(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array([x.tobytes() for x in got], pa.binary())], ["doc_id", "text", "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.BinaryType())]))


def near_pairs(spark: SparkSession, docs: DataFrame, least: float = 0.8) -> DataFrame:
    """text_id, near_id (least doc_id of two texts' fingerprints), likeness: every pair that shares a band of sampled steps, verified on whole fingerprints.

    Equal fingerprints are one row of the search, whatever their number. BANDS bands of BAND slots are drawn by the seed and may share slots. A band's rows are dealt to blocks of BLOCK_PRINTS, and every two
    blocks of a band are laid against each other; a pair is verified in the first band that it shares, so it is one row.
    """
    found = stored(spark, fingerprint(spark, docs).filter(F.length("text") > 0).groupBy("fingerprint").agg(F.min("doc_id").alias("id")).withColumn("n", F.monotonically_increasing_id()), "prints")
    draw = np.random.default_rng(SEED).permuted(np.tile(np.arange(SLOTS), (BANDS, 1)), axis=1)[:, :BAND]

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                prints = _prints(b.column("fingerprint"))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("n").to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS), b.num_rows)), pa.array(_keys(prints, draw).ravel())], ["n", "at", "band"])

    bands = found.select("n", "fingerprint").mapInArrow(band, "n long, at long, band long")
    shared = bands.groupBy("at", "band").agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK_PRINTS))
    rows = stored(spark, bands.join(shared, ["at", "band"]).withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks"))), "members")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sides = rows.withColumn("with", other).select("n", "at", "band", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), F.col("block").alias("own"))
    dealt = sides.join(found.select("n", "fingerprint"), "n").repartition("at", "band", "lo", "hi").sortWithinPartitions("at", "band", "lo", "hi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("at", "band", "lo", "hi")):
            prints, n, own = _prints(t["fingerprint"].combine_chunks()), t["n"].to_numpy(), t["own"].to_numpy()
            at, cross = t["at"][0].as_py(), t["lo"][0].as_py() != t["hi"][0].as_py()
            keys = _keys(prints, draw[:at]) if at else np.zeros((len(n), 0), np.int64)
            for k in range(len(n)):
                later = np.arange(k + 1, len(n))
                later = later[own[later] != own[k]] if cross else later
                like = likeness(prints[later], prints[k])
                ok = (like >= least) & ~(keys[later] == keys[k]).any(1)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), n[k])), pa.array(n[later[ok]]), pa.array(like[ok])], ["a", "b", "likeness"])

    pairs = dealt.select("n", "at", "band", "lo", "hi", "own", "fingerprint").mapInArrow(verify, "a long, b long, likeness double")
    ids = found.select("n", "id")
    pairs = pairs.join(ids.withColumnsRenamed({"n": "a", "id": "one"}), "a").join(ids.withColumnsRenamed({"n": "b", "id": "two"}), "b")
    return pairs.select(F.greatest("one", "two").alias("text_id"), F.least("one", "two").alias("near_id"), "likeness")


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _keys(prints: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """64 bits of each fingerprint's slots in each band."""
    return np.ascontiguousarray(prints[:, draw]).view("<i8")[:, :, 0].astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the columns `by`, which may go over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows:
            keys = np.stack([b.column(c).to_numpy() for c in by], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = keys[lo].tolist()
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
