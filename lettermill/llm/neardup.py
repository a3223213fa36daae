"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's word 5-grams are labelled by their occurrence (the second of a kind differs from the first). For each
of BANDS hash functions the KEPT least of them, put back into text order, make one band: order counts, so
bands agree as texts agree in edit similarity. Any two texts that share a band are candidates. Every candidate
pair is verified by aligning words inside the band that a similarity of 0.8 leaves, unless the two are in one
class already. Verified pairs make classes by connected components.

A band's texts are dealt to blocks of at most about BLOCK texts and BLOCK_WORDS words, so neither a task nor a
row holds a whole band. Blocks are first settled each on its own, by the bands of one round (ROUNDS) after the
other, where classes have joined what they can; then blocks of one band are laid against each other, but for two of
one class and those whose sizes no near pair can have. A text goes into a later band only where that holds another
class of like size, and into no band that holds the very texts of an earlier one. Pairs are never rows: a task drops
those whose word counts alone are too far apart (no alignment within the band is left), and those that an earlier band
of theirs holds.

Equal texts are one text throughout, so a group of copies costs one row. Defined results: a null text is an
empty one; texts without a word are near to nothing but equal texts; a text of fewer than five words is one
5-gram; class_id is the least doc_id of the class, null if it has none; repeated rows are of one class; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, stored, tune

SHINGLE, BANDS, KEPT, LEAST = 5, 64, 2, 0.8
#: A list of ids of at most so many rows is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Texts and words of one block of a band.
BLOCK, BLOCK_WORDS = 512, 1 << 20
#: Bands are settled in rounds, which end before these: what one joins need not be asked in the next.
ROUNDS = (4, 12, 24, BANDS)
#: Buckets of words, by which pairs are turned down together.
BUCKETS = 256
#: Edits up to which furthest-reaching points are followed; more are counted by whole columns.
FEW = 24
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TURN = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


class Words:
    """Texts to arrays of word hashes."""

    def __init__(self) -> None:
        self.held: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        held = self.held
        if len(held) > 200_000:
            held.clear()
        for w in words:
            if w not in held:
                held[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled 5-grams, in text order."""
    n = max(1, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        h += words[k : k + n] * _TURN[k]
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if not new.all():
        first = np.flatnonzero(new)
        rank = np.arange(n) - first[np.cumsum(new) - 1]
        h[order] = s + rank.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix(h)


def sketch(words: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; none without a word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    h = shingles(words)
    return mix(np.concatenate([_bands(h, k, k + _ABREAST) for k in range(0, BANDS, _ABREAST)]) if len(h) > 20_000 else _bands(h, 0, BANDS))


#: Bands of a very long text that are drawn at a time.
_ABREAST = 2


def _bands(h: np.ndarray, lo: int, hi: int) -> np.ndarray:
    turned = (h ^ (h >> np.uint64(29)))[None, :] * _SEEDS[lo:hi, None]
    turned ^= turned >> np.uint64(32)
    turned *= np.uint64(0xD6E8FEB86659FD93)
    # the least KEPT, back in text order
    at = np.sort(np.argpartition(turned, KEPT - 1, axis=1)[:, :KEPT], axis=1) if len(h) > KEPT else np.tile(np.arange(len(h)), (hi - lo, 1))
    key = np.arange(lo + 1, hi + 1, dtype=np.uint64)
    for k in range(at.shape[1]):
        key = (key * np.uint64(0x100000001B3)) ^ h[at[:, k]]
    return key


def edit_distance_at_most(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences in a band of `most` diagonals to either side; None beyond `most`."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return max(n, m)
    got = _few(a, b, min(most, FEW))
    return got if got is not None or most <= FEW else _columns(a, b, most)


def _few(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Furthest-reaching points by diagonal: quick for few edits."""
    n, m = len(a), len(b)

    def slide(i: int, j: int) -> int:
        step = 16
        while i < n and j < m:
            k = min(step, n - i, m - j)
            off = a[i : i + k] != b[j : j + k]
            first = int(off.argmax())
            if off[first]:
                return i + first
            i, j, step = i + k, j + k, step * 2
        return i

    reach = {0: slide(0, 0)}
    if reach[0] >= n and n == m:
        return 0
    for d in range(1, most + 1):
        new = {}
        for k in range(-d, d + 1):  # diagonal j - i
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            if i < 0:
                continue
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            new[k] = i = slide(i, i + k)
            if i >= n and i + k >= m:
                return d
        reach = new
    return None


def _columns(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """One column of the alignment at a time, in one integer whose bits are the band's steps up and down."""
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    most = min(most, n)
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << width - 1
    # bit r of column j is row j - most + r; rows before the first are as if each cost one step less
    up, down = full & ~((1 << most) - 1), 0
    # the cell on the lowest diagonal that is followed: row j + most, until it passes the last row, then the last row
    at, cost = most, most
    for j, x in enumerate(b.tolist()):
        hits = where.get(x, 0)
        hits = (hits >> j - most if j > most else hits << most - j) & full
        diag = (((hits & up) + up) ^ up | hits | down) & full
        plus = down | full & ~(diag | up)
        minus = diag & up
        row = j + 1 + most
        if row <= n:
            cost += not diag & top
        else:
            bit = 1 << n - row + width - 1
            cost += bool(plus & bit) - bool(minus & bit)
        moved = diag >> 1
        up = minus | full & ~(moved | plus)
        down = moved & plus
    return cost if cost <= most else None


def _anchored(a: np.ndarray, b: np.ndarray) -> int:
    """An alignment's cost, so an upper bound of the edit distance: through 3-grams found once in either, in rising order."""
    if min(len(a), len(b)) < 3:
        return max(len(a), len(b))
    g = [x[:-2] * _TURN[0] + x[1:-1] * _TURN[1] + x[2:] * _TURN[2] for x in (a, b)]
    (ua, ia, ca), (ub, ib, cb) = (np.unique(x, return_index=True, return_counts=True) for x in g)
    _, ka, kb = np.intersect1d(ua[ca == 1], ub[cb == 1], assume_unique=True, return_indices=True)
    pa_, pb_ = ia[ca == 1][ka], ib[cb == 1][kb]
    order = np.argsort(pa_)
    x, y = pa_[order], pb_[order]
    keep = y == np.maximum.accumulate(y)
    keep &= y <= np.minimum.accumulate(y[::-1])[::-1]
    x, y = x[keep], y[keep]
    # between two anchors the gap costs the longer side
    gx = np.diff(np.concatenate([[-1], x, [len(a)]])) - 1
    gy = np.diff(np.concatenate([[-1], y, [len(b)]])) - 1
    # an anchor's own later words lie in the gap of both
    both = np.minimum(np.minimum(gx, gy), 2)
    both[0] = 0
    return int((np.maximum(gx, gy) - both).sum())


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether 1 - edit distance / longer length is at least `least`: by two bounds, then exactly."""
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if _anchored(a, b) <= most:
        return True
    u, ca = np.unique(a, return_counts=True)
    v, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    if max(len(a), len(b)) - int(np.minimum(ca[i], cb[j]).sum()) > most:
        return False
    return edit_distance_at_most(a, b, most) is not None


def joined(ids: np.ndarray, labels: np.ndarray, words: list[np.ndarray], bands: np.ndarray, at: int, split: int | None, least: float) -> list[tuple[int, int]]:
    """(label, least label of its class) for what near pairs join: pairs of one block, or (split) of texts before `split` with texts from it. bands: texts x BANDS; at: the band that the texts share."""
    size = np.array([len(w) for w in words], np.int64)
    counts = np.stack([np.bincount((w & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) for w in words]).astype(np.int32)
    names, root = np.unique(labels, return_inverse=True)
    was, moved = root.copy(), False
    for i in range(len(ids) if split is None else split):
        lo = i + 1 if split is None else split
        j = lo + np.flatnonzero(root[lo:] != root[i])
        if at and len(j):  # asked in an earlier band
            j = j[~(bands[j, :at] == bands[i, :at]).any(1)]
        if not len(j):
            continue
        longer = np.maximum(size[i], size[j])
        most = ((1 - least) * longer + 1e-9).astype(np.int64)
        j, longer, most = (v[longer - np.minimum(size[i], size[j]) <= most] for v in (j, longer, most))
        # each word that one has and the other has not costs an edit
        for k in j[longer - np.minimum(counts[j], counts[i]).sum(1) <= most].tolist():
            if root[k] != root[i] and similar(words[i], words[k], least):
                root[root == root[k]] = root[i]
                moved = True
    if not moved:
        return []
    first = np.full(len(names), len(names))
    np.minimum.at(first, root, was)
    to = np.zeros(len(names), np.int64)
    to[was] = first[root]
    return [(int(names[k]), int(names[to[k]])) for k in np.unique(was).tolist() if to[k] != k]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of equal band and block, which may go over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column("band").to_numpy(), b.column("block").to_numpy()], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[lo].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _settled(rows: DataFrame, least: float) -> DataFrame:
    """key, leader: labels that near pairs of rows of one band and block join. rows: band, block, side, at, text, label, words, bands."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            if t.num_rows < 2:
                continue
            side = t["side"].to_numpy()
            order = np.argsort(side, kind="stable")
            t, split = t.take(pa.array(order)), int((side == 0).sum())
            words = [np.frombuffer(x, "<u4").astype(np.uint64) for x in t["words"].to_pylist()]
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            found = joined(t["text"].to_numpy(), t["label"].to_numpy(), words, bands, t["at"][0].as_py(), split if split < t.num_rows else None, least)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["key", "leader"])

    dealt = rows.select("band", "block", "side", "at", "text", "label", "words", "bands").repartition("band", "block").sortWithinPartitions("band", "block")
    return dealt.mapInArrow(settle, "key long, leader long")


def _name(text: Column) -> Column:
    """A text's name: 128 bits of a digest."""
    return F.unhex(F.md5(F.encode(text, "utf-8")))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), _name(text).alias("key"))


def _blocks(rows: Column, size: Column) -> Column:
    return F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_WORDS)))


def classes(spark: SparkSession, docs: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key of its text; texts: key, class_id, class_key, n_copies). class_key is the text that stays."""
    tune(spark)
    keyed = _keyed(docs)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Words()
        for b in batches:
            words = [read(t) for t in b.column("text").to_pylist()]
            bands = [sketch(w).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array([len(w) for w in words], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "size", "bands"])

    drawn = keyed.mapInArrow(draw, T.StructType([docs.schema["doc_id"], T.StructField("key", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
    sketches = stored(spark, drawn, "sketches")
    # texts are numbered; the table is written once, so numbers stay
    texts = stored(spark, sketches.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands")).withColumn("text", F.monotonically_increasing_id()), "texts")
    members = stored(spark, _members(texts), "members")
    packed = _packed(spark, keyed, texts, members)

    alone = members.withColumn("label", F.col("text")).withColumn("side", F.lit(0))
    labels = components(spark, stored(spark, _settled(alone.filter(F.col("at") < ROUNDS[0]).join(packed, "text"), least), "joined"))
    for lo, hi in zip(ROUNDS[:-1], ROUNDS[1:], strict=True):
        # of the other bands, those whose texts are not of one class yet
        later = _labelled(members.filter((F.col("at") >= lo) & (F.col("at") < hi)), labels).withColumn("side", F.lit(0))
        labels = _further(spark, labels, components(spark, stored(spark, _settled(_mixed(later, least).join(packed, "text"), least), "joined")))
    crowded = stored(spark, _mixed(_labelled(members.filter("n_blocks > 1").drop("block"), labels), least), "crowded")
    if crowded.limit(1).count():
        labels = _further(spark, labels, components(spark, stored(spark, _settled(_crossed(spark, crowded).join(packed, "text"), least), "joined")))

    own = texts.select("key", "id", "n_copies", "text")
    found = own.join(labels.withColumnRenamed("key", "text"), "text")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    found = found.join(first, "label").select("key", F.col("first.id").alias("class_id"), F.col("first.key").alias("class_key"), "n_copies")
    rest = own.join(labels, own["text"] == labels["key"], "left_anti").select("key", F.col("id").alias("class_id"), F.col("key").alias("class_key"), "n_copies")
    return sketches.select("doc_id", "key"), found.unionByName(rest)


def _members(texts: DataFrame) -> DataFrame:
    """band, at (its place among BANDS), text, size, n_blocks, block: texts of the bands that more than one has. Of bands of the very same texts, the first alone: the others hold no other pair."""
    bands = texts.select("text", "size", F.posexplode("bands").alias("at", "band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("at").alias("at"), F.min("text").alias("lo"), F.max("text").alias("hi"), F.bit_xor(F.xxhash64("text")).alias("all")).filter("n > 1")
    shared = shared.groupBy("n", "words", "lo", "hi", "all").agg(F.min(F.struct("at", "band")).alias("first")).select("first.band", "n", "words")
    dealt = bands.join(shared.select("band", _blocks(F.col("n"), F.col("words")).alias("n_blocks")), "band")
    return dealt.withColumn("block", F.pmod(F.xxhash64("text", "band"), F.col("n_blocks")))


def _packed(spark: SparkSession, keyed: DataFrame, texts: DataFrame, members: DataFrame) -> DataFrame:
    """text, words (32 bits of each word's hash), bands: of all members, read once."""
    wanted = stored(spark, texts.join(members.select("text").distinct(), "text").select(F.col("key").alias("k"), "id", F.col("text").alias("number"), "bands"), "wanted")
    n = wanted.count()
    # one row of each text: that of its least doc_id
    held = wanted.select("k", "id", "number")
    found = keyed.join(F.broadcast(held) if n <= BROADCAST_ROWS // 4 else held, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Words()
        for b in batches:
            # 0.8 of a text's words don't agree by chance
            yield pa.RecordBatch.from_arrays([b.column("number"), pa.array([(read(t) >> np.uint64(32)).astype("<u4").tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["text", "words"])

    made = found.select("number", "text").mapInArrow(pack, "text long, words binary").dropDuplicates(["text"])
    return stored(spark, made.join(wanted.select(F.col("number").alias("text"), "bands"), "text"), "words", n)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("key", "text"), "text", "left").withColumn("label", F.coalesce("label", "text"))


def _further(spark: SparkSession, labels: DataFrame, joined: DataFrame) -> DataFrame:
    """labels after the classes that `joined` (label, its new label) names are put together."""
    new = joined.select(F.col("key").alias("old"), F.col("label").alias("new"))
    moved = labels.join(new, F.col("label") == F.col("old"), "left").select("key", F.coalesce("new", "label").alias("label"))
    alone = joined.join(labels, "key", "left_anti").select("key", "label")
    return stored(spark, moved.unionByName(alone), "labels")


def _near_sizes(least: float) -> Column:
    """A number by size (words): those of two texts that are near differ by one at most. A step is a little more than the ratio that `least` leaves."""
    return F.floor(F.log(F.col("size")) / F.lit(math.log(1.01 / least)))


def _mixed(members: DataFrame, least: float) -> DataFrame:
    """Members of the bands that hold another class among texts of like size."""
    members = members.withColumn("step", _near_sizes(least))
    held = members.groupBy("band", "step").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    around = held.select("band", F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)])).alias("step"), "lo", "hi")
    mixed = around.groupBy("band", "step").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("band", "step")
    return members.join(mixed, ["band", "step"], "left_semi")


def _crossed(spark: SparkSession, members: DataFrame) -> DataFrame:
    """Rows of each two blocks of a band whose sizes are alike, as one block with two sides. A class that fills a block has blocks of its own, and two of them are not laid against each other."""
    parts = members.groupBy("band", "step", "label").agg(F.count("*").alias("n"), F.sum("size").alias("words")).withColumn("own", _blocks(F.col("n"), F.col("words")))
    rest = parts.groupBy("band", "step").agg(_blocks(F.sum(F.when(F.col("own") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("own") == 1, F.col("words")).otherwise(0))).alias("rest"))
    dealt = members.join(parts.select("band", "step", "label", "own"), ["band", "step", "label"]).join(rest, ["band", "step"])
    pure = F.col("own") > 1
    dealt = dealt.select("band", "at", "text", "label", "step", F.when(pure, F.col("label")).alias("of"), F.when(pure, F.pmod(F.xxhash64("text"), F.col("own"))).otherwise(F.pmod(F.xxhash64("label"), F.col("rest"))).alias("part"))
    dealt = stored(spark, dealt.withColumn("place", F.struct("step", F.coalesce("of", F.lit(-1)).alias("of"), "part")).drop("step"), "parts")
    places = dealt.select("band", "place").distinct()
    # each place meets those of its own step and of the next
    others = places.select("band", F.col("place").alias("other"), F.explode(F.array("place.step", F.col("place.step") - 1)).alias("step"))
    pairs = places.withColumn("step", F.col("place.step")).join(others, ["band", "step"]).drop("step")
    pairs = pairs.filter("place <= other and not (place.of >= 0 and place.of = other.of)")
    pairs = stored(spark, pairs.withColumn("block", F.monotonically_increasing_id()), "pairs")
    sides = pairs.select("band", "place", "block", F.lit(0).alias("side")).union(pairs.filter("place != other").select("band", F.col("other").alias("place"), "block", F.lit(1).alias("side")))
    return dealt.join(sides, ["band", "place"]).drop("place", "of", "part")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """key, label: the least key of each connected component. links: key, leader.

    Labels of up to BROADCAST_ROWS links are broadcast, those of more are shuffled. Least labels spread along links and along labels (a label's own label), so long chains shrink by halves.
    """
    links = stored(spark, links.union(links.select(F.col("leader").alias("key"), F.col("key").alias("leader"))).distinct(), "links")
    n = links.count()
    small = n <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda df: df
    at = links.groupBy("key").agg(F.min("leader").alias("m")).select("key", F.least("key", "m").alias("label"))
    at = stored(spark, at, "labels", n)
    while True:
        near = links.join(sent(at.select(F.col("key").alias("leader"), "label")), "leader").groupBy("key").agg(F.min("label").alias("m"))
        new = near.join(sent(at), "key").select("key", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = at.select(F.col("key").alias("label"), F.col("label").alias("further"))
        new = new.join(sent(jump), "label", "left").select("key", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = stored(spark, new, "labels", n)
        if not new.filter("label != was").limit(1).count():
            return new.select("key", "label")
        at = new.select("key", "label")


def near_duplicates(spark: SparkSession, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id, n_copies (rows of equal text): one row for each document."""
    rows, texts = classes(spark, docs, least)
    return rows.join(texts, "key").select("doc_id", "class_id", "n_copies")


def keep_one(spark: SparkSession, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with one row of each class, that of its least doc_id; all columns stay, whatever their names."""
    rows, texts = classes(spark, docs, least)
    gone = stored(spark, rows.join(texts, "key").filter((F.col("key") != F.col("class_key")) | ~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("key", "doc_id").distinct(), "gone")
    small = gone.count() <= BROADCAST_ROWS // 4
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", _name(F.coalesce("text", F.lit(""))).alias("key"))
    held = gone.select(F.col("key").alias("k"), F.col("doc_id").alias("i"))
    kept = kept.join(F.broadcast(held) if small else held, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_anti")
    if rows.groupBy("key", "doc_id").count().filter("count > 1").limit(1).count():
        # the same id and text more than once
        kept = kept.dropDuplicates(["key"])
    return kept.select("doc.*")
