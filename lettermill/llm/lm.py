"""Language-model scoring by online logistic context mixing.

A text is a sequence of lower-case words and one end. It is coded in binary decisions, each predicted by
ORDERS counters at hashed contexts, whose logits are mixed by weights that a gate selects: what is decided and
how much each counter has seen. Bits add up to the text's log probability.

* Segments: texts are cut where the hash of two words says so. Whether the next segment is one that followed
  the same segment in other training documents is one decision, and which of them is the next; it costs a few
  bits where whole passages come again. These counts are joined, so they grow with the corpus without a bound.
* Words: a word of the dictionary is its class (CLASSES of like endings and like weight, by decisions in a tree)
  and its share of the class. Contexts: the text's own classes so far, the last two classes, the last word, the last two.
* Other words are the escape; then, whether the text has had the word, or else its letters, by decisions in a
  tree. Contexts: the last one, two, three and five letters.

What a text has shown is learned while it is read, block by block: its own classes, its repeated words, and
offsets to the weights. The weights are learned online, in each task that holds training documents, from all of
them, and averaged. Counters come from all training documents: tasks send
compressed blocks of what they have seen, which are summed in rounds of FAN. Counters and dictionary are
broadcast and so bounded (MOST_BITS, CODES); counts of rarer words and of segments have no bound.

Defined results: a null or empty text is its end token alone; repeated rows each teach and are scored; with no
training rows every count is 0; an empty table gives no rows; extra columns are ignored; texts of any
length are scored whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, residue, stored, tune

ORDERS, LEAVES = 4, 64
#: Classes of words, the last for all that are spelled.
CLASSES = 64
#: Words with a code of their own, the most frequent that come twice; every task holds them and their counts.
CODES = 1 << 18
#: Rows of the largest table of counters, as a power of two that follows the corpus up to a bound.
LEAST_BITS, MOST_BITS = 8, 17
#: Counters of one block that tasks send, and blocks that are summed at a time.
BLOCK_CELLS, FAN = 1 << 18, 64
#: What a document has shown is taken up after every BLOCK words, or 1/32 of it if that is more.
BLOCK = 32
GROUP_TOKENS = 60_000
RATE = 0.5
#: Text whose words are looked up in the dictionary at a time.
CODED_BYTES = 16 << 20
#: Symbols whose decisions are mixed at a time, so that arrays stay small; but for rounding, no result depends on it.
PIECE = 1 << 14
#: Words of a segment, on average.
SEGMENT = 24
_M = np.uint32(0x9E3779B1)


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words and the end (the empty string)."""
    return [*text.lower().split(), b""]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts (some are empty, which are none), the places of those that are one, and how many each text has: `tokens` of many at a time, without the ends."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string() if texts.type == pa.binary() else pa.large_string())))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    is_word = np.diff(np.frombuffer(flat.buffers()[1], np.int64 if flat.type == pa.large_string() else np.int32, len(flat) + 1)) > 0 if len(flat) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(is_word)])
    return flat, np.flatnonzero(is_word), before[offsets[1:]] - before[offsets[:-1]]


class Tree:
    """Paths of LEAVES symbols in a Huffman tree of nodes 1 to LEAVES - 1."""

    def __init__(self, weights: list[int]) -> None:
        heap = [(max(n, 1), k) for k, n in enumerate(weights)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        made = len(weights)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y] = (made, 0), (made, 1)
            heapq.heappush(heap, (a + b, made))
            made += 1
        paths = []
        for k in range(len(weights)):
            path = []
            while k in up:
                path.append((up[k][0] - len(weights) + 1, up[k][1]))
                k = up[k][0]
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.int32)
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length
        self.node = np.array([n for p in paths for n, _ in p], np.int64)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)
        # leaves below each node's 0 and 1, to sum counts of leaves to counts of nodes
        self.below = np.zeros((2, LEAVES, LEAVES), np.float32)
        for k, p in enumerate(paths):
            for n, b in p:
                self.below[b, k, n] = 1

    def path(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(decisions of each symbol, node, bit) of a row of symbols."""
        length = self.length.take(sym)
        ends = np.cumsum(length)
        at = np.repeat(self.start.take(sym) - (ends - length), length)
        at += np.arange(len(at))
        return length, self.node.take(at), self.bit.take(at)


class Coder:
    """Words to classes, letters to leaves, contexts to rows of counters."""

    def __init__(self, words: list[bytes], counts: list[int], rest: int, bits: int) -> None:
        self.codes = {w: k for k, w in enumerate(words)}
        self.listed = pa.array(words, pa.string())
        self.escape = len(words)
        order = sorted(range(len(words)), key=lambda k: words[k][::-1])
        n = np.array([counts[k] for k in order], float)
        cls = np.empty(len(words) + 1, np.int64)
        cls[order] = np.minimum((np.cumsum(n) - n / 2) * (CLASSES - 1) / max(n.sum(), 1), CLASSES - 2).astype(np.int64)
        cls[-1] = CLASSES - 1
        self.cls = cls
        total = np.bincount(cls[:-1], np.array(counts, float), CLASSES) if words else np.zeros(CLASSES)
        # bits of a word within its class
        self.within = np.append(np.log2(np.maximum(total[cls[:-1]], 1) / np.maximum(np.array(counts, float), 1)), 0.0)
        letters = np.ones(256, np.int64)
        ends = 1
        for w in words[len(words) // 16 :]:
            np.add.at(letters, np.frombuffer(w, np.uint8), 1)
            ends += 1
        known = np.argsort(-letters, kind="stable")[: LEAVES - 2]
        self.leaf = np.full(257, LEAVES - 1, np.int64)  # the last leaf is any other byte
        self.leaf[known] = np.arange(LEAVES - 2)
        self.leaf[256] = LEAVES - 2
        weights = [*letters[known].tolist(), ends, int(letters.sum() - letters[known].sum())]
        self.trees = [Tree([*total[:-1].astype(int).tolist(), max(rest, 1)]), Tree(weights)]
        self.spill = 8.0  # bits of a byte without a leaf
        # tables: (rows as a power of two); row 0 of the first is for the text's own classes, which no table has
        down = MOST_BITS - bits
        sizes = [12, max(8, 16 - down), bits, 9, 13, 15, 16]
        self.bits = sizes
        self.first = np.concatenate([[0], np.cumsum([1 << b for b in sizes])])
        self.hash = np.arange(self.escape + 1, dtype=np.uint32) * np.uint32(2654435761)

    def code(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.codes.get, words, repeat(self.escape)), np.int64, len(words))

    def codes_of(self, words: pa.ChunkedArray) -> np.ndarray:
        """As code, of many at a time: each call lays out the dictionary anew."""
        return pc.fill_null(pc.index_in(words, self.listed.cast(words.type)), self.escape).to_numpy().astype(np.int64)

    def _row(self, table: int, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x297A2D39)
        return (h >> np.uint32(32 - self.bits[table])).astype(np.int64) + self.first[table]

    def classes(self, code: np.ndarray, names: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Class of each word and the rows of its contexts (last two classes, last word, last two). new: the first words of documents."""
        cls = self.cls[code]

        def last(x: np.ndarray, none: int) -> np.ndarray:
            out = np.concatenate([[none], x[:-1]]).astype(x.dtype)
            out[new] = none
            return out

        a = last(cls, CLASSES - 1)
        one = last(names, 1)
        two = last(one, 2)
        return cls, [a * LEAVES + last(a, CLASSES - 1), self._row(1, one * _M + np.uint32(11)), self._row(2, (one ^ (two * np.uint32(0x85EBCA77))) * _M + np.uint32(23))]

    def letters(self, spelled: list[bytes], after: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Leaf of each letter and end of each word, the word's number, and the rows of the contexts. after: the class of the word before, which tells a language while the word has said little."""
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
        raw = np.frombuffer(b"\xff".join(spelled) + b"\xff", np.uint8).astype(np.int64)  # 0xff is in no UTF-8
        ends = np.cumsum(sizes) - 1
        raw[ends] = 256
        place = np.arange(len(raw)) - np.repeat(ends + 1 - sizes, sizes)
        padded = np.concatenate([np.zeros(5, np.uint32), raw.astype(np.uint32)])
        x = np.zeros(len(raw), np.uint32)
        mood = np.repeat((after + 1).astype(np.uint32) * np.uint32(0x85EBCA77), sizes)
        rows = []
        for k in range(5):
            x = (x ^ np.where(place > k, padded[4 - k : 4 - k + len(raw)], 0).astype(np.uint32)) * _M + np.uint32(0x51ED270B)
            x ^= x >> np.uint32(15)
            if k in (0, 1, 2, 4):
                rows.append(self._row(3 + len(rows), x + np.where(place < 3, mood, 0).astype(np.uint32) if k in (1, 2) else x))
        return self.leaf[raw], np.repeat(np.arange(len(spelled)), sizes), rows


def _names(coder: Coder, words: list[bytes], code: np.ndarray) -> np.ndarray:
    """32 bits that name each word."""
    h = coder.hash[code]
    esc = np.flatnonzero(code == coder.escape)
    h[esc] = np.fromiter((xxhash.xxh32_intdigest(words[k]) for k in esc.tolist()), np.uint32, len(esc))
    return h


#: A count in a byte: itself below 64, then its logarithm.
_VALUE = np.concatenate([np.arange(64), 64 * 2 ** (np.arange(192) / 16)])


def _quantised(n: np.ndarray) -> np.ndarray:
    """Pairs of counts; where one is beyond the last value both are scaled by one factor, so that their ratio stays."""
    n = n.astype(np.float64)
    over = n.max(axis=1, keepdims=True) / _VALUE[255]
    n = np.where(over > 1, np.rint(n / np.maximum(over, 1)), n)
    return np.where(n < 64, n, np.minimum(255, 64 + np.floor(16 * np.log2(np.maximum(n, 64) / 64)))).astype(np.uint16)


def _logits() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By packed counts: logit, what has been seen (0 to 3), and the logits without the decision itself: those of bit 0, then those of bit 1."""
    n0, n1 = _VALUE[np.arange(65536) >> 8], _VALUE[np.arange(65536) & 255]
    logit = lambda a, b: np.log((b + 0.3) / (a + 0.3)).astype(np.float32)
    return logit(n0, n1), np.digitize(n0 + n1, [1, 4, 48]).astype(np.uint16), np.concatenate([logit(np.maximum(n0 - 1, 0), n1), logit(n0, np.maximum(n1 - 1, 0))])


class Mixer:
    """Gated weights and what they make of a group of documents."""

    def __init__(self, coder: Coder, tables: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.coder, self.tables = coder, tables
        self.weights = np.tile(np.array([0.3] * ORDERS + [0.0], np.float32), (512, 1)) if weights is None else weights
        self.logit, self.seen, self.without = _logits()
        self.columns = np.ascontiguousarray(self.weights.T)
        self.squares = np.full(self.weights.shape, 1e-3)
        self.steps = np.zeros((ORDERS + 1, 512))

    def _mix(self, packed: list, spelled: int, bit: np.ndarray, learn: bool, doc: np.ndarray | None = None, offset: np.ndarray | None = None, moves: np.ndarray | None = None) -> np.ndarray:
        """Bits of each decision from its ORDERS inputs: packed counts, or (logit, what has been seen). What would refine the offsets by document (and, in the last row, by how many decisions) is added to moves, and with learn what would refine the weights to steps."""
        gate = np.full(len(bit), spelled, np.uint16)
        side = np.float32(1) - bit * np.float32(2)
        turned = bit.astype(np.int64) << 16 if learn else None
        x = []
        for p in packed:
            gate <<= 2
            if isinstance(p, tuple):
                x.append(p[0])
                gate |= p[1]
            else:
                p = p.astype(np.int64)  # once, not in each lookup
                gate |= self.seen.take(p)
                if learn:
                    p += turned
                x.append(self.without.take(p) if learn else self.logit.take(p))
        gate = gate.astype(np.int64)
        if offset is not None:  # doc rises
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            held, runs = doc[first], np.diff(np.append(first, len(doc)))
        z = self.columns[ORDERS].take(gate)
        if offset is not None:
            z += np.repeat(offset[ORDERS].take(held), runs)
        for k in range(ORDERS):
            w = self.columns[k].take(gate)
            if offset is not None:
                w += np.repeat(offset[k].take(held), runs)
            w *= x[k]
            z += w
        z *= side  # the logit of the other bit
        np.clip(z, -14, 14, out=z)
        np.exp(z, out=z)
        if learn or offset is not None:
            err = z / (1 + z)
            err *= -side
        if learn or offset is not None:
            for k in range(ORDERS + 1):
                each = err * x[k] if k < ORDERS else err
                if offset is not None:
                    moves[k, held] += np.add.reduceat(each, first)
                if learn:
                    self.steps[k] += np.bincount(gate, each, 512)
            if offset is not None:
                moves[-1, held] += runs
        if not learn:  # who learns asks for no bits
            np.log1p(z, out=z)
            z *= np.float32(1 / math.log(2))
        return z

    def _step(self) -> None:
        """Refine the weights."""
        self.squares += self.steps.T**2
        self.weights += (0.05 * self.steps.T / np.sqrt(self.squares)).astype(np.float32)
        self.columns = np.ascontiguousarray(self.weights.T)
        self.steps[:] = 0

    def read(self, words: list[bytes], code: np.ndarray, sizes: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word of a row of documents, and the words' names. With learn, the weights are refined and the bits mean nothing."""
        coder, n = self.coder, len(sizes)
        starts = np.cumsum(sizes) - sizes
        names = _names(coder, words, code)
        new = np.zeros(len(words), bool)
        new[starts] = True
        cls, rows = coder.classes(code, names, new)
        doc = np.repeat(np.arange(n), sizes)
        place = np.arange(len(words)) - starts[doc]
        block = (place // np.maximum(BLOCK, -(-sizes // 32))[doc]).astype(np.uint8)
        bits = coder.within[code].copy()
        flat = self.tables.reshape(-1)
        # words in the order of their blocks
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(int(block.max()) + 2))
        own = np.zeros(n * 2 * LEAVES, np.float32)
        rows = [r * LEAVES for r in rows]
        offset = np.zeros((ORDERS + 1, n), np.float32)
        tree = coder.trees[0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            moves, shown = np.zeros((ORDERS + 2, n)), []
            for at in (order[k : min(k + PIECE, hi)] for k in range(lo, hi, PIECE)):
                length, node, bit = tree.path(cls.take(at))
                d = np.repeat(doc.take(at), length)
                cell = d * (2 * LEAVES) + node
                zero, one = own.take(cell), own.take(cell + LEAVES)
                total = zero + one
                held = (np.log((one + np.float32(0.3)) / (zero + np.float32(0.3))), (total >= 1).astype(np.uint16) + (total >= 4) + (total >= 48))
                packed = [flat.take(np.repeat(r.take(at), length) + node) for r in rows]
                cost = self._mix([held, *packed], 0, bit, learn, d, offset, moves)
                if not learn:
                    bits[at] += np.add.reduceat(cost, np.cumsum(length) - length)
                shown.append(cell + bit * np.int64(LEAVES))
            own += np.bincount(np.concatenate(shown), minlength=own.size)
            offset += (RATE * moves[:-1] / np.maximum(moves[-1], 1)).astype(np.float32)
            if learn:
                self._step()
        esc = np.flatnonzero(code == coder.escape)
        if len(esc):
            after = np.where(new[esc], CLASSES - 1, cls[esc - 1])
            bits[esc] += self._escaped([words[k] for k in esc.tolist()], names[esc], after, doc[esc], n, learn)
        return bits, names

    def _escaped(self, spelled: list[bytes], names: np.ndarray, after: np.ndarray, doc: np.ndarray, n: int, learn: bool) -> np.ndarray:
        """Bits of words without a code: whether the text has had the word, then which, or its letters."""
        key = doc.astype(np.int64) << 32 | names
        _, first = np.unique(key, return_index=True)
        is_new = np.zeros(len(key), bool)
        is_new[first] = True
        begin = np.searchsorted(doc, np.arange(n))[doc]  # doc rises
        before = np.arange(len(key)) - begin
        new_before = np.cumsum(is_new) - is_new
        new_before = new_before - new_before[begin]
        p = (before - new_before + 0.2) / (before + 1.2)
        bits = np.where(is_new, np.where(before > 0, -np.log2(1 - p), 0.0), -np.log2(p) + np.log2(np.maximum(new_before, 1)))
        fresh = np.flatnonzero(is_new)
        leaf, word, rows = self.coder.letters([spelled[k] for k in fresh.tolist()], after[fresh])
        flat = self.tables.reshape(-1)
        each = []
        for k in range(0, len(leaf), PIECE):
            length, node, bit = self.coder.trees[1].path(leaf[k : k + PIECE])
            cost = self._mix([flat.take(np.repeat(r[k : k + PIECE] * LEAVES, length) + node) for r in rows], 1, bit, learn)
            each.append(np.add.reduceat(cost, np.cumsum(length) - length))
        if learn:
            self._step()
        each = np.concatenate(each) + np.where(leaf == LEAVES - 1, self.coder.spill, 0.0)
        bits[fresh] += np.bincount(word, each, len(fresh))
        return bits


def segments(bits: np.ndarray, names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents (doc rises): for each two segments that follow one another, the document, the names of both, the bits of the second, and how many followers the first has in the document. A pair counts once in a document."""
    none = np.zeros(0, np.int64)
    if len(names) < 2:
        return none, none, none, np.zeros(0), none
    with np.errstate(over="ignore"):
        h = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        pair = (h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) * np.uint64(0xD1B54A32D192ED03)
        ends = np.append(((pair >> np.uint64(40)) % np.uint64(SEGMENT) == 0) | (doc[1:] != doc[:-1]), True)
        # whether a word ends a segment is a matter of it and the one before, or after at a document's end
        ends = np.append(ends[:1] & (doc[1] != doc[0]), ends[:-1] & (doc[1:] == doc[:-1]) | np.append(doc[2:] != doc[1:-1], True))
        first = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
        place = np.arange(len(names)) - np.repeat(first, np.diff(np.append(first, len(names))))
        name = np.add.reduceat((h + place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) * (h | np.uint64(1)) ^ (h >> np.uint64(31)), first)
        name = (name ^ (name >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        cost, of = np.add.reduceat(bits, first), doc[first]
        at = np.flatnonzero(of[1:] == of[:-1])
        salt = of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        before = mix(name[at] + salt[at])
        _, keep = np.unique(mix(before + mix(name[at + 1])), return_index=True)
    keep.sort()
    _, back, n = np.unique(before[keep], return_inverse=True, return_counts=True)
    at = at[keep]
    return of[at], name[at].view(np.int64), name[at + 1].view(np.int64), cost[at + 1], n[back]


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """Lists of n documents, of values in the documents' order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32()), values)


def token_counts(spark: SparkSession, train: DataFrame) -> DataFrame:
    """token (binary; the end is empty), n over all of train."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(tokens(t))
            if len(seen) > 400_000:
                yield _pairs(seen)
                seen.clear()
        yield _pairs(seen)

    return stored(spark, train.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")


def _pairs(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})


def _coded(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches, what `split` makes of them, and the codes of their words, which are looked up for CODED_BYTES at a time."""
    held, size = [], 0
    for b in chain(batches, [None]):
        if b is not None:
            held.append(b)
            size += b.column("text").nbytes
        if held and (b is None or size >= CODED_BYTES):
            parts = [split(x.column("text")) for x in held]
            found = coder.codes_of(pa.chunked_array([p[0] for p in parts]))
            at = 0
            for x, p in zip(held, parts, strict=True):
                yield x, *p, found[at : at + len(p[0])]
                at += len(p[0])
            held, size = [], 0


def _grouped(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int], pa.RecordBatch]]:
    """Documents in groups of about GROUP_TOKENS words: words (those without a code alone, the others are None), codes, sizes, and which rows of which batch they are. Documents of like length go together."""
    for b, flat, is_word, sizes, found in _coded(batches, coder):
        sizes = sizes + 1
        ends = np.cumsum(sizes) - 1
        starts = ends + 1 - sizes
        inner = np.ones(int(sizes.sum()), bool)
        inner[ends] = False
        codes, place = np.full(len(inner), coder.codes.get(b"", coder.escape)), np.full(len(inner), -1)
        codes[inner], place[inner] = found[is_word], is_word
        group, size = [], 0
        for k in [*np.argsort(sizes, kind="stable").tolist(), None]:
            if group and (k is None or size + int(sizes[k]) > GROUP_TOKENS or len(group) >= 1000):
                at = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in group])
                code, words = codes[at], np.full(len(at), None, object)
                esc = np.flatnonzero(code == coder.escape)
                lies = place[at[esc]]
                words[esc] = b""
                words[esc[lies >= 0]] = flat.take(pa.array(lies[lies >= 0])).cast(pa.large_binary()).to_pylist()
                yield words, code, sizes[group], group, b
                group, size = [], 0
            if k is not None:
                group.append(k)
                size += int(sizes[k])


def context_tables(spark: SparkSession, train: DataFrame, coder) -> np.ndarray:
    """Packed counts (rows x LEAVES) of each context's decisions, from all of train. Tasks send the leaves that they have counted; blocks are summed on the executors in rounds."""
    cells = int(coder.value.first[-1]) * LEAVES
    n_blocks = -(-cells // BLOCK_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, own = np.zeros(n_blocks * BLOCK_CELLS, np.uint32), coder.value
        for words, code, sizes, _, _ in _grouped(batches, own):
            new = np.zeros(len(words), bool)
            new[np.cumsum(sizes) - sizes] = True
            names = _names(own, words, code)
            cls, rows = own.classes(code, names, new)
            for r in rows:
                np.add.at(sums, r * LEAVES + cls, np.uint32(1))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            esc = np.flatnonzero(code == own.escape)
            if len(esc):  # a word is spelled once in a document
                _, first = np.unique(doc[esc] << 32 | names[esc], return_index=True)
                esc = esc[first]
                leaf, _, rows = own.letters([words[k] for k in esc.tolist()], np.where(new[esc], CLASSES - 1, cls[esc - 1]))
                for r in rows:
                    np.add.at(sums, r * LEAVES + leaf, np.uint32(1))
        packer = zstandard.ZstdCompressor(level=1)
        for k, part in enumerate(sums.reshape(n_blocks, -1)):
            at = np.flatnonzero(part)
            if len(at):
                yield _sent(packer, k, TaskContext.get().partitionId(), at, part[at])

    sent = train.select("text").mapInArrow(count, "block long, task long, n binary")
    tasks = max(1, train.rdd.getNumPartitions())
    while tasks > 1:
        tasks = -(-tasks // FAN)
        dealt = sent.withColumn("task", F.floor(F.col("task") / FAN)).repartition("block", "task").sortWithinPartitions("block", "task")
        sent = dealt.mapInArrow(_add_up, "block long, task long, n binary")
    out = np.zeros((n_blocks, BLOCK_CELLS), np.uint16)
    first = int(coder.value.first[3]) * LEAVES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), strict=True):
                at, values = _received(n)
                total = np.zeros(BLOCK_CELLS, np.float32)
                total[at] = values
                made = np.zeros((BLOCK_CELLS // LEAVES, LEAVES), np.uint16)
                spelled = (k * BLOCK_CELLS + np.arange(0, BLOCK_CELLS, LEAVES)) >= first
                for kind in (0, 1):
                    if (spelled == kind).any():
                        leaves = total.reshape(-1, LEAVES)[spelled == kind]
                        zero, one = (leaves @ coder.value.trees[kind].below[bit] for bit in (0, 1))
                        q = _quantised(np.stack([zero.ravel(), one.ravel()], 1))
                        made[spelled == kind] = (q[:, 0] << 8 | q[:, 1]).reshape(-1, LEAVES)
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "n": pa.array([made.tobytes()], pa.binary())})

    for r in sent.select("block", "n").mapInArrow(pack, "block long, n binary").toLocalIterator():
        out[r.block] = np.frombuffer(r.n, np.uint16)
    return out.reshape(-1, LEAVES)


def _sent(packer: zstandard.ZstdCompressor, block: int, task: int, at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    raw = np.uint32(len(at)).tobytes() + np.diff(at, prepend=0).astype("<u4").tobytes() + values.astype("<u8").tobytes()
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "task": pa.array([task], pa.int64()), "n": pa.array([packer.compress(raw)], pa.binary())})


def _received(n: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(n)
    size = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.cumsum(np.frombuffer(raw, "<u4", size, 4), dtype=np.int64), np.frombuffer(raw, "<u8", size, 4 + 4 * size)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of block and task; one block is held at a time."""
    packer, key, total = zstandard.ZstdCompressor(level=1), None, np.zeros(0, np.uint64)
    for b in batches:
        for k, t, n in zip(*(b.column(c).to_pylist() for c in ("block", "task", "n")), strict=True):
            if key != (k, t):
                if key is not None:
                    at = np.flatnonzero(total)
                    yield _sent(packer, *key, at, total[at])
                key, total = (k, t), np.zeros(BLOCK_CELLS, np.uint64)
            at, values = _received(n)
            total[at] += values
    if key is not None:
        at = np.flatnonzero(total)
        yield _sent(packer, *key, at, total[at])


def mixing_weights(train: DataFrame, coder, tables) -> np.ndarray:
    """Weights by gate, learned online in each task from all of train, and averaged by how often a task has used them."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(coder.value, tables.value)
        for words, code, sizes, _, _ in _grouped(batches, coder.value):
            mixer.read(words, code, sizes, learn=True)
        used = np.sqrt(np.maximum(mixer.squares - 1e-3, 0).sum(1))
        yield pa.RecordBatch.from_pydict({"gate": pa.array(range(512), pa.int64()), "used": pa.array(used, pa.float64()), **{f"w{k}": pa.array(mixer.weights[:, k] * used, pa.float64()) for k in range(ORDERS + 1)}})

    columns = [f"w{k}" for k in range(ORDERS + 1)]
    got = train.select("text").mapInArrow(learn, "gate long, used double, " + ", ".join(f"{c} double" for c in columns)).groupBy("gate").agg(F.sum("used").alias("used"), *[F.sum(c).alias(c) for c in columns]).collect()
    out = np.tile(np.array([0.3] * ORDERS + [0.0], np.float32), (512, 1))
    for r in got:
        if r.used > 0:
            out[r.gate] = [r[c] / r.used for c in columns]
    return out


def score(spark: SparkSession, docs: DataFrame, holdout_mod: int = 7, holdout: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte (of the UTF-8 text), seen_segments (that followed the same segment in another training document)."""
    tune(spark)
    held = residue(holdout_mod) == holdout
    read = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"), held.alias("held_out"))
    train = read.filter(~F.col("held_out"))
    counts = token_counts(spark, train)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # a word of one place teaches what new words are like, so it is spelled
    top = counts.filter("n > 1").orderBy(F.desc("n"), "token").limit(CODES).toArrow()
    words, n = top["token"].to_pylist(), top["n"].to_numpy()
    bits = int(np.clip(math.ceil(math.log2(total + 2)) - 6, LEAST_BITS, MOST_BITS))
    coder = spark.sparkContext.broadcast(Coder(words, n.tolist(), total - int(n.sum()), bits))
    tables = spark.sparkContext.broadcast(context_tables(spark, train, coder))
    weights = spark.sparkContext.broadcast(mixing_weights(train, coder, tables))
    logs = spark.sparkContext.broadcast(np.append(np.log10(n + 1.0), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder.value
        mixer = Mixer(own, tables.value, weights.value)
        row = TaskContext.get().partitionId() << 40
        for words, code, sizes, group, b in _grouped(batches, own):
            cost, names = mixer.read(words, code, sizes)
            starts, n = np.cumsum(sizes) - sizes, len(group)
            doc = np.repeat(np.arange(n), sizes)
            rare = np.flatnonzero(code == own.escape)
            tokens_ = pa.array(np.fromiter((xxhash.xxh64_intdigest(words[i], 42) for i in rare.tolist()), np.uint64, len(rare)).view(np.int64))
            of, before, after, each, followers = segments(cost, names, doc)
            found = pa.StructArray.from_arrays([pa.array(before), pa.array(after), pa.array(each.astype(np.float32)), pa.array(followers.astype(np.int32))], ["before", "after", "bits", "own"])
            n_bytes = [len(b.column("text")[k].as_buffer()) for k in group]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), *(b.column(c).take(pa.array(group)) for c in ("doc_id", "held_out")), pa.array(sizes), pa.array(n_bytes, pa.int64()), pa.array(sizes - np.bincount(doc[rare], minlength=n)), pa.array(np.add.reduceat(logs.value[code], starts)), pa.array(np.add.reduceat(cost, starts)), _lists(tokens_, doc[rare], n), _lists(found, of, n)], shape.names)
            row += len(group)

    long, double = T.LongType(), T.DoubleType()
    pairs = T.ArrayType(T.StructType([T.StructField("before", long), T.StructField("after", long), T.StructField("bits", T.FloatType()), T.StructField("own", T.IntegerType())]))
    shape = T.StructType([T.StructField("row", long), docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *[T.StructField(c, long) for c in ("n_tokens", "n_bytes", "known")], T.StructField("base", double), T.StructField("bits", double), T.StructField("rare", T.ArrayType(long)), T.StructField("pairs", pairs)])
    scored = stored(spark, read.mapInArrow(run, shape), "scored")
    # words beyond the dictionary, by the hash of their name
    others = counts.select(F.xxhash64("token").alias("token"), "n")
    asked = scored.select("row", F.explode("rare").alias("token")).join(others, "token")
    found = asked.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("n_more"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + distinct + 1)
    left = F.col("bits") - F.coalesce("saved", F.lit(0.0))
    return scored.drop("rare", "pairs").join(found, "row", "left").join(_seen_before(spark, scored), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (-left * math.log10(2)).alias("score"), (left / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"), F.coalesce("seen_segments", F.lit(0)).cast("long").alias("seen_segments"))


def _seen_before(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """row, saved (bits), seen_segments: what the decisions on segments change. A document's own pairs are left out of what predicts it."""
    pairs = scored.select("row", "held_out", F.explode("pairs").alias("p")).select("row", "held_out", "p.*")
    learnt = pairs.groupBy("before", "after").agg(F.count_if(~F.col("held_out")).alias("n"), F.count("*").alias("every"))
    # contexts that one document alone has predict nothing
    contexts = learnt.groupBy("before").agg(F.sum("n").alias("total"), F.sum("every").alias("every")).filter("every > 1 and total > 0").select("before", "total")
    contexts = stored(spark, contexts, "contexts")
    known = learnt.join(contexts.select("before"), "before", "left_semi").select("before", "after", "n")
    asked = pairs.join(contexts, "before").join(known, ["before", "after"], "left")
    own = F.when(F.col("held_out"), F.lit(0))
    total = F.col("total") - F.coalesce(own, F.col("own"))
    n = F.coalesce("n", F.lit(0)) - F.coalesce(own, F.lit(1))
    asked = asked.select("row", "held_out", "bits", total.alias("total"), n.alias("n")).filter("total > 0").withColumn("cell", F.least(F.floor(F.log2("total")), F.lit(6)))
    asked = stored(spark, asked, "asked")
    cells = {r.cell: (r.hits, r.misses) for r in asked.filter(~F.col("held_out")).groupBy("cell").agg(F.count_if(F.col("n") > 0).alias("hits"), F.count_if(F.col("n") == 0).alias("misses")).collect()}
    odds = [(x + 0.4) / (x + y + 0.8) for x, y in (cells.get(k, (0, 0)) for k in range(7))]
    p = F.element_at(F.array(*map(F.lit, odds)), F.col("cell").cast("int") + 1)
    saved = F.when(F.col("n") > 0, F.col("bits") + F.log2(p) + F.log2(F.col("n") / F.col("total"))).otherwise(F.log2(1 - p))
    return asked.groupBy("row").agg(F.sum(saved).alias("saved"), F.count_if(F.col("n") > 0).alias("seen_segments"))
