"""Secret scans: three base patterns, then dictionary-primed zstandard novelty.

A candidate is a string of REACH characters at most behind a sensitive word, or behind another candidate of that line,
and every line of a private key block. It is compressed behind a dictionary of the corpus'
identifiers and the code around it. What it still costs, in bytes for each byte of the string, is its
novelty: names, paths and repeated values nearly vanish, random keys stay as they are. What novelty is enough to be
reported depends on how far the string's characters follow one another as in all the corpus' words: new words and names
have to be more novel than random keys. No candidate is left out for its characters; digits alone follow no words
and are asked for more only where they repeat.

Defined results: a null or empty text has no spans; repeated rows are scanned each on their own; an empty
table gives no rows; extra columns are ignored; where spans of two kinds tie they follow the order of KINDS.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, texts, tune

KINDS = ("assign", "access", "hex", "novel")
#: Identifiers in the dictionary, the most frequent of the corpus near candidates.
DICTIONARY_WORDS = 2000
#: Bytes that a candidate costs behind the dictionary, for each byte that it would cost as random text of its alphabet.
LEAST_NOVELTY = 0.8
#: Bits of a character behind the one before it, by the corpus' words: random strings cost more. Each bit less adds STEEP to the novelty asked for.
RANDOM_BITS, STEEP = 5.0, 3.0
#: Digits alone, which follow no words, are asked for more if they have fewer pairs of different kinds by their length.
LEAST_PAIRS = 0.6
#: Bits at most of one character, however rare it is behind the one before it.
MOST_BITS = 8.0
AROUND, REACH = 200, 60
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api_key", "apikey", "credential", "bearer", "private", "auth", "signature", "-----begin")
_HINT = re.compile("passw|secret|token|api_?key|credential|bearer|private|auth|signature|-----begin", re.I | re.A)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----((?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/=]+)+)")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}")
#: Identifiers that code around credentials commonly holds; they come after the corpus' own.
COMMON = "public static final private protected string const config settings client server request response header authorization content type application json export import return function class default value username password secret token key access bearer basic https http example localhost".split()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the base patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower() if text.isascii() else text.casefold()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _candidates(text: str, low: str) -> list[tuple[int, int]]:
    """Spans of candidates, by start."""
    if not any(x in low for x in _HINTS):
        return []
    found: set[tuple[int, int]] = set()
    for hint in _HINT.finditer(text):
        at = hint.end()
        # strings that follow one another on the line, each within reach of the one before
        while (m := _RUN.search(text, at, at + REACH + 16)) and m.start() - at <= REACH and "\n" not in text[at : m.start()]:
            whole = _RUN.match(text, m.start())
            if whole.span() in found:
                break
            found.add(whole.span())
            at = whole.end()
    for block in _BLOCK.finditer(text):
        found.update(m.span() for m in _RUN.finditer(text, block.start(1), block.end(1)))
    return sorted(found)


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its candidates: what is around one is not another."""
    parts, at = [], 0
    for lo, hi in spans:
        parts += [text[at:lo], " " * (hi - lo)]
        at = hi
    return "".join([*parts, text[at:]])


_SIGNS = np.full(256, 36, np.uint16)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _SIGNS[ord(_c)] = _SIGNS[ord(_c.upper())] = _k


def _pair_counts(column: pa.Array) -> np.ndarray:
    """How often each letter or digit stands behind each other one (or behind none), over all texts: 37 x 37."""
    data, _ = flat(column)
    signs = _SIGNS[data]
    return np.bincount(signs[:-1] * np.uint16(37) + signs[1:], minlength=37 * 37) if len(signs) > 1 else np.zeros(37 * 37, np.int64)


class Corpus(NamedTuple):
    """What the corpus tells: words most frequent around candidates, and pairs of characters in all words."""

    words: list[str]
    pairs: list[int]


def identifiers(docs: DataFrame, words: int = DICTIONARY_WORDS) -> Corpus:
    """The words most frequent around candidates in all documents, commonest first, and pairs of characters over all texts. Counts are summed on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        pairs = np.zeros(37 * 37, np.int64)
        for b in batches:
            pairs += _pair_counts(b.column("text"))
            for t in b.column("text").to_pylist():
                spans = _candidates(t, t.lower())
                if spans:
                    around = _blanked(t, spans)
                    for lo, hi in spans:
                        # a candidate's own characters tell nothing of words
                        np.subtract.at(pairs, _pairs(t[lo:hi]), 1)
                        seen.update(_WORD.findall(around[max(0, lo - AROUND) : lo]))
                        seen.update(_WORD.findall(around[hi : hi + AROUND]))
            if len(seen) > 200_000:
                yield _counts(seen)
                seen.clear()
        # a pair's name is no word
        yield _counts(seen + Counter({f"-{k}": int(n) for k, n in enumerate(pairs) if n > 0}))

    got = docs.select("text").mapInArrow(count, "word string, n long").groupBy(F.col("word").startswith("-").alias("pair"), "word").agg(F.sum("n").alias("n"))
    told = {int(r.word[1:]): r.n for r in got.filter("pair").collect()}
    return Corpus([r.word for r in got.filter("NOT pair").orderBy(F.desc("n"), "word").limit(words).collect()], [told.get(k, 0) for k in range(37 * 37)])


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def _pairs(word: str) -> list[int]:
    """Each letter or digit and what comes before it, as places of the pair counts; signs are breaks."""
    signs = [36, *_SIGNS[np.frombuffer(word.encode("ascii", "replace"), np.uint8)].tolist()]
    return [a * 37 + b for a, b in zip(signs, signs[1:], strict=False) if b != 36]


class Novelty:
    """Marginal compressed bytes of a string behind a dictionary and its surroundings."""

    def __init__(self, corpus: Corpus) -> None:
        self.known = " ".join([*COMMON, *reversed(corpus.words)]).encode()
        pairs = np.array(corpus.pairs, float)
        for w in (*COMMON, *corpus.words):
            for p in _pairs(w):
                pairs[p] += 1
        table = pairs.reshape(37, 37)[:, :36]
        # 36 letters and digits, each seen once in five beforehand
        self.cost = np.minimum(MOST_BITS, np.log2((table.sum(1, keepdims=True) + 7.2) / (table + 0.2)))

    def __call__(self, text: str, lo: int, hi: int) -> float:
        # the surroundings come last, where matches are nearest; the string itself is cut out of them
        near = (text[max(0, lo - AROUND) : lo] + "\n" + text[hi : hi + AROUND]).encode("utf-8", "replace")
        packer = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(self.known + b"\n" + near, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        key = text[lo:hi]
        cost = len(packer.compress(key.encode())) - len(packer.compress(b""))
        # random text of the alphabet costs so many bytes
        bits = math.log2(10) if key.isdigit() else 4 if re.fullmatch(r"[0-9a-fA-F]+", key) else 5 if key.upper() == key or key.lower() == key else 6
        return cost / (len(key) * bits / 8)

    def bits(self, key: str) -> float:
        """Bits of a character of key, behind the one before it, by the corpus' words; a pair that comes again costs nothing."""
        pairs = _pairs(key)
        return sum(self.cost[p // 37, p % 37] for p in set(pairs)) / max(len(pairs), 1)

    def enough(self, key: str, least: float) -> float:
        """The novelty from which key is reported."""
        if key.isdigit():
            return least + STEEP * max(0.0, LEAST_PAIRS - len(set(_pairs(key))) / len(key))
        return least + STEEP * max(0.0, RANDOM_BITS - self.bits(key))


def scan_text(text: str, novelty: Novelty, least: float = LEAST_NOVELTY) -> list[tuple[str, int, int]]:
    """All spans by start, then kind; a novel span never overlaps a base one."""
    base = base_spans(text)
    taken = sorted((lo, hi) for _, lo, hi in base)
    for lo, hi in _candidates(text, text.lower()):
        if all(hi <= a or b <= lo for a, b in taken) and novelty(text, lo, hi) >= novelty.enough(text[lo:hi], least):
            base.append(("novel", lo, hi))
    return sorted(base, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(spark: SparkSession, docs: DataFrame, words: int = DICTIONARY_WORDS, least: float = LEAST_NOVELTY) -> DataFrame:
    """doc_id, text, spans (array of kind, start, end, code points, end exclusive), in one pass over the texts after the dictionary's."""
    tune(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = spark.sparkContext.broadcast(identifiers(docs, words))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known.value)
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan_text(t, novelty, least)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(spans, arrow)], ["doc_id", "text", "spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("spans", span)]))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s."""
    as_text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return scanned.select("doc_id", *[kind(k) for k in KINDS[:3]], F.sha2(F.encode(as_text(base), "utf-8"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span replaced by `mark` (overlapping spans by one mark) and n_chars, if there, made right; all rows and columns stay."""
    tune(spark)
    known = spark.sparkContext.broadcast(identifiers(texts(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known.value)
        for b in batches:
            new = []
            for t in b.column("text").to_pylist():
                spans = scan_text(t, novelty) if t else []
                merged: list[list[int]] = []
                for _, lo, hi in spans:
                    if merged and lo < merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                for lo, hi in reversed(merged):
                    t = t[:lo] + mark + t[hi:]
                new.append(t)
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
            if (at := b.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(b.schema.field(at).type):
                old = b.column("n_chars").to_pylist()
                was = [len(x) if x is not None else None for x in new]
                b = b.set_column(at, b.schema.field(at), pa.array([n if o is not None else None for n, o in zip(was, old, strict=True)], b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


