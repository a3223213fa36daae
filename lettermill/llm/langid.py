"""Language identification: multinomial naive Bayes over hashed character n-grams.

Defined results: a null text or one without a letter gets `und` and score 0; an empty table or one
without a usable language label gives `und` for every row; ties go to the language that sorts first;
repeated rows are scored each on their own; null languages teach nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fraction_at_most, residue, texts, tune

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
#: About so many labelled documents are learned from, chosen by a hash of their id.
FIT_ROWS = 20_000
MAX_LANGS = 512
#: Tasks that count n-grams; each sends one vector for each language.
COUNT_TASKS = 32
_STEP = 1 << 19


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 32 for all that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        if (c := chr(k)).isalpha():
            out[k] = ord(c.lower()[0])
    return out


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, two blanks before the first and after each, and where each text starts (one more than rows)."""
    rows = column.to_pylist()
    raw = "\n\n" + "".join([x + "\n\n" for x in rows])
    lengths = np.fromiter((len(x) + 2 for x in rows), np.int64, len(rows))
    return _letters()[np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)], np.concatenate([[2], 2 + np.cumsum(lengths)])


def _grams(c: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that ends at each place and whether it holds a letter at its end; the first order-1 places have none."""
    h = c[order - 1 :].astype(np.uint32) * np.uint32(0x9E3779B1)
    for k in range(1, order):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[order - 1 - k : len(c) - k] * np.uint32(0xC2B2AE3D + 2 * k)
    h += np.uint32(0x27D4EB2F) * np.uint32(order)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BUCKET_BITS), (c[order - 1 :] != 32) | ((c[order - 2 : len(c) - 1] != 32) if order > 1 else False)


def fit(spark: SparkSession, train: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (buckets x languages). train: doc_id, text, lang.

    Counts are summed on the executors; one vector of bounded size for each language reaches the driver.
    """
    known = train.filter(F.col("lang").isNotNull())
    # the sample is bounded, so a few tasks count it, and a language's vectors are as few
    sample = known.filter(fraction_at_most(known.select("doc_id"), fit_rows)).select(F.coalesce("text", F.lit("")).alias("text"), "lang").repartition(COUNT_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, rows in pa.Table.from_batches([b]).to_pandas().groupby("lang"):
                c, _ = _codes(pa.array(rows["text"]))
                at = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for order in ORDERS:
                    h, ok = _grams(c, order)
                    h, ok = h[3 - order :], ok[3 - order :]
                    at += np.bincount(h[ok], minlength=1 << BUCKET_BITS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "n": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t["n"].to_pylist())
        return pa.table({"lang": t["lang"][:1].cast(pa.string()), "n": pa.array([total.tobytes()], pa.binary())})

    got = sample.mapInArrow(count, "lang string, n binary").groupBy("lang").applyInArrow(add, "lang string, n binary").limit(MAX_LANGS + 1).collect()
    if len(got) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    got.sort(key=lambda r: r.lang)
    if not got:
        return [], np.zeros((1 << BUCKET_BITS, 0), np.float32)
    n = np.stack([np.frombuffer(r.n, np.int64) for r in got], 1) + 0.5
    return [r.lang for r in got], np.log(n / n.sum(0)).astype(np.float32)


def predict(spark: SparkSession, docs: DataFrame, langs: list[str], weights: np.ndarray) -> DataFrame:
    """docs: doc_id, text. Adds lang_pred, score (posterior of lang_pred) to doc_id, in one pass without a shuffle."""
    if weights.nbytes > 256 << 20:
        raise ValueError("the model is too large to broadcast")
    model = spark.sparkContext.broadcast((langs, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w = model.value
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            c, starts = _codes(b.column("text").fill_null(""))
            total, lettered = np.zeros((n, len(names))), np.zeros(n, bool)
            most = max(ORDERS) - 1
            for lo in range(2, len(c), _STEP):
                hi = min(len(c), lo + _STEP)
                part = c[lo - most : hi]
                first = np.searchsorted(starts, lo, "right") - 1
                last = np.searchsorted(starts, hi, "left")
                cuts = np.maximum(starts[first:last], lo) - lo
                lettered[first:last] |= np.add.reduceat((part[most:] != 32).astype(np.int32), cuts) > 0
                for order in ORDERS if names else ():
                    h, ok = _grams(part, order)
                    h, ok = h[most - order + 1 :], ok[most - order + 1 :]
                    got = w[h]
                    got[~ok] = 0
                    total[first:last] += np.add.reduceat(got, cuts, axis=0)
            if names:
                best = total.argmax(1)
                p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            else:
                best, p = np.zeros(n, int), np.zeros(n)
            pred = [names[k] if ok and names else "und" for k, ok in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.where(lettered, p, 0.0), pa.float64())})

    out = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(score, out)


def identify(spark: SparkSession, docs: DataFrame, holdout_mod: int = 5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows whose crc32 mod holdout_mod is not 0."""
    tune(spark)
    model = fit(spark, docs.filter(residue(holdout_mod) != 0).select("doc_id", "text", "lang"), fit_rows)
    return predict(spark, texts(docs), *model).select("doc_id", (residue(holdout_mod) == 0).alias("held_out"), "lang_pred", "score")


def keep_language(spark: SparkSession, docs: DataFrame, least: float = 0.0, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The documents that language identification accepts, with their columns: a language is found, is wanted (None: any learned one) and its score is at least `least`.

    The model is fitted on docs' own languages. Rows are scored in place, so repeated and null ids need no join.
    """
    tune(spark)
    langs, weights = fit(spark, docs.select("doc_id", "text", "lang"))
    model = spark.sparkContext.broadcast((langs, weights))
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc_id"), "text")
    kept = predict(spark, packed, langs, model.value[1]).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    if wanted is not None:
        kept = kept.filter(F.col("lang_pred").isin(*wanted))
    return kept.select("doc_id.*")


def brute_force(rows: list[tuple[str | None, str | None, bool]]) -> list[str]:
    """Predictions by plain dictionaries, for tests. rows: text, lang, whether to learn from it."""

    def grams(t: str | None) -> list[int]:
        c = [int(_letters()[ord(x)]) for x in "\n\n" + (t or "") + "\n\n"]
        out = []
        for order in ORDERS:
            for i in range(2, len(c)):
                if c[i] != 32 or order > 1 and c[i - 1] != 32:
                    h = c[i] * 0x9E3779B1 & 0xFFFFFFFF
                    for k in range(1, order):
                        h = ((h ^ h >> 15) * 0x85EBCA77 + c[i - k] * (0xC2B2AE3D + 2 * k)) & 0xFFFFFFFF
                    h = h + 0x27D4EB2F * order & 0xFFFFFFFF
                    out.append(((h ^ h >> 13) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - BUCKET_BITS)
        return out

    sums: dict[str, dict[int, int]] = {}
    for t, lang, learn in rows:
        if learn and lang is not None:
            at = sums.setdefault(lang, {})
            for h in grams(t):
                at[h] = at.get(h, 0) + 1
    out = []
    for t, _, _ in rows:
        if not any(x.isalpha() for x in t or "") or not sums:
            out.append("und")
            continue
        score = {k: sum(math.log((v.get(h, 0) + 0.5) / (sum(v.values()) + 0.5 * (1 << BUCKET_BITS))) for h in grams(t)) for k, v in sums.items()}
        out.append(max(sorted(score), key=score.get))
    return out
