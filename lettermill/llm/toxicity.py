"""Toxicity: a logistic classifier with a counterfactual penalty.

Labelled texts that mention an identity group are copied with its term swapped for another group's; the
penalty is the square of what the swap changes in the score, so a neutral mention of a group cannot carry
weight of its own. Features are words and word beginnings of an exact vocabulary, so none collide. A word's
weight is the sum of its features'; a text's score sums over its distinct words.

Defined results: a null or empty text is scored by the intercept; with no labelled row, or labels of one
kind, every score is that share (0.5 without any); null labels teach nothing, repeated labels of a document
count as their greatest; repeated rows are scored each; an empty table gives no rows; extra columns are
ignored; whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import residue, texts, tune
from .quality import labelled

#: About so many labelled documents are fitted to, and so many of their distinct words at most reach the driver for each.
FIT_ROWS = 12_000
VOCABULARY = 30_000
LEAST_DOCS = 6
#: Features whose chi-square is less tell nothing.
LEAST_CHI = 12.0
LASSO, COUNTERFACTUAL = 3e-4, 4.0
#: Identity terms of the corpus' languages; those of one line stand for one another. A word that two languages share is its first line's.
IDENTITY = (
    "women men girls boys females males",
    "woman man girl boy female male",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "gay lesbian bisexual transgender straight queer",
    "black white asian latino african european",
    "immigrants refugees foreigners natives migrants locals",
    "immigrant refugee foreigner native migrant local",
    "deaf blind disabled autistic",
    # German
    "frauen männer mädchen jungen",
    "frau mann",
    "muslime christen juden hindus buddhisten atheisten",
    "muslimische christliche jüdische hinduistische buddhistische",
    "schwule lesben bisexuelle transsexuelle heterosexuelle",
    "schwarze weiße asiaten afrikaner europäer",
    "einwanderer flüchtlinge ausländer einheimische migranten",
    "gehörlose blinde behinderte autisten",
    # French
    "femmes hommes filles garçons",
    "femme homme fille garçon",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "musulman chrétien juif hindou bouddhiste athée",
    "gays lesbiennes bisexuels transgenres hétérosexuels",
    "noirs blancs asiatiques latinos africains européens",
    "immigrés réfugiés étrangers autochtones migrants",
    "sourds aveugles handicapés autistes",
    # Spanish
    "mujeres hombres niñas niños",
    "mujer hombre niña niño",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "musulmán cristiano judío hindú budista ateo",
    "homosexuales lesbianas bisexuales transexuales heterosexuales",
    "negros blancos asiáticos latinoamericanos africanos europeos",
    "inmigrantes refugiados extranjeros nativos",
    "sordos ciegos discapacitados autistas",
)
_WORD = re.compile(r"[^\W_]+")


class Terms:
    """Lines of terms, each swapped for the next of its line."""

    def __init__(self, lines: tuple[str, ...] = IDENTITY) -> None:
        self.next: dict[str, str] = {}
        for line in lines:
            words = [w for w in line.lower().split() if w not in self.next]
            self.next |= dict(zip(words, words[1:] + words[:1], strict=True)) if len(words) > 1 else {}

    def swap(self, words: set[str]) -> set[str] | None:
        """The words with each identity term replaced by the next of its line; None if there is none."""
        own = words & self.next.keys()
        return (words - own) | {self.next[w] for w in own} if own else None


_TERMS = Terms()
swap = _TERMS.swap


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """The word and its beginnings of 4, 5 and 6 characters, as endings vary."""
    return ["=" + word, *[f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n]]


class _Rows:
    """Sparse rows: features by text, as counts over distinct words."""

    def __init__(self, rows: list[set[str]], known: dict[str, int]) -> None:
        at, col = [], []
        for k, words in enumerate(rows):
            for w in words:
                for f in features(w):
                    if (i := known.get(f)) is not None:
                        at.append(k)
                        col.append(i)
        self.n, self.m = len(rows), len(known)
        self.at, self.col = np.array(at, np.int64), np.array(col, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.col], self.n).astype(float)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.at], self.m).astype(float)


def fit(rows: list[set[str]], y: np.ndarray, lasso: float = LASSO, fair: float = COUNTERFACTUAL, rounds: int = 600, terms: Terms = _TERMS) -> tuple[float, dict[str, float]]:
    """Intercept and weights of features: logistic loss, lasso, and fair times the mean squared change of score under swaps."""
    if not len(y):
        return 0.0, {}
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b = math.log(share / (1 - share))
    if y.min() == y.max():
        return b, {}
    seen, told = Counter(), Counter()
    for words, label in zip(rows, y, strict=True):
        own = {f for w in words for f in features(w)}
        seen.update(own)
        if label:
            told.update(own)
    n, n1 = len(y), float(y.sum())

    def chi(f: str) -> float:
        expect = seen[f] * n1 / n
        return (told[f] - expect) ** 2 / (expect * (1 - seen[f] / (n + 1)) + 1e-9)

    known = sorted((f for f, c in seen.items() if c >= LEAST_DOCS and chi(f) >= LEAST_CHI), key=lambda f: (-chi(f), f))[:VOCABULARY]
    index = {f: k for k, f in enumerate(known)}
    x = _Rows(rows, index)
    pairs = [(r, s) for r in rows if (s := terms.swap(r)) is not None]
    one, two = _Rows([r for r, _ in pairs], index), _Rows([s for _, s in pairs], index)

    def around(w: np.ndarray) -> np.ndarray:
        g = x.back(x.dot(w)) / (4 * n)
        return g + fair * 2 / len(pairs) * (one.back(d := one.dot(w) - two.dot(w)) - two.back(d)) if pairs else g

    v = np.ones(len(known)) / max(1, len(known)) ** 0.5
    for _ in range(20):
        v = around(v)
        v /= np.linalg.norm(v) + 1e-30
    rate = 1 / (float(np.linalg.norm(around(v))) * 1.1 + 0.25)
    # accelerated proximal gradient; the momentum starts anew where it points uphill
    w = z = np.zeros(len(known))
    zb, t = b, 1.0
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-np.clip(x.dot(z) + zb, -30, 30))) - y) / n
        g = x.back(r)
        if pairs:
            change = one.dot(z) - two.dot(z)
            g += fair * 2 / len(pairs) * (one.back(change) - two.back(change))
        new = z - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        nb = zb - rate * float(r.sum())
        if float((z - new) @ (new - w)) > 0:
            t = 1.0
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return b, {f: float(k) for f, k in zip(known, w, strict=True) if k}


def score_words(words: set[str], b: float, weights: dict[str, float], held: dict[str, float]) -> float:
    total = b
    for w in words:
        s = held.get(w)
        if s is None:
            if len(held) > 2_000_000:
                held.clear()
            s = held[w] = sum(weights.get(f, 0.0) for f in features(w))
        total += s
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, total))))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", holdout_mod: int = 5, fit_rows: int = FIT_ROWS, least: float = 0.5, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """doc_id, held_out, score, predicted. One pass over the texts without a shuffle, after the fit. identity: lines of terms that stand for one another."""
    tune(spark)
    sample = labelled(docs, labels, label, holdout_mod, fit_rows).select(F.coalesce("text", F.lit("")).alias("text"), "y")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(words_of(t))) for t in b.column("text").to_pylist()], pa.string()), b.column("y")], ["words", "y"])

    got = sample.mapInArrow(words, "words string, y double").toArrow()
    model = spark.sparkContext.broadcast(fit([set(w.split()) for w in got["words"].to_pylist()], got["y"].to_numpy(), terms=Terms(identity)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (b0, weights), held = model.value, {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([score_words(words_of(t), b0, weights, held) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    docs = texts(docs)
    scored = docs.mapInArrow(score, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", (residue(holdout_mod) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
