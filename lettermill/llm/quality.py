"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow boosted trees are fitted to a bounded sample of labelled rows; each path of a tree is a rule, a
conjunction of thresholds on statistics. A logistic regression with a lasso penalty weighs the rules, most
of them by nothing, and what is left is compiled into one Spark column expression. Statistics and scores
are columns; only the sample's numbers reach the driver.

Defined results: a null or empty text has statistics of zero and is scored by them; with no labelled row, or
labels of one kind, every score is that share (0.5 without any); null labels teach nothing, repeated labels
of a document count as their greatest; repeated rows are scored each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fraction_at_most, residue, texts

#: About so many labelled documents are fitted to, chosen by a hash of their id.
FIT_ROWS = 12_000
TREES, DEPTH, CUTS = 24, 3, 24
LASSO = 2e-3
STATS = ("chars", "words", "word_len", "letters", "upper", "digits", "symbols", "bangs", "bars", "distinct", "repeats", "lines", "line_distinct")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """docs' `keep` columns and STATS of its text column, in JVM expressions."""
    t = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, F.explode(F.array(F.struct(
        F.length(t).alias("n"), F.split(t, r"\s+").alias("w"), F.split(t, "\n").alias("l"),
        F.regexp_count(t, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(t, F.lit(r"\p{Lu}")).alias("upper"), F.regexp_count(t, F.lit(r"[0-9]")).alias("digits"),
        F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()-]")).alias("symbols"), F.regexp_count(t, F.lit(r"[!?]")).alias("bangs"), F.regexp_count(t, F.lit(r"[|#*_=<>{}\[\]]")).alias("bars"))) ).alias("s"))
    s = lambda c: F.col(f"s.{c}").cast("double")
    n = F.greatest(s("n"), F.lit(1.0))
    words = F.size("s.w").cast("double")
    same = F.size(F.filter(F.zip_with(F.slice("s.w", 1, F.greatest(F.size("s.w") - 1, F.lit(0))), F.slice("s.w", 2, F.greatest(F.size("s.w") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    made = {
        "chars": F.log1p(s("n")), "words": F.log1p(words), "word_len": s("n") / words, "letters": s("letters") / n, "upper": s("upper") / F.greatest(s("letters"), F.lit(1.0)), "digits": s("digits") / n, "symbols": s("symbols") / n, "bangs": s("bangs") / words, "bars": s("bars") / n,
        "distinct": F.size(F.array_distinct("s.w")) / words, "repeats": same / words, "lines": F.size("s.l").cast("double"), "line_distinct": F.size(F.array_distinct("s.l")) / F.size("s.l"),
    }
    # an array, exploded, is not merged into what reads it: each statistic is made once
    return base.select(*keep, F.explode(F.array(F.struct(*[made[c].cast("double").alias(c) for c in STATS]))).alias("x")).select(*keep, *[F.col(f"x.{c}").alias(c) for c in STATS])


Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Grows a tree of Newton steps on rows; every node but the root is a rule, the leaves' steps go to out."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, None)
    if depth:
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            at = np.searchsorted(c, x[rows, f], "left")
            gl, hl = (np.cumsum(np.bincount(at, v[rows], len(c) + 1))[:-1] for v in (grad, hess))
            ok = (hl > 2) & (h - hl > 2)
            gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), -1)
            if gain.max() > best[0]:
                best = (gain.max(), (f, float(c[gain.argmax()])))
    if best[1] is None:
        out[rows] = -g / (h + 1)
        return
    f, c = best[1]
    low = x[rows, f] <= c
    for side, part in ((True, rows[low]), (False, rows[~low])):
        longer = (*path, (f, side, c))
        rules.append(longer)
        _tree(x, grad, hess, cuts, part, depth - 1, longer, rules, out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= c) == side for f, side, c in rule])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the rules that the lasso leaves, with their weights."""
    if not len(y):
        return 0.0, []
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return start, []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    # the tails too: what is rare is often telling
    cuts = [np.unique(np.concatenate([c, np.quantile(x[:, f], [0.005, 0.01, 0.02, 0.98, 0.99, 0.995])])) for f, c in enumerate(cuts)]
    score, rules = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _tree(x, p - y, p * (1 - p), cuts, np.arange(len(y)), depth, (), rules, step)
        score += 0.3 * step
    rules = sorted(set(rules))
    if not rules:
        return start, []
    a = np.stack([holds(r, x) for r in rules], 1).astype(np.float32)
    _, first = np.unique(a, axis=1, return_index=True)
    rules, a = [rules[k] for k in sorted(first)], a[:, sorted(first)]
    mean = a.mean(0)
    w, b = _lasso(a - mean, y, lasso, start)
    return b - float(mean @ w), [(r, float(v)) for r, v in zip(rules, w, strict=True) if v]


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the logistic loss with an L1 penalty."""
    n = len(y)
    v = np.ones(a.shape[1], np.float32)
    for _ in range(12):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(np.linalg.norm(a.T @ (a @ v))) / n + 0.25)
    w = z = np.zeros(a.shape[1], np.float32)
    b = zb = start
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ z + zb))) - y
        new = z - rate * (a.T @ r.astype(np.float32)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = zb - rate * float(r.mean())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


def compile_score(start: float, rules: list[tuple[Rule, float]]) -> Column:
    """The ensemble as one column expression over STATS."""
    total = F.lit(start)
    for rule, weight in rules:
        both = reduce(lambda p, q: p & q, [(F.col(STATS[f]) <= c) if side else (F.col(STATS[f]) > c) for f, side, c in rule])
        total = total + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def labelled(docs: DataFrame, labels: DataFrame, label: str, holdout_mod: int, fit_rows: int) -> DataFrame:
    """doc_id, text, y of about fit_rows labelled documents outside the holdout. The sampled labels, so bounded, are broadcast."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (residue(holdout_mod) != 0))
    sample = known.filter(fraction_at_most(known.select("doc_id"), fit_rows)).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", holdout_mod: int = 5, fit_rows: int = FIT_ROWS, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, and the statistics. One pass over the texts without a shuffle, after the fit."""
    got = statistics(labelled(docs, labels, label, holdout_mod, fit_rows), "y").toPandas()
    start, rules = fit_rules(got[list(STATS)].to_numpy(float), got["y"].to_numpy(float))
    score = compile_score(start, rules)
    scored = statistics(texts(docs), "doc_id").select("doc_id", F.explode(F.array(score)).alias("score"), *STATS)
    return scored.select("doc_id", (residue(holdout_mod) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), *STATS)
