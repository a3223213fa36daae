"""The mixed model against a plain, word-by-word version, and what it is for."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettermill.llm import lm


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 5))) for _ in range(n))


def trained(texts):
    """Coder, packed tables and leaf counts of training texts."""
    docs = [lm.tokens(t.encode()) for t in texts]
    counts = {}
    for d in docs:
        for w in d:
            counts[w] = counts.get(w, 0) + 1
    top = sorted(((w, n) for w, n in counts.items() if n > 1), key=lambda x: (-x[1], x[0]))
    coder = lm.Coder([w for w, _ in top], [n for _, n in top], sum(n for n in counts.values() if n == 1), lm.LEAST_BITS)
    r = np.random.default_rng(1)
    tables = (r.integers(0, 90, (int(coder.first[-1]), lm.LEAVES)) << 8 | r.integers(0, 90, (int(coder.first[-1]), lm.LEAVES))).astype(np.uint16)
    return coder, tables


def plain_bits(coder, tables, weights, words):
    """One document, decision by decision."""
    code = coder.code(words)
    names = lm._names(coder, words, code)
    cls, rows = coder.classes(code, names, np.arange(len(words)) == 0)
    value = lambda x: (lm._VALUE[int(x) >> 8], lm._VALUE[int(x) & 255])
    level = lambda n: sum(n >= x for x in (1, 4, 48))
    size = max(lm.BLOCK, -(-len(words) // 32))
    own, offset, bits = {}, [0.0] * (lm.ORDERS + 1), []

    def decide(inputs, spelled, bit, off):
        gate = spelled
        for a, b in inputs:
            gate = gate << 2 | level(a + b)
        x = [math.log((b + 0.3) / (a + 0.3)) for a, b in inputs] + [1.0]
        z = sum((weights[gate, k] + off[k]) * x[k] for k in range(lm.ORDERS + 1))
        z = max(-14, min(14, -z if bit else z))  # logit of the other bit
        wrong = math.exp(z) / (1 + math.exp(z))
        return math.log2(1 + math.exp(z)), [(wrong if bit else -wrong) * v for v in x]

    for lo in range(0, len(words), size):
        steps, seen = [], []
        for i in range(lo, min(len(words), lo + size)):
            total = coder.within[code[i]]
            _, nodes, ones = coder.trees[0].path(cls[i : i + 1])
            for node, bit in zip(nodes.tolist(), ones.tolist(), strict=True):
                inputs = [(own.get((node, 0), 0), own.get((node, 1), 0)), *[value(tables[r[i], node]) for r in rows]]
                cost, step = decide(inputs, 0, bit, offset)
                total += cost
                steps.append(step)
                seen.append((node, bit))
            bits.append(total)
        offset = [o + lm.RATE * sum(s[k] for s in steps) / len(steps) for k, o in enumerate(offset)]
        for x in seen:
            own[x] = own.get(x, 0) + 1
    had, n = [], 0
    for i in np.flatnonzero(code == coder.escape).tolist():
        p = (n - len(had) + 0.2) / (n + 1.2)
        n += 1
        if words[i] in had:
            bits[i] += -math.log2(p) + math.log2(len(had))
            continue
        bits[i] += -math.log2(1 - p) if n > 1 else 0
        had.append(words[i])
        leaf, _, at = coder.letters([words[i]], np.array([cls[i - 1] if i else lm.CLASSES - 1]))
        for k, x in enumerate(leaf.tolist()):
            _, nodes, ones = coder.trees[1].path(leaf[k : k + 1])
            for node, bit in zip(nodes.tolist(), ones.tolist(), strict=True):
                bits[i] += decide([value(tables[r[k], node]) for r in at], 1, bit, [0.0] * (lm.ORDERS + 1))[0]
            bits[i] += coder.spill if x == lm.LEAVES - 1 else 0
    return np.array(bits)


def test_bits_are_plain():
    coder, tables = trained([prose(400, k) for k in range(4)])
    weights = np.random.default_rng(2).normal(0.3, 0.2, (512, lm.ORDERS + 1)).astype(np.float32)
    texts = [prose(70, 1) + " été zzqq zzqq " + prose(40, 90), "", "a", "zz zz zz yy zz", prose(100, 3)]
    docs = [lm.tokens(t.encode()) for t in texts]
    words = [w for d in docs for w in d]
    got, _ = lm.Mixer(coder, tables, weights).read(words, coder.code(words), np.array([len(d) for d in docs]))
    want = np.concatenate([plain_bits(coder, tables, weights, d) for d in docs])
    assert got == pytest.approx(want, rel=1e-3)


def test_words_are_split_and_coded_by_columns():
    texts = ["", " ", "A b\tC\n\n d ", "x", "É a b\x0b\x0cZ", "\n\nq", "a  b", "a\x1cb\x00 c \x85d"]
    want = [lm.tokens(t.encode()) for t in texts]
    column = pa.array([t.encode() for t in texts])
    for lo, hi in ((0, 8), (2, 5), (3, 3)):
        flat, is_word, sizes = lm.split(column[lo:hi])
        assert flat.cast(pa.large_binary()).take(pa.array(is_word)).to_pylist() == [w for d in want[lo:hi] for w in d[:-1]] and sizes.tolist() == [len(d) - 1 for d in want[lo:hi]]
    coder = lm.Coder([b"", b"a", b"b"], [8, 4, 4], 9, lm.LEAST_BITS)
    seen = []
    for words, code, sizes, group, _ in lm._grouped(iter([pa.RecordBatch.from_pydict({"text": column})]), coder):
        plain = [w for k in group for w in want[k]]
        assert (code == coder.code(plain)).all() and sizes.tolist() == [len(want[k]) for k in group]
        # a word of the dictionary is a number alone
        assert list(words) == [None if w in coder.codes else w for w in plain]
        seen += group
    assert sorted(seen) == list(range(8))


def test_classes_and_words_are_a_distribution():
    coder, _ = trained([prose(500, 1)])
    mass = sum(2.0 ** -coder.within[k] for k in range(coder.escape) if coder.cls[k] == coder.cls[0])
    assert mass == pytest.approx(1) and all(len(set(t.node.tolist())) == lm.LEAVES - 1 for t in coder.trees[1:])
    for t in coder.trees:
        assert sum(2.0 ** -int(n) for n in t.length) == pytest.approx(1)


def test_counts_keep_their_ratio_and_do_not_depend_on_partitions(spark):
    q = lm._quantised(np.array([[5_000_000, 300_000], [70, 3], [1 << 40, 1 << 39], [200_000, 9]]))
    logit = lm._logits()[0]
    for (a, b), n in zip(q, [(5e6, 3e5), (70, 3), (2.0, 1.0), (2e5, 9)], strict=True):
        assert logit[int(a) << 8 | int(b)] == pytest.approx(np.log(n[1] / n[0]), abs=0.15)
    texts = [(prose(200, k).encode(),) for k in range(40)] + [(b"a " * 70_000,)]
    coder = lm.Coder([b"a", b"", b"ab"], [140_000, 41, 9], 5000, lm.LEAST_BITS)
    d = spark.createDataFrame(texts, "text binary")
    one, many = (lm.context_tables(spark, d.repartition(n), spark.sparkContext.broadcast(coder)) for n in (1, 7))
    assert (one == many).all() and max(lm._VALUE[one >> 8].max(), lm._VALUE[one & 255].max()) > 65_536


def test_weights_are_learned_from_all_training_documents(spark):
    train = spark.createDataFrame([(k, f"the cat{k % 7} sat on mat{k % 11} and x{k}".encode()) for k in range(1200)], "doc_id long, text binary").coalesce(1)
    words = [b"", b"the", b"sat", b"on", b"and"]
    coder = spark.sparkContext.broadcast(lm.Coder(words, [1200] * 5, 4000, 8))
    tables = spark.sparkContext.broadcast(lm.context_tables(spark, train, coder))
    whole = lm.mixing_weights(train, coder, tables)
    # a third by the hash that once chose
    third = train.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), F.lit(1 << 30)) < F.lit((1 << 30) // 3))
    assert not np.allclose(whole, lm.mixing_weights(third, coder, tables))
    # the last documents count too
    assert not np.allclose(whole, lm.mixing_weights(train.filter("doc_id < 1199"), coder, tables), atol=0, rtol=0)


def test_copies_are_told_apart_and_base_is_plain(spark):
    texts = [prose(300, k) for k in range(40)]
    texts += texts[:10] + [None, ""]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    counts, held = {}, {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))}
    for k, t in rows:
        for w in [*(t or "").split(), ""] if not held[k] else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for k, t in rows:
        words = [*(t or "").split(), ""]
        assert got[k].base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words))
        assert (got[k].n_known, got[k].n_tokens, got[k].train_tokens, got[k].held_out) == (sum(w in counts for w in words), len(words), n, held[k])
        assert got[k].score <= 0
    copied = [k for k in range(10) if not held[k + 40]] + [k for k in range(40, 50) if not held[k - 40]]
    alone = [k for k in range(10, 40)]
    assert max(got[k].bits_per_byte for k in copied) < min(got[k].bits_per_byte for k in alone)
    assert all(got[k].seen_segments > 3 for k in copied) and not any(got[k].seen_segments for k in alone)


def test_held_out_documents_are_likelier_than_by_single_words(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(spark, d).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b * 0.98
