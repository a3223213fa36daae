"""Near-duplicates against every pair that shares a band, and against every pair."""

import random

import numpy as np
import pytest

from lettermill.llm import neardup

SHAPE = "doc_id long, text string, gone string, k long, i long, key long, doc string, band long"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", k, k, k, "y", k) for k, t in enumerate(texts)], SHAPE).repartition(3)


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def changed(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"q{seed}x{k}" if r.random() < share else w for k, w in enumerate(text.split()))


def brute_force(texts, least=neardup.LEAST, sketch=None):
    """Least index of each text's class: all pairs that share a band (sketch None: all pairs) are aligned."""
    read = neardup.Words()
    words = [read(t or "") for t in texts]
    keys = [set(sketch(w).tolist()) for w in words] if sketch else None
    up = list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if (texts[a] or "") == (texts[b] or "") or len(words[a]) and len(words[b]) and (keys is None or keys[a] & keys[b]) and neardup.similar(words[a], words[b], least):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return [top(k) for k in range(len(texts))]


def found(spark, texts):
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, docs(spark, texts)).collect()}
    return [got[k] for k in range(len(texts))]


def families():
    """30 pairs of like texts; all texts share three fifths of their words."""
    common = prose(180, 1)
    out = []
    for k in range(30):
        own = prose(120, 100 + k)
        out += [f"{common} {own}", f"{common} {changed(own, 0.05, k)}"]
    return out


def test_pairs_within_boilerplate_are_all_joined(spark):
    texts = families()
    got = found(spark, texts)
    assert got == brute_force(texts, sketch=neardup.sketch) == [k // 2 * 2 for k in range(60)]


@pytest.mark.parametrize("block", [4, 512])
def test_blocks_of_a_band_are_laid_against_each_other(spark, monkeypatch, block):
    # all texts in all bands, a large class among unlike texts, and a chain whose ends are unlike
    base = prose(100, 5)
    texts = [changed(base, 0.03, k) for k in range(20)] + [prose(100, 200 + k) for k in range(12)]
    chain = [prose(100, 300)]
    for k in range(6):
        words = chain[-1].split()
        chain.append(" ".join([*words[:15 * k], *[f"c{k}x{i}" for i in range(15)], *words[15 * k + 15 :]]))
    texts += chain
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "sketch", lambda words: np.arange(1, neardup.BANDS + 1, dtype=np.uint64))
    assert found(spark, texts) == brute_force(texts)


def test_a_crowded_band_sends_no_text_to_blocks_of_other_sizes(spark, monkeypatch):
    texts = []
    for k in range(16):
        one, other = (prose(int(12 * 1.3**k), 500 + 2 * k + i) for i in (0, 1))
        texts += [one, changed(one, 0.05, k), other]
    # at the edge: 80 words of 100
    texts.append(" ".join(texts[-1].split()[: int(0.8 * len(texts[-1].split()) + 0.999)]))
    sent, settled = [], neardup._settled
    monkeypatch.setattr(neardup, "_settled", lambda rows, least: sent.append(rows.count()) or settled(rows, least))
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "sketch", lambda words: np.arange(1, neardup.BANDS + 1, dtype=np.uint64))
    assert found(spark, texts) == brute_force(texts)
    # 49 texts in 64 bands of a dozen blocks; each text meets the blocks of its own size and of the next ones
    assert sent[-1] < 49 * 64 * 6


def chosen(spark, monkeypatch, texts, sketch):
    """Classes, and the rows that the choice of later bands' members leaves."""
    left, mixed = [], neardup._mixed
    monkeypatch.setattr(neardup, "_mixed", lambda members, least: (lambda got: left.append(got.count()) or got)(mixed(members, least)))
    monkeypatch.setattr(neardup, "sketch", sketch)
    return found(spark, texts), sum(left)


def test_a_large_group_stays_out_of_bands_after_its_last_member_has_joined(spark, monkeypatch):
    # one text shares none of the first four bands with its 40 near ones; each band has another text besides, of three times the size
    base = prose(100, 5)
    texts = [changed(base, 0.02, k) for k in range(41)] + [prose(300, 700 + k) for k in range(64)]
    read = neardup.Words()
    number = {read(t).tobytes(): k for k, t in enumerate(texts)}

    def sketch(words):
        k, keys = number[words.tobytes()], np.arange(1, neardup.BANDS + 1, dtype=np.uint64)
        alone = keys + np.uint64(1000 * (k + 1))
        return np.where(keys == k - 40, keys, alone) if k > 40 else np.where(keys <= 4, alone, keys) if k == 40 else keys

    got, rows = chosen(spark, monkeypatch, texts, sketch)
    assert got == brute_force(texts, sketch=sketch) == [0] * 41 + list(range(41, 105))
    # in 8 bands, not in 60
    assert rows == 8 * len(set(texts[:41]))


def test_bands_of_the_same_texts_are_settled_once(spark, monkeypatch):
    # pairs that share all bands and are not near
    texts = [prose(100, 800 + k) for k in range(20)]
    read = neardup.Words()
    number = {read(t).tobytes(): k for k, t in enumerate(texts)}
    sketch = lambda words: np.arange(1, neardup.BANDS + 1, dtype=np.uint64) + np.uint64(1000 * (number[words.tobytes()] // 2))
    got, rows = chosen(spark, monkeypatch, texts, sketch)
    assert got == list(range(20)) and rows == 0
    # one that is near in the last band alone is found there
    texts[1] = changed(texts[0], 0.02, 1)
    number[read(texts[1]).tobytes()] = 1
    last = lambda words: np.where(np.arange(neardup.BANDS) == neardup.BANDS - 1, sketch(words), np.uint64(1 << 40) + np.uint64(1000 * number[words.tobytes()]) + np.arange(neardup.BANDS, dtype=np.uint64))
    got, rows = chosen(spark, monkeypatch, texts, last)
    assert got == [0, 0, *range(2, 20)] == brute_force(texts, sketch=last) and rows == 20


def test_recall_on_one_large_group(spark):
    base = prose(150, 9)
    texts = [changed(base, 0.01 * (k % 8), k) for k in range(200)] + [prose(150, 400 + k) for k in range(40)]
    want = brute_force(texts)
    got = found(spark, texts)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(texts)
    assert all(got[k] == k for k in range(200, 240))


def test_columns_are_the_edit_distance():
    r = random.Random(3)
    for _ in range(400):
        a = [r.randint(0, r.choice((3, 30))) for _ in range(r.randint(1, 40))]
        b = [x for x in a if r.random() > 0.15] or [1]
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), r.randint(0, 7))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = min(d[i, j] + (a[i] != b[j]), d[i, j + 1] + 1, d[i + 1, j] + 1)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        for most in (max(1, abs(len(a) - len(b))), abs(len(a) - len(b)) + 3, 60):
            assert neardup._columns(x, y, most) == (d[-1, -1] if d[-1, -1] <= most else None)


def test_odd_rows_and_clashing_columns(spark):
    texts = [None, "", " ", "a", "a", "a b", prose(300, 1), prose(300, 1), prose(30_000, 2), changed(prose(30_000, 2), 0.02, 1)]
    assert found(spark, texts) == [0, 0, 2, 3, 3, 5, 6, 6, 8, 8]
    d = docs(spark, texts)
    kept = neardup.keep_one(spark, d.unionByName(d))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5, 6, 8]
    assert neardup.keep_one(spark, d.limit(0)).count() == 0 and neardup.near_duplicates(spark, d.limit(0)).count() == 0
    clash = d.withColumnsRenamed({"gone": "_gone", "k": "_id", "i": "_key"})
    assert neardup.keep_one(spark, clash.unionByName(clash)).columns == clash.columns


def edited(words, share, r):
    """words with a share of them replaced, dropped or followed by a new one."""
    out = []
    for w in words:
        kind = r.choice("rdi") if r.random() < share else ""
        out += [f"n{r.random()}"] if kind == "r" else [] if kind == "d" else [w, f"n{r.random()}"] if kind == "i" else [w]
    return out


def test_recall_from_a_similarity_of_four_fifths(spark):
    r = random.Random(12)
    pairs = []
    for k in range(480):
        words = prose(r.choice([80, 200, 500]), 1000 + k).split()
        words = [f"{w}{k}" for w in words]
        pairs.append((words, edited(words, r.choice([0.03, 0.08, 0.12, 0.16, 0.19]), r)))
    got = found(spark, [" ".join(w) for p in pairs for w in p])
    read, hits = neardup.Words(), {}
    for k, (a, b) in enumerate(pairs):
        x, y = read(" ".join(a)), read(" ".join(b))
        longer = max(len(x), len(y))
        d = neardup.edit_distance_at_most(x, y, int(0.2 * longer + 1e-9))
        joined = got[2 * k] == got[2 * k + 1]
        assert d is not None or not joined
        if d is not None:
            hits.setdefault(min(19, int(20 * (1 - d / longer) + 1e-9)), []).append(joined)
    assert sorted(hits) == [16, 17, 18, 19]
    for step, joined in hits.items():
        assert sum(joined) >= 0.9 * len(joined), (step / 20, sum(joined), len(joined))
