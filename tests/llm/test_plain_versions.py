"""Classifiers, secrets, decontamination and odd rows against plain versions, value by value."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import decontaminate, langid, packing, quality, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def learns(k):
    return zlib.crc32(str(k).encode()) % 5 != 0


def plain_statistics(t):
    n, words, lines = len(t), re.split(r"\s+", t), t.split("\n")
    count = lambda p: len(re.findall(p, t))
    return [math.log1p(n), math.log1p(len(words)), n / len(words), count("[a-zA-Z]") / max(n, 1), count("[A-Z]") / max(count("[a-zA-Z]"), 1), count("[0-9]") / max(n, 1), count(r"[^a-zA-Z0-9\s.,;:!?'\"()-]") / max(n, 1), count("[!?]") / len(words), count(r"[|#*_=<>{}\[\]]") / max(n, 1), len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), len(lines), len(set(lines)) / len(lines)]


def test_quality_is_its_rules(spark):
    r = random.Random(1)
    texts = [prose(r.randint(3, 60), k) if k % 3 else " ".join(r.choices(["###", "BUY!", "a", "a", "1_2|3"], k=r.randint(3, 60))) for k in range(150)] + ["", None, "Word", "x\ny\ny"]
    d = spark.createDataFrame([(k, t, 1.0, "z") for k, t in enumerate(texts)], "doc_id long, text string, score double, chars string").repartition(3)
    lab = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(150)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.classify(spark, d, lab).collect()}
    x = np.array([plain_statistics(t or "") for t in texts])
    assert np.allclose([[got[k][c] for c in quality.STATS] for k in range(len(texts))], x)
    known = [k for k in range(150) if learns(k)]
    start, rules = quality.fit_rules(x[known], np.array([float(k % 3 != 0) for k in known]))
    z = start + sum(w * quality.holds(rule, x) for rule, w in rules)
    want = 1 / (1 + np.exp(-z))
    assert rules and [got[k].score for k in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-6)
    assert all(got[k].predicted == (got[k].score >= 0.3) and got[k].held_out == (not learns(k)) for k in got)


def test_toxicity_is_its_weights_and_the_penalty_holds_swaps_down(spark):
    r = random.Random(2)
    # a group is named more often in toxic texts, so a plain fit blames its name
    made = [(prose(12, k), k % 3 == 0) for k in range(300)]
    texts = [f"{t} {'vile' if bad and k % 2 else ''} {r.choice(['women', 'women', 'men']) if bad else r.choice(['men', 'men', 'men', 'women'])}" for k, (t, bad) in enumerate(made)]
    y = np.array([float(bad) for _, bad in made])
    d = spark.createDataFrame([(k, t, "q") for k, t in enumerate([*texts, None, ""])], "doc_id long, text string, words string").repartition(3)
    lab = spark.createDataFrame([(k, int(b)) for k, b in enumerate(y)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.classify(spark, d, lab).collect()}
    known = [k for k in range(300) if learns(k)]
    b, w = toxicity.fit([toxicity.words_of(texts[k]) for k in known], y[known])
    for k, t in enumerate([*texts, "", ""]):
        z = b + sum(w.get(f, 0.0) for x in toxicity.words_of(t) for f in toxicity.features(x))
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4) and got[k].predicted == (got[k].score >= 0.5)

    rows = [toxicity.words_of(t) for t in texts]

    def change(fair):
        b, w = toxicity.fit(rows, y, fair=fair)
        score = lambda words: sum(w.get(f, 0.0) for x in words for f in toxicity.features(x))
        return np.mean([abs(score(s) - score(x)) for x in rows if (s := toxicity.swap(x))])

    assert change(0.0) > 0.5 and change(toxicity.COUNTERFACTUAL) < 0.35 * change(0.0)


ASSIGN = r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def test_base_secrets_are_plain_on_whole_documents(spark):
    odd = ["PASSWORD = 'abcdef'", "token:abc token=abcdefg", "AKIA" + "B" * 16, "api_key=" + "a" * 40, "f" * 23 + " " + "f" * 24, "ſecret=abcdefgh", "passKword=abcdef", None, ""]
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = d.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    for r in secrets.digest(secrets.scan(spark, d)).collect():
        t = texts[r.doc_id]
        spans = [("assign", *m.span()) for m in re.finditer(ASSIGN, t) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("novel")] == (told.split(",") if told else [])


def test_decontamination_is_its_sql(spark, tmp_path):
    item = prose(30, 1).split()
    texts = [prose(40, 2) + " " + " ".join(item[:20]), " ".join(item), " ".join("zz" if k % 7 == 3 else w for k, w in enumerate(item)), "one two three", prose(200, 5), None, "", "É-Tude " + " ".join(item[8:30]).upper(), " ".join(item[5:12])]
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, leak_key string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, "two three"), (3, None), (4, "..."), (5, prose(9, 9)), (6, " ".join(item[:9]))], "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        con.register(name, df.toPandas())
    want = sorted(con.execute(decontaminate.oracle()).fetchall())
    for block in (200_000, 20):
        got = decontaminate.overlaps(spark, d, b, block_seeds=block)
        assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "matched", "item_tokens", "stretch_matched").collect()) == want
    assert {r[:2] for r in want} >= {(0, 1), (1, 1), (2, 1), (3, 2), (7, 1)}
    clean = decontaminate.clean(spark, d.unionByName(d), b)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == sorted(2 * [k for k in range(len(texts)) if k not in {r[0] for r in want}])


def test_language_of_odd_rows(spark):
    d = spark.createDataFrame([(k, t, lang, "x") for k, (t, lang) in enumerate([("abc abc", "a"), ("xyz xyz", "b"), (None, "a"), ("12 !", "b"), ("", None), ("abc", None), ("abcxyz", None)] * 6)], "doc_id long, text string, lang string, lang_pred string")
    for r in langid.identify(spark, d).collect():
        kind = r.doc_id % 7
        assert r.lang_pred == ("und" if kind in (2, 3, 4) else "a" if kind in (0, 5) else r.lang_pred) and 0 <= r.score <= 1
        assert r.held_out == (not learns(r.doc_id))
    assert {r.lang_pred for r in langid.identify(spark, d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pipeline_is_its_stages_in_plain(spark, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    at = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, SF).collect(), d.schema)
    texts = {r.doc_id: r.text for r in at.collect()}
    encode = packing.default_tokenizer()
    assert {r.doc_id for r in rows} == set(texts)
    for k, t in texts.items():
        ids = np.array([*encode.exact.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for r in (r for r in rows if r.doc_id == k):
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in rows if r.doc_id == k) == len(ids)
    # what went is what the operators of the stages report
    leaks = {r.doc_id for r in queries.op7_decontamination(spark, SF).collect()}
    classes = {}
    for r in queries.op6_near_duplicates(spark, SF).collect():
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert not leaks & set(texts) and all(len(set(c) & set(texts)) <= 1 for c in classes.values())
    assert set(texts) == {min(c) for c in classes.values()} - leaks - {r.doc_id for r in d.collect() if not any(x.isalpha() for x in r.text or "")}
