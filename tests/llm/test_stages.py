"""Stages of the pipeline and the operators behind them on odd tables: empty, repeated, null, very long, with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from lettermill.llm import decontaminate, fingerprint, langid, lm, packing, quality, secrets, substrings, toxicity

CLASHING = ("key", "band", "label", "k", "i", "block", "n", "ids", "number", "spans", "score", "held_out", "class_id", "word", "pair", "seed", "at")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


LONG = prose(12_000, 1)
ROWS = [(0, prose(80, 2), "en", "a", 1), (0, prose(80, 2), "en", "a", 1), (1, prose(80, 2), "en", "b", 1), (2, prose(90, 3) + " token=abcdef99", "en", None, None), (3, LONG, "en", "a", 5), (4, None, None, None, None), (None, prose(70, 4), "en", "a", 2), (5, "", "en", "a", 0), (6, "12 34 !", None, "b", 7), (7, prose(75, 5), None, "a", 3), (8, LONG.replace("a", "e", 40), "en", "a", 5)]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    plain = spark.createDataFrame(ROWS, SHAPE).repartition(3)
    wide = plain.select("*", *[F.lit(c).alias(c) for c in CLASHING])
    spark.createDataFrame([(1, prose(75, 5)[:200]), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, plain, wide


def test_stages_on_odd_tables(spark, tables):
    import corpus_pipeline

    at, plain, wide = tables
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain.limit(0), at).count() == 0
        got = stage(spark, wide, at)
        assert got.columns == wide.columns
        rows = got.collect()
        assert all(r[c] == c for r in rows for c in CLASHING)
        kept[name] = sorted((r.doc_id if r.doc_id is not None else -1) for r in rows)
        assert sorted((r.doc_id if r.doc_id is not None else -1) for r in stage(spark, plain, at).collect()) == kept[name]
    assert kept["language"] == [-1, 0, 0, 1, 2, 3, 7, 8]
    # equal rows, equal texts and the two long ones are one class each; an empty and a null text are equal
    assert kept["near_duplicates"] == [-1, 0, 2, 3, 4, 6, 7]
    assert kept["decontamination"] == [-1, 0, 0, 1, 2, 3, 4, 5, 6, 8]
    assert len(kept["secrets"]) == len(ROWS)
    packed = corpus_pipeline.STAGES[-1][1](spark, wide, at).collect()
    assert sum(r.length for r in packed if r.start == 0 or r.start > 0) == sum({(r.doc_id, r.doc_tokens, r.ids_crc32): 0 for r in packed} and [r.length for r in packed])
    assert {r.doc_id for r in packed} == {r[0] for r in ROWS}


def test_operators_on_odd_tables(spark, tables):
    at, plain, wide = tables
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)] + [(0, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.read.parquet(f"{at}/benchmark.parquet")
    each = {
        "lm": lambda d: lm.score(spark, d), "quality": lambda d: quality.classify(spark, d, labels), "fingerprint": lambda d: fingerprint.fingerprint_with_edits(spark, d),
        "toxicity": lambda d: toxicity.classify(spark, d, labels), "substrings": lambda d: substrings.repeated(spark, d), "secrets": lambda d: secrets.digest(secrets.scan(spark, d)), "langid": lambda d: langid.identify(spark, d),
    }
    for name, run in each.items():
        got = run(wide).collect()
        assert len(got) == len(ROWS), name
        assert sorted(map(str, got)) == sorted(map(str, run(plain).collect())), name
        assert run(plain.limit(0)).count() == 0, name
        # repeated rows are treated alike
        twice = [tuple(v for c, v in r.asDict().items() if c not in ("near_next", "near_edited", "edited_sha256", "edited_fingerprint")) for r in got if r.doc_id == 0]
        assert len(twice) == 2 and twice[0] == twice[1], name
    assert decontaminate.overlaps(spark, wide, bench).select("doc_id").distinct().count() == 1
    assert packing.pack(spark, plain.limit(0)).count() == 0
    long = {r.doc_id: r for r in substrings.repeated(spark, plain).collect()}
    assert long[3].n_bytes == len(LONG) and long[3].n_removed > len(LONG) // 2
