"""Each operator against a plain version, on rows with nulls, empty texts, repeats, an empty table and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import decontaminate, fingerprint, langid, lm, neardup, packing, quality, secrets, substrings, toxicity

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, key long, label string, h string"


def docs(spark, texts, langs=None):
    rows = [(k, t, langs[k] if langs else "en", f"s{k % 2}" if k % 5 else None, len(t or ""), k, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


ODD = [None, "", " ", "a", "12 34", prose(300, 1), prose(300, 1), "é" * 50, prose(3000, 2)]


@pytest.fixture
def odd(spark):
    d = docs(spark, ODD)
    return d.unionByName(d.filter("doc_id = 5")).unionByName(d.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(9)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


def test_odd_and_empty_tables(spark, odd, none, labels):
    bench = spark.createDataFrame([(1, prose(20, 1)), (2, None), (3, "a"), (None, "")], "item_id long, text string")
    n = odd.count()
    for f in (lambda d: lm.score(spark, d), lambda d: quality.classify(spark, d, labels), lambda d: fingerprint.fingerprint_with_edits(spark, d), lambda d: toxicity.classify(spark, d, labels), lambda d: substrings.repeated(spark, d), lambda d: neardup.near_duplicates(spark, d), lambda d: secrets.digest(secrets.scan(spark, d)), lambda d: langid.identify(spark, d)):
        assert f(odd).count() == n
        assert f(none).count() == 0
    assert packing.pack(spark, none).count() == 0 and packing.pack(spark, odd).agg(F.sum("length")).first()[0] > n
    assert decontaminate.overlaps(spark, none, bench).count() == 0
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(spark, odd, bench).collect()} == {(5, 1), (6, 1), (3, 3), (None, 3)}


def test_langid_is_brute_force(spark):
    texts = [prose(30, k) if k % 2 else prose(30, k).translate(str.maketrans("abcdefghij", "klmnopqrst")) for k in range(30)] + [None, "12"]
    langs = ["x" if k % 2 else "y" for k in range(31)] + [None]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark, docs(spark, texts, langs)).collect()}
    learn = [zlib.crc32(str(k).encode()) % 5 != 0 for k in range(len(texts))]
    assert [got[k] for k in range(len(texts))] == langid.brute_force(list(zip(texts, langs, learn, strict=True)))


def test_substrings_are_brute_force(spark):
    a = prose(400, 5)
    texts = [a[:1000] + "|" + prose(50, 6), prose(30, 7) + a[200:900], "x" * 900, "x" * 400, "x" * 399, a[:399], None, "é" * 450, prose(900, 8), prose(900, 8), a[100:550]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeated(spark, docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == substrings.brute_force(texts)


def test_texts_are_not_shuffled_for_replies(spark, monkeypatch):
    monkeypatch.setattr(substrings, "tune", lambda s: s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1"))
    docs = spark.createDataFrame([(k, f"text {k} " * 90) for k in range(6)], "doc_id long, text string").coalesce(1)
    try:
        plan = substrings.repeated(spark, docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # both replies are gathered by chunk; the table of chunks stays as it lies
    assert plan.count("Exchange hashpartitioning(chunk") == 2


def test_whole_documents_are_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = substrings.repeated(spark, d).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    ids = sorted(texts)
    want = dict(zip(ids, substrings.brute_force([texts[k] for k in ids]), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    # every passage of 300 bytes and more that repeats holds a sampled string that repeats
    starts = {}
    for k in ids:
        b = (texts[k] or "").encode()
        for x in {b[i : i + 300] for i in range(max(0, len(b) - 299))} if len(b) >= 400 else ():
            starts.setdefault(x, set()).add(k)
    shared = {k for s in starts.values() if len(s) > 1 for k in s}
    assert shared <= {r.doc_id for r in rows if r.n_shared}
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(b) == r.n_bytes



def test_fingerprints(spark):
    texts = [prose(k * 40 + 1, k) for k in range(12)] + ["", None, prose(41, 1)]
    got = {r.doc_id: r for r in fingerprint.fingerprint_with_edits(spark, docs(spark, texts), 3).collect()}
    n = len(texts)
    for k in range(n):
        own, after = texts[k] or "", texts[(k - 1) % n] or ""
        new = fingerprint.edit(own, after)
        a, e, x = fingerprint.fingerprints([own, new, after])
        assert got[k].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (a.tobytes().hex(), e.tobytes().hex())
        assert got[k].near_next == fingerprint.likeness(a, x) and got[k].near_edited == fingerprint.likeness(a, e)


def test_neighbours_are_exact_for_wide_and_null_ids(spark):
    rows = [((1 << 53) + k, prose(30, k)) for k in range(12)] + [(None, prose(20, 50 + k)) for k in range(6)] + [(5, prose(9, 70)), (5, prose(9, 71)), (-(1 << 63), "least")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1])))
    want = sorted((str(i), hashed(fingerprint.edit(t, order[(k + 1) % len(order)][1]))) for k, (i, t) in enumerate(order))
    for parts in (1, 4, 9):
        assert sorted((str(r.doc_id), r.edited_sha256) for r in fingerprint.fingerprint_with_edits(spark, d, parts).collect()) == want


def test_walk_is_plain():
    stay = fingerprint._stay().reshape(fingerprint.CLASSES, fingerprint.PHASES)
    bits = np.random.default_rng(fingerprint.SEED).random((fingerprint.CLASSES, fingerprint.PHASES)) < 0.5
    texts = [prose(30, k) for k in range(60)] + ["é" * 70, "x"]
    codes, start, length = fingerprint._codes(texts)
    classes = fingerprint._classes(codes)
    after = fingerprint._walk(classes, start, length, np.zeros(len(texts), np.int64))
    for k in (0, 7, 60, 61):
        step = 0
        for i in range(length[k]):
            c = classes[start[k] + i]
            while not bits[c, step % fingerprint.PHASES]:  # the pointer stays until a random one bit
                step += 1
            step += 1
            assert after[start[k] + i] == step
    assert stay.max() < 255


def test_near_pairs_are_brute_force(spark, monkeypatch):
    base = [prose(150, k) for k in range(8)]
    texts = [t if j == 0 else t.replace(" ", f" z{j} ", j) for t in base for j in range(6)] + [base[0], None, ""]
    prints = fingerprint.fingerprints([t or "" for t in texts])
    n = len(base) * 6
    one = [next(a for a in range(n) if (prints[a] == prints[b]).all()) for b in range(n)]  # equal fingerprints are one
    want = {(b, a) for a in range(n) for b in range(a + 1, n) if one[a] == a and one[b] == b and fingerprint.likeness(prints[a], prints[b]) >= 0.8}
    for block in (1024, 5):
        monkeypatch.setattr(fingerprint, "BLOCK_PRINTS", block)
        rows = fingerprint.near_pairs(spark, docs(spark, texts)).collect()
        got = {(r.text_id, r.near_id) for r in rows}
        assert len(rows) == len(got) and got <= want and len(got) >= 0.98 * len(want) > 50


def test_alignment_is_exact():
    r = random.Random(3)
    for _ in range(200):
        a = [r.randint(0, 7) for _ in range(r.randint(0, 25))]
        b = [x for x in a if r.random() > 0.15]
        for _ in range(r.randint(0, 3)):
            b.insert(r.randint(0, len(b)), r.randint(0, 7))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = min(d[i, j] + (a[i] != b[j]), d[i, j + 1] + 1, d[i + 1, j] + 1)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert neardup.similar(x, y) == (d[-1, -1] <= int(0.2 * max(len(a), len(b)) + 1e-9))
        assert neardup.edit_distance_at_most(x, y, 60) == d[-1, -1]


def test_near_duplicates(spark):
    base = prose(200, 9).split()
    copies = [" ".join(base[:k] + ["zzz"] + base[k + 1 :]) for k in range(0, 200, 20)]
    texts = [" ".join(base), *copies, " ".join(base), *[prose(200, 50 + k) for k in range(5)]]
    d = docs(spark, texts)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, d).collect()}
    assert [got[k] for k in range(12)] == [0] * 12 and [got[k] for k in range(12, 17)] == list(range(12, 17))
    assert sorted(r.doc_id for r in neardup.keep_one(spark, d.unionByName(d)).collect()) == [0, 12, 13, 14, 15, 16]


def test_substituted_passages_are_found(spark):
    item = prose(30, 20).split()
    spoilt = [("qqq" if k in (4, 13, 22) else w) for k, w in enumerate(item)]
    texts = [prose(100, 21) + " " + " ".join(spoilt) + " " + prose(40, 22), prose(100, 21), " ".join(item[:9]) + " " + prose(60, 23)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    d = docs(spark, texts)
    got = decontaminate.overlaps(spark, d, bench).collect()
    assert [(r.doc_id, r.item_id, r.matched) for r in got] == [(0, 7, 27)]
    assert sorted(r.doc_id for r in decontaminate.clean(spark, d, bench).collect()) == [1, 2]


def test_secrets(spark):
    texts = ['x password = "hunter22" y', "AKIA" + "A" * 16 + " AKIA1", "deadbeef" * 4, "PassWord:abc", "auth bearer Zk9Xq2Lw8Rt5Vb1Nm4Jh7 end", None]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(spark, docs(spark, texts))).collect()}
    assert [(got[k].n_assign, got[k].n_access, got[k].n_hex) for k in range(6)] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert got[0].spans == "assign:2:22" and got[4].spans == "novel:12:33"
    assert got[2].base_sha256 == hashlib.sha256(b"hex:0:32").hexdigest()
    clean = {r.doc_id: r.text for r in secrets.redact(spark, docs(spark, texts)).collect()}
    assert clean[2] == "[SECRET]" and clean[3] == texts[3] and clean[5] is None


@pytest.mark.parametrize("weights", [None, {"s0": 3, "s1": 1}])
def test_packing_round_trip(spark, weights):
    texts = [prose(k * 31, k) for k in range(25)] + [None, "日本語 テスト"]
    encode = packing.default_tokenizer()
    rows = packing.pack(spark, docs(spark, texts), size=64, weights=weights).collect()
    for k, t in enumerate(texts):
        pieces = sorted((r.start, r) for r in rows if r.doc_id == k)
        ids = encode.exact.encode(t or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(bytes(r.ids) for _, r in pieces), "<u4").tolist() == ids
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for _, r in pieces)
    windows = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == windows.get(r.sequence_id, 0)
        windows[r.sequence_id] = r.offset + r.length
    assert sorted(windows.values())[1:] == [64] * (len(windows) - 1)


def test_fast_ids_are_the_tokenizers(spark):
    encode, r = packing.default_tokenizer(), random.Random(1)
    chars = [chr(c) for c in range(0x250) if packing._PLAIN.fullmatch(chr(c))] + list("‐–—‘’“”…€") + [" ", "\n", "'s"] * 20
    for _ in range(3000):
        t = "".join(r.choices(chars, k=r.randint(1, 20)))
        assert encode.fast.encode_ordinary(t) == encode.exact.encode(t, add_special_tokens=False).ids


def test_classifiers_learn(spark):
    r = random.Random(4)
    bad = [k % 4 == 0 for k in range(400)]
    texts = [prose(40, k) + (" vile" if b else "") + (" women" if k % 3 else " men") for k, b in enumerate(bad)]
    junk = [t.replace(" ", " ### ") if r.random() < 0 or k % 3 == 0 else t for k, t in enumerate(texts)]
    lab = spark.createDataFrame([(k, int(k % 3 != 0), int(b)) for k, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    tox = toxicity.classify(spark, docs(spark, texts), lab).filter("held_out").collect()
    assert all(x.predicted == bad[x.doc_id] for x in tox)
    good = quality.classify(spark, docs(spark, junk), lab).filter("held_out").collect()
    assert all(x.predicted == (x.doc_id % 3 != 0) for x in good)


def test_added_tokens_are_the_plain_tokenizers():
    import public_tokenizers as files
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(files.path("byte_bpe_50k.json")), packing.default_tokenizer()
    for t in ["a <|endoftext|> b", "<|endoftext|>", "日本 <|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", "a b"]:
        assert encode(t) == plain.encode(t, add_special_tokens=False).ids
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]


NATURAL = """The committee discussed international responsibilities and the environmental consequences of transportation, while electronic measurements were recorded throughout the laboratory by experienced engineers who understood the underlying mathematical principles.
Die Geschwindigkeit der Entwicklung begrenzt unsere Verantwortung; wissenschaftliche Untersuchungen bestätigen, dass die Zusammenarbeit zwischen Einrichtungen eine gemeinsame Voraussetzung für nachhaltige Veränderungen ist.
La constitution garantit naturellement les libertés fondamentales, et les gouvernements successifs ont développé des institutions indépendantes pour protéger les citoyens contre les abus administratifs.
Las responsabilidades internacionales requieren una administración transparente, porque las organizaciones independientes investigan constantemente las consecuencias económicas de las decisiones gubernamentales."""
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"base62": LETTERS + LETTERS.upper() + "0123456789", "letters": LETTERS + LETTERS.upper(), "lower": LETTERS, "upper": LETTERS.upper(), "digits": "0123456789", "hex": "0123456789ABCDEF", "base64": LETTERS + LETTERS.upper() + "0123456789+/"}
PLAIN = "electroencephalogram Geschwindigkeitsbegrenzung internationalization anticonstitutionnellement responsabilidades counterrevolutionary Wahrscheinlichkeitsrechnung institutionalisation desproporcionadamente environmentalists Verantwortungsbewusstsein constitutionnellement".split()


@pytest.fixture(scope="module")
def natural(spark):
    return secrets.identifiers(spark.createDataFrame([(NATURAL,)] * 40, "text string").repartition(3))


def test_random_keys_are_novel(natural):
    for corpus in (secrets.Corpus([], [0] * 37 * 37), natural):
        novelty, r = secrets.Novelty(corpus), random.Random(5)
        for name, alphabet in ALPHABETS.items():
            for n in (16, 20, 24, 32, 40):
                keys = ["".join(r.choices(alphabet, k=n)) for _ in range(40)]
                shown = [secrets.scan_text(f"bearer {k} end", novelty) for k in keys]
                assert sum([y[1:] for y in x] == [(7, 7 + n)] for x in shown) >= 38, (name, n, sum(map(bool, shown)))
        for name in ("AuthenticationManagerBuilder", "/usr/local/share/certificates", "a" * 16, "-" * 20, "0" * 16, "authorization_header_content"):
            assert secrets.scan_text(f"auth {name} end", novelty) == []


def test_plain_words_are_no_secrets(natural):
    novelty = secrets.Novelty(natural)
    assert [w for w in PLAIN if len(w) >= 16 and secrets.scan_text(f"the secret {w} of", novelty)] == []


def test_every_key_of_a_line_and_of_a_block(natural):
    novelty, r = secrets.Novelty(natural), random.Random(9)
    key = lambda n: "".join(r.choices(ALPHABETS["base62"], k=n))
    a, b, c, far = key(24), key(30), key(20), key(22)
    text = f"auth {a} and {b}, {c} {'x ' * 40}{far}\n{key(20)}"
    assert [text[lo:hi] for _, lo, hi in secrets.scan_text(text, novelty)] == [a, b, c]
    lines = [key(64) for _ in range(5)] + [key(21) + "=="]
    block = "see\n-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----\nbye"
    assert [block[lo:hi] for _, lo, hi in secrets.scan_text(block, novelty)] == lines
    public = block.replace("RSA PRIVATE", "PUBLIC")
    assert secrets.scan_text(public, novelty) == []
    assert secrets.scan_text(block.replace("\n", "\r\n"), novelty)[0][1] == block.replace("\n", "\r\n").index(lines[0])


def plain_candidates(text):
    """By definition: every run of 16 and more signs that a chain of short gaps leads to from a hint, or that is a line of a private key."""
    runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text) if m.end() - m.start() >= 16]
    found = set()
    for m in re.finditer("passw|secret|token|api_?key|credential|bearer|private|auth|signature|-----begin", text, re.I | re.A):
        at = m.end()
        for lo, hi in runs:
            if lo >= at and lo - at <= 60 and "\n" not in text[at:lo]:
                found.add((lo, hi))
                at = hi
            elif lo >= at:
                break
    return sorted(found)


def test_candidates_are_those_of_the_plain_form():
    r = random.Random(3)
    parts = ["secret", "TOKEN", "auth", " ", " ", "\n", ", ", "x" * 16, "Ab1" * 8, "long words in between ", "=", "é", "private_key_of_someone", "-----BEGIN", "ſecret "]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=r.randint(1, 25)))
        assert secrets._candidates(t, t.lower()) == plain_candidates(t), t


def test_pairs_are_counted_over_whole_texts(spark):
    texts = ["Ab1", "", "é-a", "zz"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = secrets.identifiers(d).pairs
    sign = lambda c: "abcdefghijklmnopqrstuvwxyz0123456789".find(c.lower()) % 37 if c.isascii() and c.isalnum() else 36
    assert got[sign("a") * 37 + sign("b")] == 1 and got[sign("b") * 37 + sign("1")] == 1 and got[sign("z") * 37 + sign("z")] == 1
