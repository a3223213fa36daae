"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import types as T

from lettermill.llm import align, bands, queries, repair

SF = "/root/testdata/sf0.001"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


ODD = [None, "", " \n\t ", "a", "x y z w\x1cv", "la " * 9, "la " * 8, "la " * 400, "é€𝄞 ▁ <|endoftext|> <s> \0 ​", "#*$%&|<> " * 30, "one\ntwo\none \none\n\n \n", prose(30), prose(30), prose(4000, 2), prose(900, 3) + "\n" + "same line\n" * 2000, prose(60000, 5), "🙂" * 3000, "ab" * 40000]


def odd_docs(spark):
    rows = [(k, t, "x", 1.0, "kept") for k, t in enumerate(ODD)] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score double, kept string").repartition(3)


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)


# --- quality rules ---
def plain_rules(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(k, k + 8))
    seen, lines = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def plain_verdict(text):
    c, data = zstandard.ZstdCompressor(level=3), (text or "").encode()

    def bad(part):
        low, high = [x[1:] for x in bands.LIMITS if x[0] <= len(part)][-1]
        return not low <= len(c.compress(part)) / len(part) <= high

    parts = [data[k : k + 4096] for k in range(0, len(data), 4096)] if len(data) > 4096 else []
    return not plain_rules(text)[-1] and not bad(data) and 4 * sum(len(p) for p in parts if bad(p)) <= len(data)


def test_rules_are_the_plain_ones(spark):
    got = {r.doc_id: r for r in bands.judge(spark, odd_docs(spark)).collect()}
    assert len(got) == len(ODD) + 1
    for k, t in enumerate(ODD):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(t), k
        assert r.kept == plain_verdict(t), k
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_quality_rules(spark, SF).collect()}
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(d.text)
        assert r.kept == plain_verdict(d.text)


def test_bands_reject_repeats_and_noise_and_keep_prose(spark):
    r = random.Random(4)
    noise = lambda n: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    broken = " ".join(noise(9) for _ in range(1500))
    near = "\n".join(f"Row {k}: value unchanged since {k} days" for k in range(400))
    texts = {0: prose(600, 7), 1: broken, 2: near, 3: prose(3000, 1) + "\n" + broken, 4: prose(9000, 2) + "\n" + noise(2000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    judged = {x.doc_id: x for x in bands.judge(spark, docs).collect()}
    assert {k: v.kept for k, v in judged.items()} == {0: True, 1: False, 2: False, 3: False, 4: True}
    assert not any(v.base_failed for v in judged.values())
    assert judged[3].bad_chunk_bytes > 4096 and judged[4].n_chunks > 5
    assert {x.doc_id for x in bands.keep(spark, docs).collect()} == {0, 4}


def test_rules_of_labelled_and_odd_rows(spark):
    assert bands.judge(spark, empty(spark)).count() == 0 == bands.keep(spark, empty(spark)).count()
    kept = bands.keep(spark, odd_docs(spark))
    assert kept.columns == ["doc_id", "text", "n_words", "score", "kept"]
    twice = odd_docs(spark).union(odd_docs(spark))
    assert bands.judge(spark, twice).count() == 2 * (len(ODD) + 1)
    # documents that are marked good and hold enough words stay
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    good = bands.judge(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").filter("n_words >= 20")
    assert good.filter("NOT kept").count() <= 0.01 * good.count()


# --- alignment ---
def plain_alignment(texts):
    """Rows by the definition: common end offsets, pairs by comparing every end."""
    a, b = align.default_pair()
    bytes_a, bytes_b = a.pieces(), b.pieces()
    rows, often = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        ids = (a.exact.encode(" " + t, add_special_tokens=False).ids, b.model.encode(t)) if t else ([], [])
        if not t or any(b"".join(p[i] for i in x) != whole for p, x in zip((bytes_a, bytes_b), ids)):
            rows.append((0, 0, 0, [], ""))
            continue
        ends = [list(np.cumsum([len(p[i]) for i in x])) for p, x in zip((bytes_a, bytes_b), ids)]
        both = sorted(set(ends[0]) & set(ends[1]))
        at = [{e: k for k, e in enumerate(x)} for x in ends]
        links = [(ids[0][at[0][e]], ids[1][at[1][e]]) for e in both]
        groups, done = [], (0, 0)
        for e in both:
            upto = tuple(x[e] + 1 for x in at)
            groups.append("|".join(",".join(map(str, ids[k][done[k] : upto[k]])) for k in (0, 1)))
            done = upto
        often.update(links)
        rows.append((len(ids[0]), len(ids[1]), len(both), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, j), n in often.items():
        most[j] = max(most[j], n)
    return [(n_a, n_b, n, len(links), sum(often[x] == most[x[1]] for x in links), sum(often[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if n_a else "") for n_a, n_b, n, links, g in rows]


def _alignment(spark, df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.align(spark, df).collect()}


def test_alignment_is_the_plain_one(spark):
    texts = [*ODD[:13], *ODD[16:17], "the the the", "Straße, naïve café", "a\r\nb  c\t", "▁", " lead", "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got, want = _alignment(spark, df), plain_alignment(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert got[0] == (0, 0, 0, 0, 0, 0, "") and got[14][0] > 0


def test_alignment_of_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op11_token_alignment(spark, SF).collect()}
    assert [got[k] for k, _ in docs] == plain_alignment([t for _, t in docs])


def test_alignment_of_odd_tables(spark, monkeypatch):
    assert align.align(spark, empty(spark)).count() == 0
    assert align.pair_table(spark, empty(spark)).count() == 0
    rows = spark.createDataFrame([(1, "one two", "q"), (1, "one two", "r"), (None, "one two", None)], "doc_id int, text string, n_a string")
    got = align.align(spark, rows, with_groups=True)
    assert got.schema["doc_id"].dataType == T.IntegerType() and "groups" in got.columns
    got = got.collect()
    assert len(got) == 3 and len({r[1:] for r in got}) == 1 and got[0].count_sum == 3 * got[0].n_links and got[0].n_best == got[0].n_links
    # counts that are handed on in several parts add up to the same
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {(r.a, r.b): r.n for r in align.pair_table(spark, docs).collect()}
    monkeypatch.setattr(align, "HELD", 500)
    assert {(r.a, r.b): r.n for r in align.pair_table(spark, docs).collect()} == whole
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = align.write_shards(spark, align.partial_counts(align.stored(spark, align.tokenised(docs), "links")).repartition(7))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    look = align.counts(spark, shards, 32000)
    keys = np.array(sorted(b << 32 | a for a, b in whole), np.int64)
    assert look(keys).tolist() == [whole[k & 0xFFFFFFFF, k >> 32] for k in keys.tolist()] and len(look.names) > 1


# --- conversations ---
def plain_repair(rows):
    """Least edits by trying every state and every insertion, over rows of one conversation after damage, in order."""
    first, seen, faults = [], set(), Counter()
    for role, text in rows:
        kept = text.rstrip(BLANKS)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        first.append(fault)
    best = {"n": (0, "", ())}

    def settle(ways):
        for _ in range(3):
            for state, to in (("n", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                if state in ways:
                    c, audit, out = ways[state]
                    new = (c + 3, audit + "I", (*out, ("user" if to == "u" else "assistant") + ":"))
                    if to not in ways or new[:2] < ways[to][:2]:
                        ways[to] = new
        return ways

    best = settle(best)
    for (role, text), fault in zip(rows, first, strict=True):
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for state, (c, audit, out) in best.items():
            offer(state, (c + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if role[:1] == "s" and state == "n":
                offer("s", (c + extra, audit + "K", (*out, f"{role}:{text}")))
            to = "a" if state == "u" else "u"
            if role[:1] == to:
                offer(to, (c + extra, audit + "K", (*out, f"{role}:{text}")))
            else:
                offer(to, (c + extra + 3, audit + "R", (*out, ("user" if to == "u" else "assistant") + f":{text}")))
        best = settle(new)
    cost, audit, out = min((best[s] for s in "na" if s in best), key=lambda w: w[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_conversations(rows):
    """rows: (conv_id, turn, role, text) before damage."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    done = {}
    for conv, turns in out.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        done[conv] = (gaps, *plain_repair([x[1:] for x in turns]))
    return done


def _repaired(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def random_conversations(seed, n, most):
    r = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(r.randint(1, most)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "über"])
            text = r.choice(["Yes.", "No.", "", " \t", None, "cut", "Why? ", "é!\n", "long " * 50 + ".", f"t{r.randint(0, 3)}."])
            rows.append((conv, r.choice([turn, turn * 2, None, turn + 1, 5]), role, text))
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_repair_is_the_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", 2 if block == 4 else 64)
    rows = random_conversations(block, 40, 12) + [(999, k, r, "Fine.") for k, r in enumerate(["user", "assistant"] * 30)] + [(998, None, "user", "Twin.")] * 25
    df = spark.createDataFrame([(*x, "q") for x in rows], "conv_id long, turn long, role string, text string, cost string").repartition(5)
    got = _repaired(repair.digest(spark, repair.damage(df)))
    assert got == plain_conversations(rows)


def test_repair_of_a_table_and_of_small_ones(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _repaired(queries.op13_conversation_repair(spark, "/root/testdata/sf0.01")) == plain_conversations(rows)
    schema = "conv_id long, turn long, role string, text string"
    assert repair.digest(spark, repair.damage(empty(spark, schema))).count() == 0
    # a conversation whose only row is dropped
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = _repaired(repair.digest(spark, repair.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    whole = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 > 4)
    turns = repair.repaired(spark, repair.damage(spark.createDataFrame([(whole, 1, "assistant", "Hi.")], schema))).collect()
    assert [(x.role, x.text) for t in turns for x in t.turns] == [("user", ""), ("assistant", "Hi.")]
