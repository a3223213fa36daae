"""Packing: every token in one place, windows full, and each source's share of every stretch of windows."""

import random
import zlib

import numpy as np
import pytest

from lettermill.llm import packing

SHAPE = "doc_id long, text string, source string, block long, number long, n long, at long"


def plain():
    """A tokenizer that gives one id for each character."""

    def make():
        return lambda text: [ord(c) % 50_000 + 2 for c in text]

    return make


def rows(spark, made):
    return spark.createDataFrame([(k, t, s, 1, 2, 3, 4) for k, (t, s) in enumerate(made)], SHAPE).repartition(3)


def windows(pieces, size):
    out = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        at = out.setdefault(r.sequence_id, [])
        assert r.offset == sum(n for _, n in at) and r.length > 0
        at.append((r.source, r.length))
    sizes = [sum(n for _, n in out[k]) for k in sorted(out)]
    assert sorted(out) == list(range(len(out))) and set(sizes[:-1]) <= {size} and 0 < sizes[-1] <= size
    return [out[k] for k in sorted(out)]


def whole(pieces, made):
    for k, (t, _) in enumerate(made):
        ids = [*plain()()(t or ""), 1]
        own = sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == ids
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)


def share(stretch, source):
    return sum(n for w in stretch for s, n in w if s == source) / sum(n for w in stretch for _, n in w)


def test_windows_hold_the_mixture_with_a_tiny_source(spark):
    r = random.Random(1)
    made = [("a" * r.randint(1, 9000), "big" if k % 3 else "mid") for k in range(150)] + [("t" * 11, "tiny") for k in range(10)] + [("n" * 9, None), (None, "big"), ("", "mid")]
    r.shuffle(made)
    got = packing.pack(spark, rows(spark, made), make_tokenizer=plain()).collect()
    whole(got, made)
    full = windows(got, packing.SEQUENCE)
    total = sum(len(t or "") + 1 for t, _ in made)
    assert sum(len(t) + 1 for t, s in made if s == "tiny") * 5000 < total
    for s in ("big", "mid"):
        wanted = sum(len(t or "") + 1 for t, x in made if x == s) / total
        assert all(abs(share([w], s) - wanted) < 0.1 for w in full[:-1])
    # the tiny source gives a quantum at a time, spread over all windows
    assert [k * 2 // len(full) for k, w in enumerate(full) if share([w], "tiny")] in ([0, 1], [0, 0, 1, 1])


def test_weights_hold_for_sources_of_any_size(spark):
    made = [("a" * 4000, "big") for k in range(100)] + [("m" * 2500, "mid") for k in range(40)] + [("t" * 99, "tiny") for k in range(8)]
    got = packing.pack(spark, rows(spark, made), weights={"big": 900, "mid": 50, "tiny": 50}, make_tokenizer=plain()).collect()
    whole(got, made)
    full = windows(got, packing.SEQUENCE)
    # tiny gives a twentieth of each window until it is empty
    assert all(abs(share([w], s) - n) < 0.01 for w in full[:7] for s, n in (("big", 0.9), ("mid", 0.05), ("tiny", 0.05)))
    assert not any(share([w], "tiny") for w in full[9:])


def test_many_sources_share_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "SOURCES", 3)
    monkeypatch.setattr(packing, "REST", 2)
    made = [("x" * (7 * k), f"s{k % 40}") for k in range(200)]
    got = packing.pack(spark, rows(spark, made), size=128, make_tokenizer=plain()).collect()
    whole(got, made)
    windows(got, 128)


@pytest.mark.parametrize("totals", [[100_000, 7], [3, 5, 2], [1000] * 1100, [10**6, 1, 1, 1, 700, 10**4], [5]])
def test_places_are_each_taken_once(totals):
    phases = packing.plan(totals)
    size, taken = 256, []
    for k, n in enumerate(totals):
        for lo in range(0, n, 5000):
            hi = min(n, lo + 5000)
            cut, w, off = packing.place(k, lo, hi, phases, size)
            ends = np.append(cut[1:], hi)
            assert cut[0] == lo and (ends > cut).all()
            taken += [np.arange(a, b) for a, b in zip((w * size + off).tolist(), (w * size + off + ends - cut).tolist(), strict=True)]
    assert np.array_equal(np.sort(np.concatenate(taken)), np.arange(sum(totals)))
