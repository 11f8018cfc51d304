import itertools
import random
from collections import Counter

from stelwerk.llm import packing as P


def test_fullest_against_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        counts = Counter(rnd.randint(1, 30) for _ in range(rnd.randint(1, 9)))
        room = rnd.randint(1, 60)
        items = list(counts.elements())
        best = max((sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room), default=0)
        got = P.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(got) == best and not Counter(got) - counts


def test_every_item_once_and_no_bin_too_full():
    rnd = random.Random(2)
    for cap in (10, 64, 200):
        counts = Counter(min(cap, max(1, int(rnd.expovariate(4 / cap)))) for _ in range(3000))
        bins = P.minimum_bin_slack(dict(counts), cap)
        packed = Counter()
        for combo, times in bins:
            assert sum(n * k for n, k in combo.items()) <= cap
            for n, k in combo.items():
                packed[n] += k * times
        assert packed == counts
        lower = -(-sum(n * c for n, c in counts.items()) // cap)
        assert sum(t for _, t in bins) <= lower + max(1, lower // 100)
    assert P.minimum_bin_slack({}, 10) == []


def test_pack(spark):
    rnd = random.Random(3)
    words = "de wet op het onderzoek naar artikel regeling".split()
    data = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90)))) for i in range(400)]
    data += [(1000, None), (1001, ""), (1002, " \n\t  "), (1003, "lang " * 5000), (1004, data[0][1]), (1, "nog eens")]
    df = spark.createDataFrame([(*d, 5, "x") for d in data], "doc_id bigint, text string, n_tokens int, container string")
    got = P.pack(df, capacity=64).collect()
    enc = P._encoding(P.tokenizer_file())
    want = Counter()
    for i, t in data:
        if t and t.strip():
            want[i] += len(enc.encode_ordinary(t))
    have, fill = Counter(), Counter()
    for r in got:
        have[r.doc_id] += r.n_tokens
        fill[r.container] += r.n_tokens
    assert have == want and max(fill.values()) <= 64
    assert sorted(fill) == list(range(len(fill)))
    alone = [r for r in got if r.doc_id == 1003]
    assert sorted(r.n_tokens for r in alone)[1:] == [64] * (len(alone) - 1)
    assert all(n == 1 for n in Counter((r.doc_id, r.part, r.n_tokens, r.container) for r in got).values())
    assert len(fill) <= -(-sum(want.values()) // 64) * 1.02 + 1
    assert P.pack(df.limit(0)).count() == 0
    same = lambda d: sorted(map(tuple, d.collect()))
    assert same(P.pack(df, capacity=64)) == sorted(map(tuple, got))


def test_blocks_share_one_numbering(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 10)
    df = spark.createDataFrame([(i, "een twee drie") for i in range(97)], "doc_id bigint, text string")
    got = P.pack(df, capacity=16).collect()
    n = got[0].n_tokens
    assert len({r.doc_id for r in got}) == 97 and len({r.container for r in got}) == -(-97 // (16 // n))


def test_running_sums_over_two_levels(spark, monkeypatch):
    monkeypatch.setattr(P, "STRIDE", 3)
    data = [(b, b % 5) for b in range(0, 40, 2)]
    got = dict(map(tuple, P._running(spark.createDataFrame(data, "block int, n bigint")).collect()))
    assert got == {b: sum(n for c, n in data if c < b) for b, _ in data}
