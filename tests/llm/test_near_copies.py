import random

import numpy as np
import pyarrow as pa

from lorewright.llm import near_copies
from lorewright.llm.overlap import words


def jaccard_pairs(rows, n, t):
    s = {}
    for k, x in rows:
        w = words(x)
        g = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        if g and k is not None:
            s[k] = g
    ks = sorted(s)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= t}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(3, 90))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(w))
            rng.choice((lambda: w.insert(at, rng.choice(vocab)), lambda: len(w) > 3 and w.pop(at), lambda: w.__setitem__(at, rng.choice(vocab))))()
        if rng.random() < 0.2:
            h = len(w) // 2
            w = w[h:] + w[:h]
        rows.append((i, " ".join(w)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1) for k, t in rows], "key bigint, t string, cls int")


def test_same_pairs_as_brute_force(spark):
    rows = corpus(3)
    got = {tuple(r) for r in near_copies.near_pairs(frame(spark, rows), "key", "t", n=3, t=0.6, bits=8).collect()}
    assert got == jaccard_pairs(rows, 3, 0.6) and got


def test_frequent_tokens_go_through_combinations(spark, monkeypatch):
    rows = corpus(4, 80)
    real = near_copies.class_links
    monkeypatch.setattr(near_copies, "class_links", lambda *a, **k: real(*a, **{**k, "least": 2}))
    got = {tuple(r) for r in near_copies.near_pairs(frame(spark, rows), "key", "t", n=3, t=0.6, bits=12).collect()}
    assert got == jaccard_pairs(rows, 3, 0.6)


def test_long_lists_are_dealt_to_blocks(spark, monkeypatch):
    rows = corpus(7, 80)
    links, entries = near_copies.class_links, near_copies.entries
    monkeypatch.setattr(near_copies, "class_links", lambda *a, **k: links(*a, **{**k, "least": 4}))
    monkeypatch.setattr(near_copies, "entries", lambda *a: entries(*a, block=3))
    got = {tuple(r) for r in near_copies.near_pairs(frame(spark, rows), "key", "t", n=3, t=0.6, bits=12).collect()}
    assert got == jaccard_pairs(rows, 3, 0.6)


def test_a_sequence_that_very_many_texts_share_costs_no_more_than_its_entries():
    n = 100_000
    sig, cls, side = np.full(n, 5), np.arange(n), np.zeros(n, np.int8)
    size = np.sort(np.random.default_rng(0).integers(90, 110, n))
    assert list(near_copies.meetings(sig, cls, size, (0.3 * size).astype(int), side, 0.6)) == []
    few = np.concatenate([np.zeros(3, int), (0.3 * size[3:]).astype(int)])
    assert sum(p.shape[1] for p in near_copies.meetings(sig, cls, size, few, side, 0.6)) < 3 * n


def test_entries_told_twice_and_lists_over_many_batches():
    rng = np.random.default_rng(1)
    e = np.unique(np.stack([rng.integers(0, 3, 400), rng.integers(10, 14, 400), rng.integers(0, 60, 400)], axis=1), axis=0)
    e = np.repeat(e, rng.integers(1, 3, len(e)), axis=0)
    sig, size, cls = e.T
    cols = (sig, cls, size.astype(np.int32), np.ones(len(e), np.int32), np.zeros(len(e), np.int8))
    want = {(min(a[2], b[2]), max(a[2], b[2])) for a in e.tolist() for b in e.tolist() if a[0] == b[0] and a[2] != b[2]}
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sig", "cls", "size", "pos", "side"])
    for step in (7, 1000):
        got = {p for b in near_copies._meet(0.6)(whole.slice(i, step) for i in range(0, len(e), step)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        assert got == want


def test_nulls_short_texts_copies_and_repeats(spark):
    long = " ".join(f"t{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, long.upper()), (3, None), (4, ""), (5, "two words"), (6, long + " more"), (None, long), (7, "two words")]
    pairs = {tuple(r) for r in near_copies.near_pairs(frame(spark, rows), "key", "t", n=3, t=0.6).collect()}
    assert pairs == {(1, 2), (1, 6), (2, 6)}
    g = {r.key: (r.class_id, r.group_id, r.copies, r.links) for r in near_copies.near_groups(frame(spark, rows), "key", "t", n=3, t=0.6).collect()}
    assert g == {1: (1, 1, 2, 1), 2: (1, 1, 2, 1), 6: (6, 1, 1, 1)}
    assert near_copies.near_pairs(frame(spark, rows).limit(0), "key", "t").collect() == []


def test_default_is_five_words_and_four_fifths(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, " ".join([*base[:30], "y", *base[31:]]))]
    got = {tuple(r) for r in near_copies.near_pairs(frame(spark, rows), "key", "t").collect()}
    assert got == jaccard_pairs(rows, 5, 0.8)
