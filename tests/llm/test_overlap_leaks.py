import random

import numpy as np

from lorewright.llm import leaks, overlap
from lorewright.llm.overlap import words


def records(seed, n=150):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(15)], [f"r{i}" for i in range(200)]
    base = [rng.sample(common, 7) + rng.sample(rare, 4) for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(rare)
        rng.shuffle(w)
        out.append((i, rng.random() < 0.6, " ".join(w)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, tr, t, "dev") for k, tr, t in rows], "record_id bigint, train boolean, text string, cls string")


def brute(rows, t=0.75):
    s = [(k, tr, set(words(x))) for k, tr, x in rows if k is not None and tr is not None and words(x)]
    return {(a, b) for a, ta, x in s if not ta for b, tb, y in s if tb and len(x & y) / len(x | y) >= t}


def test_same_pairs_as_brute_force(spark):
    rows = records(5)
    got = {(r.eval_id, r.train_id) for r in overlap.cross_split_overlaps(frame(spark, rows), bits=8).collect()}
    assert got == brute(rows) and got


def test_many_shards_and_blocks(spark, monkeypatch):
    rows = records(6)
    real = overlap.class_overlaps
    monkeypatch.setattr(overlap, "class_overlaps", lambda e, r, t: real(e, r, t, per_shard=20, per_block=10))
    got = {(r.eval_id, r.train_id) for r in overlap.cross_split_overlaps(frame(spark, rows), bits=8).collect()}
    assert got == brute(rows)


def test_nulls_copies_and_coverage(spark):
    rows = [(1, False, "Alpha beta gamma delta"), (2, True, "delta, GAMMA beta alpha!"), (2, True, "delta, GAMMA beta alpha!"), (3, True, None), (4, False, ""), (5, None, "alpha beta gamma delta"), (None, True, "alpha beta gamma delta"), (6, True, "alpha beta gamma delta epsilon"), (7, False, "为什么"), (8, True, "为什么！")]
    got = {(r.eval_id, r.train_id): (round(r.coverage, 3), round(r.jaccard, 3)) for r in overlap.cross_split_overlaps(frame(spark, rows)).collect()}
    assert got == {(1, 2): (0.0, 1.0), (1, 6): (1.0, 0.8), (7, 8): (1.0, 1.0)}  # 2 has the words in another order
    assert overlap.cross_split_overlaps(frame(spark, rows).limit(0)).collect() == []
    assert overlap.cross_split_overlaps(frame(spark, [(1, True, "a b")])).collect() == []


def test_matched_intervals_are_merged():
    p = overlap.Passages(["a b c d e f", "c d", "x y z"])
    text = "q a b c d q q e f x y z"
    found = p.scan(text)
    assert [(a, z) for a, z, r in found if r in p.runs[0]] == [(1, 3), (2, 4)] and [(a, z) for a, z, r in found if r in p.runs[1]] == [(3, 4)]
    assert [p.coverage(e, found, text.split(" ")) for e in range(3)] == [4 / 6, 1.0, 1.0]
    assert p.scan("") == [] and overlap.Passages([]).sets == []


def test_hot_word_is_dealt_to_cells(spark, monkeypatch):
    rows = [(i, i % 2 == 0, f"hot a{i // 8} b{i // 8} c{i // 8}") for i in range(120)]
    real = overlap.class_overlaps
    monkeypatch.setattr(overlap, "class_overlaps", lambda e, r, t: real(e, r, t, per_shard=10_000, per_block=4))
    got = {(r.eval_id, r.train_id) for r in overlap.cross_split_overlaps(frame(spark, rows), bits=8).collect()}
    assert got == brute(rows) and len(got) == 15 * 16


def test_split_names(spark):
    a = spark.createDataFrame([(1, "s", " Train\t", "q"), (2, "s", "DEV", "q"), (3, "s", None, "q"), (4, "s", "other", "q")], "question_id bigint, source string, split string, question string")
    b = spark.createDataFrame([(9, "s", "\xa0test", "q")], "variant_id bigint, source string, split string, result string")
    assert {(r.record_id, r.train) for r in overlap.split_records(a, b).collect()} == {(1, True), (2, False), (9, False)}


def test_wu_manber_against_brute_force():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 4000).astype(np.uint64)
    pats = np.array([text[i : i + 5] for i in (0, 17, 3995)] + [rng.integers(1, 6, 5) for _ in range(20)], np.uint64)
    owner = np.arange(len(pats))
    pos, item = leaks.WuManber(pats, owner).find(text, lane=64)
    want = {(i, k) for i in range(len(text) - 4) for k in range(len(pats)) if (text[i : i + 5] == pats[k]).all()}
    assert set(zip(pos.tolist(), item.tolist())) == want


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(1, item, "short"), (2, None, item.upper() + " tail"), (2, None, item.upper() + " tail"), (3, "too short to leak", None), (None, item, item)], "item_id bigint, question string, passage string")
    cut = " ".join(f"Word{i}," for i in range(3, 16))
    docs = [(1, f"before {cut} after"), (1, f"before {cut} after"), (2, cut.replace("Word9,", "other")), (3, None), (4, ""), (5, " ".join(f"word{i}" for i in range(8)) + " x " + " ".join(f"word{i}" for i in range(8, 20))), (None, cut), (6, "lorem " * 30000 + cut)]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, item_id int")
    want = {(1, 1), (1, 2), (6, 1), (6, 2)}
    args = (items, "item_id", ["question", "passage"])
    assert {tuple(r) for r in leaks.leaked_items(df, "doc_id", "text", *args).collect()} == want
    assert {tuple(r) for r in leaks.leaked_items(df, "doc_id", "text", *args, max_patterns=5).collect()} == want  # in several parts
    assert leaks.leaked_items(df, "doc_id", "text", items.limit(0), "item_id", ["question", "passage"]).collect() == []
    assert leaks.leaked_items(df.limit(0), "doc_id", "text", *args).collect() == []
